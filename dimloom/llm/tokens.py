"""Token counts by the whole-token shortcut, and token ids for packing.

Most words of a text are one token each. Which vocabulary strings are is proved once per process: every string that can
stand as a whole word is given to the library's own model, and only those that come back as one token enter the table.
A pre-token found in that table counts 1; the library merges only the others. Texts are cut at ASCII white space
first, which no token of this kind of vocabulary spans, and each distinct piece is worked out once per process.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from dimloom.llm.common import texts

# Distinct pieces a process remembers. Beyond that it starts anew; the results are the same.
MEMORY = 700_000
# Longer pieces are worked out each time.
LONGEST_KEPT = 64

# Pieces of these characters are in NFC already, and lower-casing changes them one by one; so the pre-tokenizer's
# pattern can be applied here. All other pieces go through the library's own normalizer and pre-tokenizer.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]*")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
_TAIL = b".,;:!?%#$*&|"
_ODD = re.compile("[\x80-\xa0\xad]")
# What the pattern above was written for; files with another one take the library's way throughout.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> dict[str, int]:
    """The pre-tokens that the model encodes, standing alone, as exactly one token, with that token's id."""
    tok = library(path)
    suffix = getattr(tok.model, "end_of_word_suffix", None) or ""
    found = {}
    for string in tok.get_vocab(with_added_tokens=False):
        word = string.removesuffix(suffix)
        if string.endswith(suffix) and word and len(parts := tok.model.tokenize(word)) == 1:
            found[word] = parts[0].id
    return found


class _Memory(dict):
    """Piece between white space -> result, worked out on first sight from its pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = library(path)
        self.whole = whole_tokens(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if not all("<|" in s for s in self.special):
            raise ValueError("the added tokens of this file are not of the form <|name|>")
        self.own_cut = _PATTERN in json.loads(self.tok.to_str())["pre_tokenizer"].__repr__().replace("\\\\", "\\")
        # How the library writes bytes: most as the character of that number, these otherwise. They end letters from U+0100 on.
        self.odd = {b: w for b in [*range(0x80, 0xA1), 0xAD] for w in [self.tok.pre_tokenizer.pre_tokenize_str(chr(0x80 + b))[0][0][-1]]}

    def room(self) -> None:
        """To be called between texts, not while pieces of one are looked up."""
        if len(self) > MEMORY:
            self.clear()

    def part(self, key: bytes):
        """The value of one plain, lower-case pre-token. As a piece it has the same value, so both share the memory."""
        value = self.get(key)
        if value is None:
            written = key.decode("latin-1")
            value = self.merged(written.translate(self.odd) if _ODD.search(written) else written)
            if len(key) <= LONGEST_KEPT:
                self[key] = value
        return value

    def __missing__(self, piece: bytes):
        low = piece.lower()
        stem = low.rstrip(_TAIL)
        if self.own_cut and stem.isalpha():  # ASCII letters and punctuation behind them: two pre-tokens at most
            value = self.part(stem)
            if len(stem) < len(low):
                value += self.part(low[len(stem):])
        else:
            text = piece.decode("utf-8", "replace")
            if "<|" in text and any(s in text for s in self.special):
                return self.listed(self.tok.encode(text, add_special_tokens=False).ids)
            value = self.empty
            if self.own_cut and _PLAIN.fullmatch(text):
                for part in _PARTS.findall(text.lower()):
                    value += self.part(part.encode())
            else:
                for part, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text)):
                    value += self.merged(part)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = value
        return value


class Counts(_Memory):
    """Piece -> its number of tokens."""

    empty = 0

    def listed(self, ids: list[int]) -> int:
        return len(ids)

    def merged(self, part: str) -> int:
        return 1 if part in self.whole else len(self.tok.model.tokenize(part))


class Ids(_Memory):
    """Piece -> its token ids as little-endian unsigned 32-bit integers."""

    empty = b""

    def __init__(self, path: str):
        super().__init__(path)
        self.packed = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size(with_added_tokens=True))]

    def listed(self, ids: list[int]) -> bytes:
        return b"".join([self.packed[i] for i in ids])

    def merged(self, part: str) -> bytes:
        known = self.whole.get(part)
        if known is not None:
            return self.packed[known]
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tok.model.tokenize(part)])


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(path)


@lru_cache(maxsize=2)
def ids(path: str) -> Ids:
    return Ids(path)


def count_tokens(df: DataFrame, path: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    A null or empty text has 0 tokens. Repeated rows and null ids stay as they are. No shuffle, no driver data.
    ``path`` is a tokenizer file of the ``tokenizers`` library whose pre-tokenizer drops white space.
    """
    schema = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = counts(path)
        look = memory.__getitem__
        for batch in batches:
            sizes, numbers = [], []
            for raw in texts(batch.column(1)):
                memory.room()
                sizes.append(len(raw))
                numbers.append(sum(map(look, raw.split())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.int64()),
                 pa.array([n > limit for n in numbers], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = df.select(id_column, text).mapInArrow(run, f"id {schema}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_column)
