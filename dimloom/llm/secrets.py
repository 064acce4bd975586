"""Secret scan: fixed patterns, and a sliding-window entropy test over candidate strings.

A candidate is a run of key characters. Windows of a fixed width slide over it; the counts of the characters in the window are
kept up to date as one character enters and one leaves, and with them the sum of c*log2(c), so a step costs the
same however long the run is. A window is suspicious if its Shannon entropy reaches the limit of its character class:
hexadecimal, letters and digits, or base64. Touching suspicious windows form one span. Allow-lists suppress what only
looks random: plain words, identifiers in known forms, counting sequences, and of addresses the hosts. User names, passwords and query values
are tested like other text, and so are the path segments of webhooks and the like; of other paths the runs of letters and digits are, by a limit of
their own and only if capitals, small letters and digits are mixed, as titles, dates and hashes of files stand there, too.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from dimloom.llm.common import texts

# Fixed patterns of the scan, in the order their kinds are listed.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
# The two patterns below assign need 20 characters at least, all of them candidate characters.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_PART = re.compile(r"[A-Za-z0-9]{20,}")
# What follows the start of a URL: the ASCII characters of one, without those that end it in lists, markup and JSON.
_URL = re.compile(r"(?:://|www\.)((?:(?!://)[A-Za-z0-9._~:/?#\[\]@!$&*+=%-])*)")
# User and password before the host. A password may hold a slash if a colon stands before it that begins no port.
_USERINFO = re.compile(r"[^/?#]*@|[^/?#@:]*:(?!\d+(?:[/?#]|\Z))[^?#]*@")
# URLs whose paths carry keys: their segments need no more entropy than other text.
_KEYED_PATH = re.compile(r"hook|/services/|/bot\d|token|secret|api[_-]?key|/keys?/|auth|sign", re.IGNORECASE)
# The domain of an e-mail address.
_MAIL = re.compile(r"(?<=[A-Za-z0-9._%+-]@)(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9+/_=-])")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDS = re.compile(r"[A-Za-z]?[a-z]+([-_/=][A-Za-z]?[a-z]*)*|[A-Z]+([-_/=][A-Z]*)*")
_RULER = re.compile(r"(.)\1*|[-_=+/]+|(0123456789|1234567890|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ)+")


@dataclass(frozen=True)
class EntropyRules:
    """Window width, and the least entropy in bits for each character class (at most log2 of the width).

    ``path`` and ``changes`` are for runs in ordinary paths: their entropy, and the share of places where the kind of character changes.
    """

    width: int = 20
    hexadecimal: float = 3.2
    letters_digits: float = 3.7
    base64: float = 3.9
    path: float = 3.9
    changes: float = 0.4
    allow: tuple[str, ...] = ()


def window_spans(text: str, limit: float, width: int) -> list[tuple[int, int]]:
    """Spans covered by windows of ``width`` characters with an entropy of at least ``limit`` bits."""
    if len(text) < width:
        return []
    log = [0.0] + [c * math.log2(c) for c in range(1, width + 2)]
    most = (math.log2(width) - limit) * width + 1e-9
    counts: dict[str, int] = {}
    weighted, spans = 0.0, []
    for i, new in enumerate(text):
        c = counts.get(new, 0)
        weighted += log[c + 1] - log[c]
        counts[new] = c + 1
        if i >= width:
            old = text[i - width]
            c = counts[old]
            weighted += log[c - 1] - log[c]
            counts[old] = c - 1
        # Entropy is log2(width) - weighted / width.
        if i >= width - 1 and weighted <= most:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def merged_spans(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def character_class(text: str, rules: EntropyRules) -> float | None:
    """The entropy limit of the string's class; None for strings that are words or a known harmless form."""
    if _WORDS.fullmatch(text) or _UUID.search(text) or _RULER.fullmatch(text):
        return None
    digits = sum(c.isdigit() for c in text)
    if not digits and (text.isupper() or text.islower() or "/" in text):
        return None
    if not set(text) - set("0123456789abcdefABCDEF"):
        return rules.hexadecimal if digits < len(text) else None
    if digits == len(text):
        return None
    return rules.letters_digits if text.isalnum() else rules.base64


def path_limit(text: str, rules: EntropyRules) -> float | None:
    """The entropy limit of a run of letters and digits in an ordinary path; None for hashes, titles and numbers.

    Random letters and digits change between capitals, small letters and digits at 0.62 of all places, joined words at about 0.3.
    """
    kinds = [c.isdigit() + 2 * c.isupper() for c in text]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    mixed = len(set(kinds)) == 3 and changes >= rules.changes * (len(text) - 1)
    return rules.path if mixed and character_class(text, rules) is not None else None


def addresses(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """URLs as (start of the host, of the path, end of the path, whether the address speaks of keys)."""
    for m in _URL.finditer(text) if "://" in text or "www." in text else ():
        at, url = m.start(1), m[1]
        host = user.end() if (user := _USERINFO.match(url)) else 0
        path = next((i for i in range(host, len(url)) if url[i] in "/?#"), len(url))
        end = next((i for i in range(path, len(url)) if url[i] in "?#"), len(url))
        yield at + host, at + path, at + end, bool(_KEYED_PATH.search(url, host, end))


def harmless_spans(text: str, urls: Sequence[tuple[int, int, int, bool]]) -> list[tuple[int, int]]:
    """Where only addresses stand: hosts, paths that speak of no key, and domains of e-mail addresses.

    User names, passwords, query values and fragments are not among them. Slashes are, so that the segments of a keyed path are candidates apart.
    """
    out = [m.span() for m in _MAIL.finditer(text)] if "@" in text else []
    for host, path, end, keyed in urls:
        if not keyed:
            out.append((host, end))
            continue
        out.append((host, path))
        out += [(i, i + 1) for i in range(path, end) if text[i] == "/"]
    return merged_spans(out)


def candidates(text: str, runs: Sequence[re.Match], urls: Sequence[tuple[int, int, int, bool]], width: int) -> Iterator[tuple[int, str]]:
    """Start and characters of what is left of the runs outside addresses."""
    harmless = harmless_spans(text, urls) if runs else []
    first = 0
    for run in runs:
        at, end = run.span()
        while first < len(harmless) and harmless[first][1] <= at:
            first += 1
        i = first
        while i < len(harmless) and harmless[i][0] < end:
            if harmless[i][0] - at >= width:
                yield at, text[at:harmless[i][0]]
            at = max(at, harmless[i][1])
            i += 1
        if end - at >= min(width, len(run[0])):
            yield at, text[at:end]


def find_spans(text: str, rules: EntropyRules) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start and then by kind as listed."""
    found: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = list(_CANDIDATE.finditer(text))
    for run in runs:
        at, word = run.start(), run[0]
        found += [("access", at + m.start(), at + m.end()) for m in _ACCESS.finditer(word) if len(m[0]) >= 20]
        found += [("hex", at + m.start(), at + m.end()) for m in _HEX.finditer(word) if len(m[0]) >= 24]
    known = list(merged_spans(sorted((s, e) for _, s, e in found)))
    ends = [e for _, e in known]
    urls = list(addresses(text)) if runs else []
    tested = [(*c, character_class) for c in candidates(text, runs, urls, rules.width)]
    tested += [(m.start(), m[0], path_limit) for _, path, end, keyed in urls if not keyed for m in _PART.finditer(text, path, end)]
    for start, word, least in tested:
        if any(a in word for a in rules.allow):
            continue
        suspicious = []
        # The whole candidate by its own class, and its parts between separators by theirs.
        for part in dict.fromkeys([word, *_PART.findall(word)]):
            limit = least(part, rules)
            if limit is not None:
                at = start + word.index(part)
                suspicious += [(at + s, at + e) for s, e in window_spans(part, limit, rules.width)]
        for s, e in merged_spans(suspicious):
            i, at, rest = bisect_right(ends, s), s, []
            if i == len(known) or known[i][0] >= e:
                found.append(("entropy", s, e))
                continue
            # What the base spans leave of it is tested by itself.
            while i < len(known) and known[i][0] < e:
                rest.append((at, known[i][0]))
                at, i = known[i][1], i + 1
            for a, b in [*rest, (at, e)]:
                limit = least(text[a:b], rules) if b - a >= rules.width else None
                if limit is not None:
                    found += [("entropy", a + x, a + y) for x, y in merged_spans(window_spans(text[a:b], limit, rules.width))]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(df: DataFrame, rules: EntropyRules = EntropyRules(), id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, and ``secrets``, an array of (kind, start, end) in code points.

    The spans are of the whole match, end exclusive. Null and empty texts have none. Rows with the same id stay apart.
    """
    kind = df.schema[id_column].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(raw.decode("utf-8", "replace"), rules)]
                     for raw in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["id", "secrets"])

    out = df.select(id_column, text).mapInArrow(run, f"id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_column)


def mask_secrets(df: DataFrame, rules: EntropyRules = EntropyRules(), mask: str = "[secret]", text: str = "text",
                 length: str | None = None) -> DataFrame:
    """``df`` with every found span replaced by ``mask``; ``length`` names a column to hold the new number of characters.

    Texts without a finding, null texts and all other columns stay as they are.
    """
    names = df.columns
    at = names.index(text)
    count_at = names.index(length) if length else None
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            values = columns[at].to_pylist()
            sizes = columns[count_at].to_pylist() if count_at is not None else None
            changed = False
            for i, value in enumerate(values):
                if value and (spans := find_spans(value, rules)):
                    values[i] = masked(value, [(s, e) for _, s, e in spans], mask)
                    changed = True
                    if sizes is not None:
                        sizes[i] = len(values[i])
            if changed:
                columns[at] = pa.array(values, columns[at].type)
                if sizes is not None:
                    columns[count_at] = pa.array(sizes, columns[count_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def masked(text: str, spans: Sequence[tuple[int, int]], mask: str) -> str:
    """Overlapping and touching spans become one mask."""
    out, end = [], 0
    for s, e in sorted(spans):
        if s > end or (s == 0 and not out):
            out += [text[end:s], mask]
        end = max(end, e)
    return "".join(out) + text[end:]


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: Sequence[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[0] != "entropy"]).encode()).hexdigest()
