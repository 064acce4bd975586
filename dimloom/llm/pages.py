"""Main text of web pages by template deduction over the pages of a host.

Tokens are tags, told apart by their path of tags and classes, and text runs, told apart by path and wording. A token's
occurrence vector says how often it stands on each page of the host; tokens with equal vectors form an equivalence class.
A class is valid if it is frequent, if its tokens keep one order on every page, and if it nests with the other classes on every page. The
valid classes, nested, are the template, and the gaps between their tokens are its slots. A class's text runs are the host's fixed wording only if
its pages hold more text that varies than text of the class; so what copies of an article share is not taken for wording.

Slots are judged by the text they hold on all pages of the host. Tags and class words only mark text: elements that are never article (menus,
footers, forms) are left out, and class words and <main> or <article> decide between slots. A mark under which a host, or a page, would lose
nearly all of its text does not count. Vectors are compared by their sums of hashes, so a host with any share of all pages is counted in parts; no host
is gathered in one place. Pages are scanned once; later passes read the written tokens.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimloom.llm.common import texts
from dimloom.llm.urls import split_url
from dimloom.session import materialize

# A class counts as frequent on this share of the host's pages, and on so many of them.
SHARE, LEAST_PAGES = 0.5, 5
# Template tokens that may be sent to every task, 16 bytes each; with more, pages are shuffled by host.
BROADCAST_TOKENS = 1_000_000
# Unmarked text is enough if it is this share of all text; an article is one if it is this share of what else there is.
ENOUGH, ARTICLE_SHARE = 0.1, 0.25
# A slot is closed if this share of its text is marked.
CLOSED = 0.95
# Partial counts a task holds before it hands them on.
HELD = 100_000

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|"""
                   r"""<(/?)([A-Za-z][^\s/>]*+)((?>(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+))>?""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CHROME = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "noscript", "template", "button", "select", "option",
           "object", "svg", "canvas", "audio", "video", "label", "fieldset"}
_BLOCK = _CHROME | {"html", "body", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table",
                    "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "section", "article", "main", "header", "blockquote",
                    "pre", "figure", "figcaption", "address", "hr", "details", "summary", "hgroup", "center", "title"}
# An opening tag ends these open elements, up to the elements that fence them in.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
         "option": ({"option"}, {"select"})}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_HINT = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|footer|ad|ads|advert|adverts|advertisement|adsense|sponsor|"
                   r"sponsored|promo|cookie|cookies|consent|notice|notices|popup|modal|overlay|newsletter|subscribe|signup|login|"
                   r"share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|pager|comment|comments|disqus|"
                   r"reply|replies|respond|widget|toolbar|masthead|topbar)(?:$|[\s_-])", re.I)
_HEADER_HINT = re.compile(r"(?:^|[\s_-])(?:header|banner)(?:$|[\s_-])", re.I)
# Where a run stands: outside, inside <main>, inside <article>.
OUTSIDE, MAIN, ARTICLE = 0, 1, 2
# A run's mark: place + 3 * (top heading) + 6 * (marked elements around it, NEVER if one of them never holds an article).
NEVER = 9


def scan(page: str) -> tuple[list[int], list[int], list[str]]:
    """The page's tokens in order, a mark for each (-1 for a tag), and the texts of its text runs."""
    from xxhash import xxh64_intdigest

    tokens: list[int] = []
    marks: list[int] = []
    found: list[str] = []
    # Open elements: name, token, marked elements up to here, region, in a top heading.
    stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, OUTSIDE, False)]
    words: list[str] = []
    place = stack[0]

    def flush():
        nonlocal words
        if words:
            text = " ".join("".join(words).split())
            words = []
            if text:
                tokens.append(xxh64_intdigest(f"{place[1]}|{text}") >> 1)
                marks.append(place[3] + 3 * place[4] + 6 * place[2])
                found.append(text)

    def add(text: str):
        nonlocal place
        if text:
            if not words:
                if text.isspace():
                    return
                place = next(x for x in reversed(stack) if x[0] in _BLOCK or not x[0])
            words.append(entities.unescape(text) if "&" in text else text)

    at, end = 0, len(page)
    while at < end:
        mark = _MARK.search(page, at)
        if mark is None:
            add(page[at:])
            break
        add(page[at:mark.start()])
        at = mark.end()
        name = mark[2]
        if name is None:
            if page.startswith("<![CDATA[", mark.start()):
                add(page[mark.start() + 9:at].removesuffix("]]>"))
            continue
        name = name.lower()
        if name == "br":
            add(" ")
            words and words.append(" ")
            continue
        if mark[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    if name in _BLOCK:
                        flush()
                        tokens.append(xxh64_intdigest(f"{stack[i][1]}/") >> 1)
                        marks.append(-1)
                    del stack[i:]
                    break
            else:
                if name in _BLOCK:
                    flush()
            continue
        if name in _BLOCK:
            flush()
            ends, fence = _ENDS.get(name, (set(), set()))
            for i in range(len(stack) - 1, 0, -1):
                open_name = stack[i][0]
                if open_name == "p" or open_name in ends:
                    del stack[i:]
                    if not ends:
                        break
                elif open_name in fence or (not ends and open_name in _BLOCK):
                    break
        _, path, marked, region, heading = stack[-1]
        label, roles = "", ()
        if "=" in mark[3]:
            named = [(k.lower(), a or b or c) for k, a, b, c in _NAMED.findall(mark[3])]
            label = " ".join(v for k, v in named if k != "role")
            roles = [v.lower() for k, v in named if k == "role"]
            css = " ".join(v for k, v in named if k == "class")
        else:
            css = ""
        token = xxh64_intdigest(f"{path}/{name}.{css}") >> 1
        tokens.append(token)
        marks.append(-1)
        if name == "article":
            region = ARTICLE
        elif (name == "main" or "main" in roles) and region == OUTSIDE:
            region = MAIN
        if name in _CHROME or (roles and not _ROLES.isdisjoint(roles)) or (name == "header" and region == OUTSIDE):
            marked = NEVER
        elif label and name not in ("html", "body", "main") and (
                _HINT.search(label) or (region == OUTSIDE and _HEADER_HINT.search(label))):
            marked = max(marked, min(marked + 1, NEVER - 1))
        if name in _RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else end
            continue
        if name not in _VOID:
            stack.append((name, token, marked, region, heading or name == "h1"))
    flush()
    return tokens, marks, found


def scanned(pages: DataFrame) -> DataFrame:
    """id, url, host, html -> id, url, host, a number for the row, and the page's tokens, marks and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some pages at a time, so that what a long page grows to is handed on soon.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                columns = list(zip(*[scan(raw.decode("utf-8", "replace")) for raw in texts(part.column(4))]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array(columns[0], pa.list_(pa.int64())), pa.array(columns[1], pa.list_(pa.int32())),
                     pa.array(columns[2], pa.list_(pa.string()))], ["id", "url", "host", "row", "tokens", "marks", "texts"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.select("id", "url", "host", F.monotonically_increasing_id().alias("row"), "html").mapInArrow(
        run, f"id {kind}, url string, host string, row bigint, tokens array<bigint>, marks array<int>, texts array<string>")


class Counts:
    """Sums by key that a task hands on once it holds too many."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.held: dict[tuple, list[int]] = {}

    def add(self, key: tuple, values: Sequence[int]):
        row = self.held.get(key)
        if row is None:
            self.held[key] = list(values)
        else:
            for j, v in enumerate(values):
                row[j] += v

    def rows(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.held) > least:
            columns = list(zip(*[(*k, *v) for k, v in self.held.items()]))
            self.held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], self.names)


def occurrences(pages: DataFrame) -> DataFrame:
    """Per host and token: pages it is on, occurrences, two sums of hashes of its vector, sum of first positions. Token 0 counts the pages that hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        counts = Counts(["host", "token", "is_text", "pages", "total", "sum_a", "sum_b", "first"], [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5])
        for batch in batches:
            for host, row, tokens, marks in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if not tokens:
                    continue
                seen: dict[int, list] = {0: [1, 0, False]}
                for i, token in enumerate(tokens):
                    if token in seen:
                        seen[token][0] += 1
                    else:
                        seen[token] = [1, i, marks[i] >= 0]
                for token, (n, first, is_text) in seen.items():
                    mixed = xxh64_intdigest(f"{row}:{n}")
                    counts.add((host, token, is_text), (1, n, mixed & 0x7FFFFFFF, mixed >> 33, first))
                yield from counts.rows(HELD)
        yield from counts.rows()

    return pages.select("host", "row", "tokens", "marks").mapInArrow(
        run, "host string, token bigint, is_text boolean, pages bigint, total bigint, sum_a bigint, sum_b bigint, first bigint")


def with_template(pages: DataFrame, template: DataFrame, size: Column, how: str = "inner") -> DataFrame:
    """Pages with what is known of their host. Sent to every task only if all templates together are small, in tokens."""
    total = template.agg(F.sum(size).alias("n")).first().n or 0
    return pages.join(F.broadcast(template) if total <= BROADCAST_TOKENS else template, "host", how)


def places(classes: list) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """Of each token of a host's classes the class and the place in it; the sizes of the classes."""
    return {m["token"]: (c, k) for c, members in enumerate(classes) for k, m in enumerate(members)}, [len(members) for members in classes]


def walk(tokens: list[int], where: dict[int, tuple[int, int]], sizes: list[int]) -> tuple[list[int], set[int]]:
    """For each token of a page the slot it stands in, named by the template token before the slot (0: outside), and the classes that break.

    A class breaks where its tokens are out of order, where it is never completed, or where it crosses a class that is no smaller.
    """
    open_classes: list[int] = []
    last: list[int] = []
    step = [0] * len(sizes)
    bad: set[int] = set()
    slots = []
    for token in tokens:
        slots.append(last[-1] if last else 0)
        c, k = where.get(token, (-1, 0))
        if c < 0 or c in bad:
            continue
        if k and k == step[c] and open_classes[-1] != c:
            i = open_classes.index(c) + 1
            if all(sizes[x] < sizes[c] for x in open_classes[i:]):
                bad.update(open_classes[i:])
                del open_classes[i:], last[i:]
        if k != step[c] or (k and open_classes[-1] != c):
            bad.add(c)
            if c in open_classes:
                i = open_classes.index(c)
                del open_classes[i], last[i]
            continue
        if not k:
            open_classes.append(c)
            last.append(token)
        last[-1] = token
        step[c] = k + 1
        if step[c] == sizes[c]:
            step[c] = 0
            open_classes.pop()
            last.pop()
    return slots, bad | set(open_classes)


def class_facts(pages: DataFrame) -> DataFrame:
    """(host, class, broken, own, varying): pages on which the class breaks, the unmarked text its runs hold, and the unmarked text on its pages that is in no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(["host", "class", "broken", "own", "varying"], [pa.string(), pa.int32(), *[pa.int64()] * 3])
        known: dict[str, tuple] = {}
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(4)])
            for i, (host, tokens, marks, found) in enumerate(rows):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = places(batch.column(4)[i].as_py())
                where, sizes = known[host]
                bad = walk(tokens, where, sizes)[1]
                own = dict.fromkeys({where[t][0] for t in tokens if t in where}, 0)
                runs = list(zip([(t, m) for t, m in zip(tokens, marks) if m >= 0], found))
                amounts: dict[int, int] = {}
                for (_, mark), n in runs:
                    amounts[mark] = amounts.get(mark, 0) + n
                level, varying = chosen(amounts)[0], 0
                for (token, mark), n in runs:
                    if mark // 6 <= level and token in where:
                        own[where[token][0]] += n
                    elif mark // 6 <= level:
                        varying += n
                for c, n in own.items():
                    counts.add((host, c), (int(c in bad), n, varying))
                yield from counts.rows(HELD)
        yield from counts.rows()

    return pages.select("host", "tokens", "marks", F.transform("texts", lambda t: F.length(t)).alias("lengths"), "classes").mapInArrow(
        run, "host string, class int, broken bigint, own bigint, varying bigint")


def members() -> Column:
    return F.size(F.flatten("classes"))


def templates(pages: DataFrame) -> DataFrame:
    """One row per host of the scanned pages: ``classes``, an array of equivalence classes, each its tokens in order (token, is_text).

    Only frequent, ordered and nesting classes are kept. Text runs are kept in classes with tags whose pages hold more varying text than text of the
    class. A template is as long as a page at most.
    """
    counted = materialize(occurrences(pages).groupBy("host", "token", "is_text").agg(
        *[F.sum(c).alias(c) for c in ("pages", "total", "sum_a", "sum_b", "first")]))
    hosts = counted.where("token = 0").select("host", F.col("pages").alias("of"))
    frequent = counted.where((F.col("token") != 0) & (F.col("pages") >= LEAST_PAGES)).join(hosts, "host").where(
        F.col("pages") >= SHARE * F.col("of"))
    # A token alone is a class if it never repeats; alone and repeating it would only cut text into paragraphs.
    classes = frequent.groupBy("host", "pages", "total", "sum_a", "sum_b").agg(F.sort_array(F.collect_list(
        F.struct((F.col("first") / F.col("pages")).alias("at"), "token", "is_text"))).alias("members")).where(
            (F.size("members") > 1) | (F.col("total") == F.col("pages")))
    rough = materialize(classes.groupBy("host").agg(F.sort_array(F.collect_list(F.transform(
        "members", lambda m: F.struct(m["token"].alias("token"), m["is_text"].alias("is_text"))))).alias("classes")))
    facts = class_facts(with_template(pages, rough, members())).groupBy("host", "class").agg(
        (F.sum("broken") == 0).alias("valid"), (F.sum("own") < F.sum("varying")).alias("frames"))
    known = materialize(facts.where("valid").groupBy("host").agg(
        F.collect_set("class").alias("valid"), F.collect_set(F.when(F.col("frames"), F.col("class"))).alias("frames")))
    kept = F.filter(F.transform("classes", lambda c, i: F.when(F.array_contains("frames", i) & F.exists(c, lambda m: ~m["is_text"]), c).when(
        F.array_contains("valid", i), F.filter(c, lambda m: ~m["is_text"]))), lambda c: F.size(c) > 0)
    return materialize(rough.join(known, "host").select("host", kept.alias("classes")))


def chosen(amounts: dict[int, int]) -> tuple[int, int, bool]:
    """From characters by mark: the marked elements that may stand around a run, the least region, and whether top headings outside that are taken, too."""
    total = sum(n for mark, n in amounts.items() if mark // 6 < NEVER)
    level = 0
    for level in range(NEVER):
        at = {mark: n for mark, n in amounts.items() if mark // 6 <= level}
        if any(mark % 3 for mark in at) or sum(at.values()) >= max(1, ENOUGH * total):
            break
    by_region = [sum(n for mark, n in at.items() if mark % 3 == r) for r in (OUTSIDE, MAIN, ARTICLE)]
    region = OUTSIDE
    if by_region[MAIN] + by_region[ARTICLE] >= max(1, ARTICLE_SHARE * by_region[OUTSIDE]):
        region = ARTICLE if by_region[ARTICLE] > by_region[MAIN] else MAIN
    heading = not any(mark % 6 >= 3 and mark % 3 >= region for mark in at)
    return level, region, heading


def slot_texts(pages: DataFrame) -> DataFrame:
    """(host, slot, mark, chars): the varying text of the slots of the hosts' templates. Slots are judged by all pages, copies included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(["host", "slot", "mark", "chars"], [pa.string(), pa.int64(), pa.int32(), pa.int64()])
        known: dict[str, tuple] = {}
        for batch in batches:
            for i, (host, tokens, marks, found) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(4)])):
                if host not in known:
                    if len(known) > 500:
                        known.clear()
                    known[host] = places(batch.column(4)[i].as_py())
                where, sizes = known[host]
                lengths = iter(found)
                for token, mark, slot in zip(tokens, marks, walk(tokens, where, sizes)[0]):
                    if mark >= 0:
                        n = next(lengths)
                        if token not in where:
                            counts.add((host, slot, mark), (n,))
                yield from counts.rows(HELD)
        yield from counts.rows()

    return pages.select("host", "tokens", "marks", F.transform("texts", lambda t: F.length(t)).alias("lengths"), "classes").mapInArrow(
        run, "host string, slot bigint, mark int, chars bigint")


def rules_of(slots: list) -> tuple[int, int, bool, set[int]]:
    """What a host takes: see ``chosen``; and the slots that hold next to nothing but marked text."""
    amounts: dict[int, int] = {}
    by_slot: dict[int, dict[int, int]] = {}
    for s in slots:
        amounts[s["mark"]] = amounts.get(s["mark"], 0) + s["chars"]
        by_slot.setdefault(s["slot"], {})[s["mark"]] = s["chars"]
    level, region, heading = chosen(amounts)
    closed = {slot for slot, own in by_slot.items()
              if sum(n for mark, n in own.items() if mark // 6 > level) > CLOSED * sum(own.values())}
    return level, region, heading, closed


def main_text(tokens: list[int], marks: list[int], found: list[str], classes: list | None, rules: tuple | None) -> str:
    """The blocks of the article slots, without the host's fixed wording.

    A page without a template, or to which its host's rules would leave nothing, is judged by its own marks.
    """
    where, sizes = places(classes or [])
    runs, texts_left = [], iter(found)
    for token, mark, slot in zip(tokens, marks, walk(tokens, where, sizes)[0]):
        if mark >= 0:
            text = next(texts_left)
            if mark // 6 < NEVER:
                # The top heading of an article is no wording, even if all pages of a host are copies of one.
                runs.append((text, mark, token in where and not (mark % 6 >= 3 and mark % 3), slot))
    varying = [r for r in runs if not r[2]]

    def taken(rows, level, region, heading, closed):
        # A top heading may stand in one marked element more, such as the header of the article.
        return [text for text, mark, _, slot in rows if (mark // 6 <= level and slot not in closed and mark % 3 >= region) or (
            heading and mark % 6 >= 3 and mark // 6 <= level + 1)]

    if rules and varying and (out := taken(varying, *rules)):
        return "\n".join(out)
    for rows in (varying, runs):
        amounts: dict[int, int] = {}
        for text, mark, _, _ in rows:
            amounts[mark] = amounts.get(mark, 0) + len(text)
        if rows:
            return "\n".join(taken(rows, *chosen(amounts), ()))
    return ""


def extract_text(df: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``df``: id, url, ``text`` and ``n_chars``.

    A null or empty page has an empty text. Pages without a host (null or odd URLs) share one template. Hosts with fewer than
    ``LEAST_PAGES`` pages have none; their pages are read by their marks alone. Repeated rows stay.
    """
    pages = materialize(scanned(df.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
                                          split_url(F.col(url))[0].alias("host"))))
    known = templates(pages)
    slots = slot_texts(with_template(pages, known, members())).groupBy("host", "slot", "mark").agg(F.sum("chars").alias("chars"))
    known = materialize(known.join(slots.groupBy("host").agg(F.collect_list(F.struct("slot", "mark", "chars")).alias("slots")), "host", "left"))
    ready = with_template(pages, known, members() + F.coalesce(F.size("slots"), F.lit(0)), "left")
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[str, tuple] = {}
        for batch in batches:
            found = []
            for i, (host, *page) in enumerate(zip(*[batch.column(i).to_pylist() for i in range(2, 6)])):
                if host not in rules:
                    if len(rules) > 500:
                        rules.clear()
                    slots = batch.column(7)[i].as_py()
                    rules[host] = batch.column(6)[i].as_py(), rules_of(slots) if slots else None
                found.append(main_text(*page, *rules[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                ["id", "url", "text", "n_chars"])

    return ready.select("id", "url", "host", "tokens", "marks", "texts", "classes", "slots").mapInArrow(
        run, f"id {kind}, url string, text string, n_chars bigint").select(
            F.col("id").alias(id_column), F.col("url").alias(url), "text", "n_chars")
