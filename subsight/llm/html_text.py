"""Main text of web pages: markup rules and nearest-URL page differencing.

Pages of a host are put in the order of their paths, and each is paired with the
neighbour whose path shares more with its own. Their lines (blocks of text) are
aligned by a longest common subsequence, and lines that both have are site
furniture. Where the markup marks an article, its lines are the content as they
stand: two pages may carry the same article, and no line of it may go.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsight.llm.lcs import aligned

# Fixed values of HTML, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output"
    " progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SECTIONING = frozenset("article aside body div footer form header html main nav section table td th".split())
FURNITURE = frozenset(
    "aside button canvas datalist dialog footer form head header menu nav noscript object select svg template".split()
)
CONTENT = frozenset(("article", "main"))
FURNITURE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disclaimer|disqus|footer|gdpr"
    r"|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|share|sharing"
    r"|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
FURNITURE_ROLES = frozenset("banner complementary contentinfo dialog alert form menu menubar navigation search".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _is_furniture(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in FURNITURE:
        # A header within an article holds its title.
        return not (tag == "header" and in_content)
    if not attributes.strip() or tag in ("html", "body"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name in ("class", "id") and FURNITURE_NAMES.search(html.unescape(value)):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, bool]]:
    """``(text, in the article)`` for each block of text outside the furniture, in page order."""
    lines: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in furniture, in content
    open_tags: Counter[str] = Counter()
    skipped = content = False
    at = 0

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, content))
        parts.clear()

    def add(text: str) -> None:
        if text and not skipped:
            parts.append(html.unescape(text) if "&" in text else text)

    last = page.rfind(">")
    while at < len(page):
        start = page.find("<", at)
        # Behind the last end of a tag there is text only, but for an open comment.
        if start < 0 or start > last and not page.startswith("<!--", start):
            add(page[at:] if start < 0 else page[at : start + 1])
            at = len(page) if start < 0 else start + 1
            continue
        token = _TOKEN.match(page, start)
        if token is None:
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if tag not in INLINE and tag != "br":
            flush()
        if tag == "br":
            add(" ")
        if token[1]:
            for i in range(len(stack) - 1, -1, -1) if open_tags[tag] else ():
                if stack[i][0] == tag:
                    open_tags.subtract(t for t, _, _ in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in SECTIONING and tag not in SECTIONING and tag not in FURNITURE:
                    break
        elif tag in RAW:
            if not token[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID:
            inside = content or tag in CONTENT
            open_tags[tag] += 1
            stack.append((tag, skipped or _is_furniture(tag, token[3], content), inside))
        skipped, content = (stack[-1][1], stack[-1][2]) if stack else (False, False)
    flush()
    return lines


def main_text(lines: list[tuple[str, bool]], other: list[tuple[str, bool]] | None) -> tuple[str, int]:
    """The text of a page and how many of its lines went for being shared with ``other``.

    Differencing decides on every line: those that ``other`` has go and the rest stays, beside an
    article too. Only the lines of the marked article stand though another page has them. Without
    a page that tells anything, the article is the text, and the whole page if none is marked.
    """
    own = [text for text, _ in lines]
    article = {i for i, (_, inside) in enumerate(lines) if inside}
    shared = set(aligned(own, [text for text, _ in other])) if other else set()
    if not other or len(shared) == len(own):  # a copy of the page tells nothing about furniture
        kept, gone = article or set(range(len(own))), 0
    else:
        kept, gone = article | (set(range(len(own))) - shared), len(shared - article)
    return " ".join(text for i, text in enumerate(own) if i in kept), gone


def _common(a: str, b: str) -> int:
    most = min(len(a), len(b))
    return next((i for i in range(most) if a[i] != b[i]), most)


SCHEMA = "page_id bigint, url string, text string, n_chars bigint, shared_lines int"
_BATCH = 500


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out: list[tuple] = []
    place = lines = before = None  # of a run of copies: range, host and print; their lines; the page before: path, lines
    run: list[tuple] = []  # path, id, url, whether another range answers for the page

    def finish(after: tuple | None) -> None:
        own, told = [text for text, _ in lines], {}
        for path, page_id, url, lent in run:
            if lent:
                continue
            near = [n for n in (0, 1) if (before, after)[n] and [text for text, _ in (before, after)[n][1]] not in ([], own)]
            n = max(near, key=lambda n: _common((before, after)[n][0], path), default=None)
            if n not in told:
                told[n] = main_text(lines, None if n is None else (before, after)[n][1])
            out.append((page_id, url, told[n][0], len(told[n][0]), told[n][1]))

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        for host, path, page, page_id, url, mark, at, lent in zip(*batch.columns):
            this, path = (at.as_py(), host.as_py(), mark.as_py()), path.as_py()
            if this != place:
                found, same = page_lines(page.as_py() or ""), place is not None and this[:2] == place[:2]
                if run:
                    finish((path, found) if same else None)
                before = (run[-1][0], lines) if same else None
                place, lines, run = this, found, []
            run.append((path, page_id.as_py(), url.as_py(), lent.as_py()))
        if len(out) >= _BATCH:
            yield flushed()
            out.clear()
    if run:
        finish(None)
    if out:
        yield flushed()


#: Pages of a range, about, and the most ranges there are. The driver gets so many keys a range to
#: cut by, and two at each end.
PAGES_PER_RANGE = 100
MAX_RANGES = 1 << 14
KEYS_PER_RANGE = 8
_KEY = ["_host", "_path", "page_id", "url", "_print"]


def _keys(batch: pa.RecordBatch) -> list[tuple]:
    """What a page is ordered by, as Spark does: null first, texts by code point."""
    return [tuple((v is not None, v) if v is not None else (False,) for v in key) for key in zip(*(batch.column(c).to_pylist() for c in _KEY))]


def _cuts(rows: DataFrame) -> list[tuple]:
    """Where the ranges begin. That decides how even they are, not what comes out."""
    count = rows.count()
    ranges = min(MAX_RANGES, count // PAGES_PER_RANGE)
    if ranges < 2:
        return []
    drawn = F.pmod(F.xxhash64(*_KEY), F.lit(count)) < ranges * KEYS_PER_RANGE
    keys = [key for batch in rows.select(*_KEY).where(drawn).distinct().toArrow().to_batches() for key in _keys(batch)]
    keys.sort()
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _outermost(keys: list[tuple], last: bool) -> list[tuple]:
    """The first or last of some keys, and the next one inwards that is no copy of it."""
    ordered = sorted(keys, reverse=last)
    return ordered[:1] + [k for k in ordered if k[-1] != ordered[0][-1]][:1]


def _lent(rows: DataFrame, cuts: list[tuple]) -> dict[tuple, list[int]]:
    """The pages that other ranges have to see: those next to them, behind any copies of their edge."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for key in _keys(batch):
                first, last = held.setdefault(bisect_right(cuts, key), ([], []))
                if len(first) < 2 or key < first[1]:
                    first[:] = _outermost([*first, key], False)
                if len(last) < 2 or key > last[1]:
                    last[:] = _outermost([*last, key], True)
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(held), pa.int32()), "ends": pa.array([pickle.dumps(e) for e in held.values()], pa.binary())})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        found = [pickle.loads(e) for e in parts["ends"]]
        both = [_outermost([k for e in found for k in e[side]], bool(side)) for side in (0, 1)]
        return pd.DataFrame({"at": parts["at"].iloc[:1], "ends": [pickle.dumps(both)]})

    kind = "at int, ends binary"
    got = rows.select(*_KEY).mapInArrow(ends, kind).groupBy("at").applyInPandas(merged, kind).collect()
    ranges = sorted((r["at"], pickle.loads(r["ends"])) for r in got)
    lent: dict[tuple, list[int]] = {}
    for side, order in ((1, ranges), (0, ranges[::-1])):
        near: list[tuple] = []  # the page next to the range, and the next one that is no copy of it
        for at, own in order:
            edge = own[1 - side][0]
            for key in near if near and near[0][-1] == edge[-1] else near[:1]:
                lent.setdefault(key, []).append(at)
            near = (own[side] + [k for k in near if k[-1] != own[side][0][-1]])[:2]
    return lent


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars, shared_lines)`` for each row of ``(page_id, url, html)``.

    A page is differenced against the page before or behind it in the order of host and path,
    that whose path is more like its own. Copies are passed over: pages of equal html are
    one, and a page of the same lines gives way to the one on the other side.
    Pages are dealt by ranges of host and path, so a host with very many pages
    is split too; a range is lent the pages next to it, so results do not depend on the cuts. A null or
    empty page gives an empty text. Pages without a url are one host of their
    own. Repeated rows come back as often as they came. An empty table gives an
    empty one. Other columns are not read.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = pages.select(
        F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"), "html", "page_id", "url", F.xxhash64("html").alias("_print")
    )
    cuts = _cuts(rows)
    lent = _lent(rows, cuts) if cuts else {}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            own = [(i, bisect_right(cuts, key), False) for i, key in enumerate(keys)]
            again = [(i, at, True) for i, key in enumerate(keys) for at in lent.get(key, ())]
            for part in (own, again):
                if part:
                    i, at, flags = zip(*part)
                    kept = batch if part is own else batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(at, pa.int32()), pa.array(flags)], names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_lent", T.BooleanType())])
    names = schema.names
    ranged = rows.mapInArrow(dealt, schema).repartition("_range").sortWithinPartitions("_range", *_KEY)
    return ranged.mapInArrow(_extract, SCHEMA)
