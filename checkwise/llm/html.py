"""Main text of web pages by nearest-URL page differencing.

1. Each page becomes text lines (blocks); structure marks those that are
   boilerplate by their element (nav, header, footer, aside, form, ...) or by
   class, id or role, and those inside the page's article or main element. A
   class, id or role (a hint) drops no article or main, nor an element with one
   in it; layout modifiers (no-, has-, with-, left-, right-) and headings' ids
   are no hints.
2. Pages of a host with equal lines count once (a digest of the lines). These
   distinct pages are range-partitioned by host and URL path (a host of any size
   is split by path), so a page's nearest URLs are its neighbours in order; the
   first and last of each partition find theirs beyond its edges. Only hashes of
   lines move.
3. A page's lines and those of its neighbours on both sides are aligned by
   longest common subsequence (bit-parallel); lines shared with either are the
   site's template and are deleted. Inside an article or main element a line goes
   if both neighbours share it; a neighbour that shares over half of the
   article's text is a copy of it and doesn't judge it. Hinted lines inside an
   article go if either neighbour shares them, or if none can judge; so do
   articles in a hinted element, on pages with another article. With an article
   or main the lines outside it are deleted too.

Defined cases: a null html is empty and gives an empty text; a null url has the
empty host and path; pages alone in their host (but for equal ones) have no
neighbour and rely on structure; rows that repeat an id are pages of their own,
and equal pages of a host get equal texts.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkwise.llm.common import ship, stored

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">]++)*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "noframes", "object",
        "select", "math", "canvas", "audio", "video"}
_DROPPED = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "head", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
           "time", "tt", "u", "var", "wbr"}
_CLOSED_BY_BLOCK = {"p", "li", "dt", "dd"}
_MAIN = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Marks of a line: outside any article, in one, in a hinted block of one, in one inside a hinted element.
OUTSIDE, ARTICLE, HINTED, WRAPPED = range(4)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|subscribe|"
    r"sidebar|side-bar|menu|nav\w*|breadcrumbs?|footer|masthead|social|share|sharing|related|comments?|disqus|replies|"
    r"widget|pagination|search|login|signup|toolbar|contentinfo|complementary)(?:$|[\s_-])", re.I)
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without|left|right)[-_][\w-]*", re.I)


def _hinted(name: str, attributes: str) -> bool:
    """Whether an element's class, id or role says that it is boilerplate."""
    if name in _MAIN or name in ("html", "body"):
        return False
    return any(_HINT.search(_LAYOUT.sub(" ", value.strip("\"'"))) for kind, value in _ATTRIBUTE.findall(attributes)
               if name not in _HEADINGS or kind.lower() != "id")


def lines_of(page: str) -> list[tuple[int, str]]:
    """(mark, text) of the blocks that structure does not mark as boilerplate."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    main: list[str] = []  # open article and main elements
    skip, depth = "", 0  # boilerplate element, and how many of its name are open
    by_hint = False  # whether it is one by its hint only
    soft, soft_depth = "", 0  # hinted element inside an article
    wrap, wrap_depth = "", 0  # hinted element round an article

    def close_block() -> None:
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                out.append(((HINTED if soft else WRAPPED if wrap else ARTICLE) if main else OUTSIDE, line))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        tag = _TOKEN.search(page, at)
        stop = tag.start() if tag else n
        if stop > at and not skip:
            text.append(page[at:stop])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = bool(tag[1])
        if not closing and name in _RAW and not tag[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            if not skip and name not in _INLINE:
                close_block()
            continue
        if skip and by_hint and skip not in _CLOSED_BY_BLOCK and name in _MAIN and not closing:
            wrap, wrap_depth, skip = skip, depth, ""
        elif wrap and name == wrap:
            if wrap_depth == 1 and closing:
                close_block()
                wrap = ""
            wrap_depth += -1 if closing else 1
        if soft and not skip:
            if soft in _CLOSED_BY_BLOCK and name not in _INLINE and name not in _VOID:
                ended = name == soft or not closing or name not in _CLOSED_BY_BLOCK
            else:
                soft_depth += (-1 if closing else 1) if name == soft else 0
                ended = not soft_depth
            if ended:
                close_block()
                soft = ""
        if skip:
            if skip in _CLOSED_BY_BLOCK and name not in _INLINE and name not in _VOID:
                ended = name == skip or not closing or name not in _CLOSED_BY_BLOCK
                skip = "" if ended else skip
                if closing and name != skip and name in main:
                    main.pop()
            elif name == skip:
                depth += -1 if closing else 1
                skip = skip if depth else ""
            if skip or closing:
                continue
        if name not in _INLINE:
            close_block()
        if closing:
            if name in main:
                while main.pop() != name:
                    pass
                soft = soft if main else ""
            continue
        if name in _VOID:
            continue
        hint = bool(tag[3]) and _hinted(name, tag[3])
        if name == "header" and main:
            continue  # an article's own heading
        if name in _DROPPED or (hint and not main):
            close_block()
            skip, depth, by_hint = name, 1, name not in _DROPPED
        elif hint and not soft:
            close_block()
            soft, soft_depth = name, 1
        elif name in _MAIN:
            main.append(name)
    close_block()
    return out


def shared(a: list[str], b: list[str]) -> list[bool]:
    """For each line of a, whether a longest common subsequence with b takes it (bit-parallel)."""
    out = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        out[-1 - hi] = True
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    if not a or not b:
        return out
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for y in b:
        u = row & where.get(y, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            out[lo + i - 1] = True
            i -= 1
            j -= 1
    return out


def _pack(lines: list[tuple[int, str]]) -> bytes:
    return zlib.compress("\n".join(f"{m}{x}" for m, x in lines).encode(), 1)


def _unpack(data: bytes) -> list[tuple[int, str]]:
    text = zlib.decompress(data).decode()
    return [(int(x[0]), x[1:]) for x in text.split("\n")] if text else []


#: A line's mark, hash and length.
_LINE = "<B8sI"


def _hashed(page: list[tuple[int, str]]) -> bytes:
    return b"".join(struct.pack(_LINE, m, hashlib.blake2b(x.encode(), digest_size=8).digest(), len(x)) for m, x in page)


def kept_lines(page: list[tuple], near: list[list[tuple]]) -> list[bool]:
    """For each (mark, line or its hash, length) of a page whether it stays, given its nearest pages."""
    keys, marks = [x[1] for x in page], [x[0] for x in page]
    found = [shared(keys, [x[1] for x in other]) for other in near]
    article = next((m for m in (ARTICLE, WRAPPED, HINTED) if m in marks), OUTSIDE)
    if article == OUTSIDE:
        return [not any(f[i] for f in found) for i in range(len(page))]
    size = sum(x[2] for x in page if x[0] == article)
    judges = [f for f in found if 2 * sum(x[2] for x, s in zip(page, f, strict=True) if x[0] == article and s) <= size]
    return [m != OUTSIDE and (not (len(judges) > 1 and all(f[i] for f in judges)) if m == article
                              else bool(judges) and not any(f[i] for f in judges)) for i, m in enumerate(marks)]


def main_text(page: list[tuple[int, str]], near: list[list[tuple[int, str]]]) -> str:
    """Text of a page, given the lines of its nearest pages."""
    sized = [[(m, x, len(x)) for m, x in lines] for lines in (page, *near)]
    return " ".join(x for (_, x), k in zip(page, kept_lines(sized[0], sized[1:]), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every page."""
    ship(pages.sparkSession)
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"),
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col(html_col).alias("html"))
    kind = dict(pages.dtypes)[id_col]

    def parse(hashes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    lines = [lines_of(x.as_py() or "") for x in part.column(4)]
                    hashed = [_hashed(x) for x in lines]
                    digest = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in hashed], pa.binary())
                    if hashes:
                        yield pa.RecordBatch.from_arrays([part.column(2), digest, part.column(3), pa.array(hashed, pa.binary())],
                                                         ["host", "digest", "path", "lines"])
                    else:
                        packed = pa.array([_pack(x) for x in lines], pa.binary())
                        yield pa.RecordBatch.from_arrays([*part.columns[:3], digest, packed],
                                                         ["id", "url", "host", "digest", "lines"])
        return run

    def verdict(lines: bytes, *near: bytes | None) -> bytes:
        page, *others = [list(struct.iter_unpack(_LINE, x)) for x in (lines, *near) if x is not None]
        return bytes(kept_lines(page, others))

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Verdicts on a partition's inner pages; its first and last page with the neighbour they have here."""
        before = now = None

        def finished(after):
            lines = [x[3] if x and x[0] == now[0] else None for x in (before, after)]
            if before and after:
                return *now[:3], verdict(now[3], *lines), None, None, None, False, False
            return *now[:3], None, now[3], *lines, before is None, after is None

        for batch in batches:
            rows = []
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now:
                    rows.append(finished(x))
                before, now = now, x
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(finished(None), types, strict=True)], names)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [verdict(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.binary())], ["host", "digest", "kept"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(x for (_, x), k in zip(_unpack(lines.as_py()), kept.as_py(), strict=True) if k)
                     for lines, kept in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], [id_col, url_col, "text"])

    names = ["host", "path", "digest", "kept", "lines", "before", "after", "first", "last"]
    types = [pa.string(), pa.string(), *[pa.binary()] * 5, pa.bool_(), pa.bool_()]
    distinct = (rows.mapInArrow(parse(True), "host string, digest binary, path string, lines binary")
                .groupBy("host", "digest").agg(F.min("path").alias("path"), F.first("lines").alias("lines"))
                .select("host", "path", "digest", "lines"))
    ordered = distinct.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest")
    done = stored(ordered.mapInArrow(diff, "host string, path string, digest binary, kept binary, lines binary, "
                                           "before binary, after binary, first boolean, last boolean"), "page_lines")
    # two rows a partition; the next one in order is the page beyond the edge
    by_host = W.partitionBy("host").orderBy("path", "digest")
    open_rows = done.filter("kept is null").select(
        "host", "digest", "lines", F.when(F.col("first"), F.lag("lines").over(by_host)).otherwise(F.col("before")).alias("before"),
        F.when(F.col("last"), F.lead("lines").over(by_host)).otherwise(F.col("after")).alias("after"))
    verdicts = stored(done.filter("kept is not null").select("host", "digest", "kept").union(
        open_rows.mapInArrow(edges, "host string, digest binary, kept binary")), "page_verdicts")
    parsed = rows.mapInArrow(parse(False), f"id {kind}, url string, host string, digest binary, lines binary")
    joined = parsed.join(verdicts, ["host", "digest"]).select("id", "url", "lines", "kept")
    return joined.mapInArrow(write, f"`{id_col}` {kind}, `{url_col}` string, text string")
