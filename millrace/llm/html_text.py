"""Main text of web pages by differencing nearest-URL pages, checked against the markup.

Pages are ordered by host, URL path, id, URL and lines. A run of pages with equal lines is paired with one of
its host's different pages next to it, the one before it or the one after it, by the longer shared beginning of
the paths; their text lines are aligned by a longest common subsequence, and shared lines are taken for template. Differencing alone can't give the right text: articles that hold the same
paragraph would lose it, and an advert or menu that the neighbour doesn't have would stay. So the markup
has the last word where it is plain: a line within an article element stays, a line within a menu,
footer, advert, form, comment list or the like goes, and the alignment decides all other lines (pages
without an article element, or with text beside it only if nothing is in it).

Pages move once, packed, to the range of keys that they belong to; ranges are cut at quantiles of a
bounded sample of keys, so a host with a third of all pages spans many. What lies beyond the edges of each range
is found first, by a pass that moves keys and lines' marks only, so that texts don't depend on the ranges. One run and its neighbours are in memory at a time: the lines once,
and the id, URL and states of each of its pages.

Cases: a null or empty page has the empty text; a page without a neighbour in its host shares nothing; a
null or odd URL belongs to the host of the empty name; repeated rows each get a row (and, being one run,
the same neighbour, so that equal pages side by side have equal texts); a null id keeps its row; an empty table gives an empty
result; markup is read in one forward pass, so that a page of any length and shape takes time in proportion to
it; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import deque
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import estimated, pieces, small_batches

#: Keys in the sample that ranges are cut by, for each range, and altogether.
SAMPLE, SAMPLED = 20, 100_000
#: Bytes of pages in one range, by the plan's estimate, and ranges at most (they grow beyond that).
RANGE_BYTES, MOST_RANGES = 64 << 20, 10_000
#: Bits of the alignment table that are kept at once; larger ones are halved.
TABLE_BITS = 1 << 28

# Elements that never hold article text, and names that mark such elements.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
OUT = {"head", "nav", "footer", "aside", "form", "template", "svg", "canvas", "object", "button", "select", "dialog", "menu", "header"} | RAW
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "ruby", "rt", "rp", "input", "picture", "source",
}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disclaimer",
    "disqus", "footer", "header", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pager", "pagination", "popup",
    "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
QUALIFIED = {"no", "with", "without", "has"}  # of a whole page: "no-sidebar"
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
# Every name is taken, with or without a value, and given back by none: one pass whatever the length.
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
NAME = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
NONE_SHOWN = re.compile(r"display\s*:\s*none")

IN, OPEN, GONE = 0, 1, 2


def _outside(name: str, attributes: str, within: bool) -> bool:
    """Whether an element is none of the article's text. A header within an article holds its title."""
    if name in OUT:
        return not (name == "header" and within)
    if not attributes or not attributes.strip():
        return False
    if name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and any(not NAMES.isdisjoint(parts := set(NAME.findall(name))) and not (parts & QUALIFIED or within and parts & NAMES == {"header"}) for name in value.split()):
            return True
        if key == "role" and value.strip() in ROLES or key == "aria-hidden" and value == "true" or key == "style" and NONE_SHOWN.search(value):
            return True
        if key == "hidden" and m.end() == m.end(1):
            return True
    return False


def marks(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag, comment and declaration (these without a name), in one forward pass.

    A ``>`` between quotes doesn't end a tag; a quote that nothing closes is no quote. Once the page has ended
    within a tag, quotes don't count any more.
    """
    at, last, loose = 0, page.rfind(">"), False
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start) or page.startswith("<![CDATA[", start):
            close = "-->" if page[start + 2] == "-" else "]]>"
            stop = page.find(close, start + 4)
            at = stop + 3 if stop >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        if page.startswith(("<!", "<?"), start):
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        m = TAG.match(page, start)
        if not m or start > last:
            at = start + 1
            continue
        stop, own = -1, m.end()
        while not loose:
            sign = STOP.search(page, own)
            if not sign:
                loose = True
            elif sign[0] == ">":
                stop = sign.start()
                break
            else:
                close = page.find(sign[0], sign.end())
                own = close + 1 if close >= 0 else sign.end()
        if stop < 0:
            stop = page.find(">", m.end())
        at, name, closing = stop + 1, m[1].lower(), page[start + 1] == "/"
        yield start, at, name, closing, page[m.end() : stop]
        if name in RAW and not closing:  # its text is neither markup nor shown
            found = RAW_END[name].search(page, at)
            stop = found.start() if found else len(page)
            yield at, stop, "", False, ""
            at = stop


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, IN, OPEN or GONE) of every block of the page that has text, in page order."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    held: list[str] = []
    at = article = 0
    gone, depth = "", 0  # the element that we are in and that doesn't count, and how often it is open

    def state() -> int:
        return GONE if gone else IN if article else OPEN

    def close() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, state()))

    for start, stop, name, end, attributes in marks(page):
        if start > at:
            held.append(page[at:start])
        at = stop
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        outside = not end and not gone and _outside(name, attributes, article > 0)
        if name not in INLINE or outside or gone and end and name == gone:
            close()
        if name in VOID or name in RAW:
            continue
        if gone:
            if name == gone:
                depth += -1 if end else 1
                gone = gone if depth else ""
            elif name == "article" and not end and gone in ("nav", "header", "head"):
                gone, depth, article = "", 0, article + 1
        elif outside and not attributes.endswith("/"):
            gone, depth = name, 1
        elif name in ("article", "main"):
            article = max(0, article + (-1 if end else 1))
        if gone == "head" and name == "body":
            gone, depth = "", 0
    held.append(page[at:])
    close()
    return out


def _rows(a: list[int], b: list[int]):
    """The states of the bit-parallel alignment of ``b`` after each of ``a``: bit j is 0 where the length grows at j."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` and each beginning of ``b``."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int], table_bits: int = TABLE_BITS) -> list[int]:
    """The places in ``a`` of a longest common subsequence with ``b``."""
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    both = set(a[lo:hi_a]) & set(b[lo:hi_b])
    places = [i for i in range(lo, hi_a) if a[i] in both]
    x, y = [a[i] for i in places], [c for c in b[lo:hi_b] if c in both]
    found: list[int] = []
    if x and y:
        if len(x) * len(y) > table_bits and len(x) > 1:
            half = len(x) // 2
            cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
            found = [*common_lines(x[:half], y[:cut], table_bits), *(half + k for k in common_lines(x[half:], y[cut:], table_bits))]
        else:
            table, i, j = [(1 << len(y)) - 1, *_rows(x, y)], len(x), len(y)
            while i and j:
                if table[i] >> (j - 1) & 1:
                    j -= 1
                else:
                    i -= 1
                    if table[i] >> (j - 1) & 1:
                        found.append(i)
                        j -= 1
            found.reverse()
    return [*range(lo), *(places[k] for k in found), *range(hi_a, len(a))]


def main_text(page: list[tuple[str, int]], shared: list[int]) -> tuple[str, int, int]:
    """(text, shared lines that the markup kept, unshared lines that the markup removed)."""
    template = set(shared)
    has = any(s == IN for _, s in page)
    kept = [t for i, (t, s) in enumerate(page) if s == IN or s == OPEN and not has and i not in template]
    return "\n".join(kept), sum(page[i][1] == IN for i in template), sum(s == GONE and i not in template for i, (_, s) in enumerate(page))


def runs(rows: Iterable[dict], edge: tuple = (None, None, None, None)) -> Iterator[tuple[dict, tuple | None, tuple | None]]:
    """Each run of pages of one host with equal marks, and (path, marks) of the host's page before it and after it.

    ``edge`` is what ``edges`` has for the range of the rows.
    """
    (before, first, last, after), run = edge, None
    for r in rows:
        near = run is not None and r["host"] == run["host"]
        if near and r["marks"] == run["marks"]:
            run["last"] = r["path"]
        else:
            if run:
                yield run, before, (r["path"], r["marks"]) if near else None
                before, first = (run["last"], run["marks"]) if near else None, None
            run = {"host": r["host"], "marks": r["marks"], "body": r["body"], "first": r["path"] if first is None else first, "last": r["path"], "pages": []}
        run["pages"].append((r["page_id"], r["url"], r["states"]))
    if run:
        yield {**run, "last": run["last"] if last is None else last}, before, after


def edges(ends: Iterable[tuple]) -> dict[int, tuple]:
    """For each range: (path, marks) of the page before its first run, the first path of that run and the last one of its last run, wherever they are, and the page after.

    ``ends`` has (part, host, marks, first path, last path) of the two first and two last runs of each range, in order.
    """
    whole: list[list] = []
    at: dict[int, list[int]] = {}
    for part, host, marks, first, last in ends:
        if whole and part not in at and whole[-1][:2] == [host, marks]:  # goes on from the range before
            whole[-1][3] = last
        else:
            whole.append([host, marks, first, last])
        at.setdefault(part, [len(whole) - 1, 0])[1] = len(whole) - 1
    out = {}
    for part, (i, j) in at.items():
        before = (whole[i - 1][3], whole[i - 1][1]) if i and whole[i - 1][0] == whole[i][0] else None
        after = (whole[j + 1][2], whole[j + 1][1]) if j + 1 < len(whole) and whole[j + 1][0] == whole[j][0] else None
        out[part] = before, whole[i][2], whole[j][3], after
    return out


PACKED = "page_id long, url string, host string, path string, part int, marks binary, states binary, body binary"
ENDS = "part int, nth int, host string, marks binary, first string, last string"
RESULT = "page_id long, url string, text string, n_chars long, n_lines int, n_shared int, n_restored int, n_removed int"


def extract(spark: SparkSession, pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row a page; n_lines text lines, n_shared of them shared with the neighbour, n_restored and n_removed what the markup decided otherwise."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    address = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    keyed = own.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    ends_schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("host", pa.string()), ("marks", pa.binary()), ("first", pa.string()), ("last", pa.string())])
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(MOST_RANGES, estimated(pages) // RANGE_BYTES))
    key = lambda h, p, k: (h, p, k is not None, k or 0)
    rate = min(SAMPLE * ranges, SAMPLED) / max(1, pages.count())
    sample = keyed.select("host", "path", "page_id").where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1 << 30)) < min(1.0, rate) * (1 << 30)).distinct().collect()
    sample = sorted(key(r.host, r.path, r.page_id) for r in sample)
    cuts = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []

    def pack(batches, whole=True):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in pieces(batch, "html"):
                ids, urls, hosts, paths, bodies = (c.to_pylist() for c in part.columns)
                split = [lines(h) for h in bodies]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:4],
                    pa.array([bisect.bisect_right(cuts, key(*k)) for k in zip(hosts, paths, ids)], pa.int32()),
                    pa.array([b"".join(xxhash.xxh64_digest(t.encode("utf-8", "replace")) for t, _ in s) for s in split], pa.binary()),
                    pa.array([bytes(st for _, st in s) if whole else b"" for s in split], pa.binary()),
                    pa.array([squeeze("\n".join(t for t, _ in s).encode("utf-8", "replace")) if whole else b"" for s in split], pa.binary()),
                ], ["page_id", "url", "host", "path", "part", "marks", "states", "body"])

    def ranged(batches):
        rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
        return itertools.groupby(rows, key=lambda r: r["part"])

    def bounds(batches):
        for part, rows in ranged(batches):
            head, tail = [], deque(maxlen=2)
            for run, _, _ in runs(rows):
                end = part, run["host"], run["marks"], run["first"], run["last"]
                (head if len(head) < 2 else tail).append(end)
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "nth", "host", "marks", "first", "last"), (e[0], n, *e[1:]))) for n, e in enumerate([*head, *tail])], schema=ends_schema)

    def align(batches):
        expand = zstandard.ZstdDecompressor().decompress

        def judged(run, before, after):
            near = [(len(commonprefix([n[0], path])), n[1]) for n, path in ((before, run["first"]), (after, run["last"])) if n]
            marks = np.frombuffer(run["marks"], "<u8").tolist()
            shared = common_lines(marks, np.frombuffer(max(near, key=lambda n: n[0])[1], "<u8").tolist()) if near else []
            body, last = expand(run["body"]).decode().split("\n") if marks else [], None
            for page_id, url, states in run["pages"]:
                if states != last:
                    last, (text, restored, removed) = states, main_text(list(zip(body, states, strict=True)), shared)
                yield page_id, url, text, len(text), len(marks), len(shared), restored, removed

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.int32()] * 4)))], ["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "n_restored", "n_removed"])

        out = []
        for row in (row for part, rows in ranged(batches) for found in runs(rows, beyond.value[part]) for row in judged(*found)):
            out.append(row)
            if sum(len(o[2]) for o in out[-64:]) > 1 << 22 or len(out) >= 1000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    small_batches(spark)
    order = ["part", "host", "path", F.col("page_id").asc_nulls_first(), "url", "marks"]
    light = keyed.mapInArrow(lambda batches: pack(batches, False), PACKED).repartitionById(ranges, "part").sortWithinPartitions(*order)
    ends = light.mapInArrow(bounds, ENDS).collect()  # four rows a range at most
    beyond = spark.sparkContext.broadcast(edges((r.part, r.host, bytes(r.marks), r.first, r.last) for r in sorted(ends, key=lambda r: (r.part, r.nth))))
    spread = keyed.mapInArrow(pack, PACKED).repartitionById(ranges, "part")
    return spread.sortWithinPartitions(*order).mapInArrow(align, RESULT)
