"""SimHash near-duplicate classes by tiled exact comparison.

A fingerprint has bit b set if over half of the document's shingle hashes have it. Distinct
fingerprints are dealt into tiles by the set-bit counts of their two halves; two tiles are compared
only if those counts differ by the radius or less in sum (a lower bound of the Hamming distance), by
numpy exclusive-or and bit counts. No candidate is sampled or capped, so every link is found. A work
unit returns a spanning forest of the links that it sees, never all pairs of a group.

The comparison is exact and therefore grows with the square of the number of *distinct*
fingerprints (exact copies are folded first); each fingerprint travels as eight bytes to the units
of its group. Memory of a unit is bounded by GROUP_MOST fingerprints a side.

Cases: a null or empty text has fingerprint zero, which links like any other; a null doc_id keeps its
row, and the class id is the least non-null id (null if there is none); repeated rows each get a row;
an empty table gives an empty result; columns beside the id and text columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_text, texts

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a group: two groups meet in a work unit. At least so many groups, if groups of GROUP_LEAST allow.
GROUP_LEAST, GROUP_MOST, GROUPS = 1024, 262_144, 24


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def columns(batch: pa.RecordBatch) -> list:
        fps = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
        return [batch.column(0), pa.array(fps)]

    return map_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "doc_id long, fp long", columns)


class Forest:
    """Union-find over positions; ``seen`` is a label that never joins two classes, only lags behind."""

    def __init__(self, n: int):
        self.parent, self.seen = list(range(n)), np.arange(n)

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(self.seen[others])
        mine = self.seen[i]
        if len(labels) == 1 and labels[0] == mine:
            return
        roots = {self.find(int(x)) for x in labels} | {self.find(int(mine)), self.find(i)}
        least = min(roots)
        for r in roots:
            self.parent[r] = least
        self.seen[others] = least
        self.seen[i] = least


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, block: tuple[int, int] = (256, 4096)) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between two sets of fingerprints, or within ``left``.

    Sets are cut into tiles of equal half counts; tiles further apart than the radius are skipped.
    """

    def tiled(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        hi, lo = np.bitwise_count(fps >> np.uint64(32)).astype(int), np.bitwise_count(fps & np.uint64(0xFFFFFFFF)).astype(int)
        order = np.argsort(hi * 64 + lo, kind="stable")
        key = (hi * 64 + lo)[order]
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        return fps[order], [(int(key[a]) // 64, int(key[a]) % 64, a, b) for a, b in zip(cuts, cuts[1:])]

    own = right is None
    left, tiles_l = tiled(left)
    right, tiles_r = (left, tiles_l) if own else tiled(right)
    shift = 0 if own else len(left)
    nodes = left if own else np.concatenate([left, right])
    found = Forest(len(nodes))
    rows, cols = block
    for k, (h1, l1, a1, b1) in enumerate(tiles_l):
        for h2, l2, a2, b2 in tiles_r[k:] if own else tiles_r:
            if abs(h1 - h2) + abs(l1 - l2) > radius:
                continue
            for i in range(a1, b1, rows):
                x = left[i : min(i + rows, b1), None]
                for j in range(max(a2, i) if own and a1 == a2 else a2, b2, cols):
                    near = np.bitwise_count(x ^ right[None, j : min(j + cols, b2)]) <= radius
                    if own and a1 == a2:  # a fingerprint always meets itself there
                        hits = np.flatnonzero(near.sum(axis=1) > (np.arange(i, i + len(x)) >= j))
                    else:
                        hits = np.flatnonzero(near.any(axis=1))
                    for r in hits.tolist():
                        found.link(i + r, np.flatnonzero(near[r]) + j + shift)
    root = np.array([found.find(i) for i in range(len(nodes))], dtype=np.int64) if len(nodes) else np.zeros(0, np.int64)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def deal(cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(hi, lo, first group, groups) from the count of each cell (bits set in the high half, in the low half)."""
    total = sum(c for _, _, c in cells)
    most = max(GROUP_LEAST, min(GROUP_MOST, math.ceil(total / GROUPS)))
    routes, groups, at, room = [], 0, -1, 0
    for hi, lo, count in sorted(cells, key=lambda c: (c[0] + c[1], c[0])):
        if count > most:
            parts = math.ceil(count / most)
            routes.append((hi, lo, groups, parts))
            groups, room = groups + parts, 0
            continue
        if room < count:
            at, room, groups = groups, most, groups + 1
        routes.append((hi, lo, at, 1))
        room -= count
    return routes


def near_ranges(routes: list[tuple[int, int, int, int]], radius: int) -> list[tuple[int, int, int, int]]:
    """(first group, groups, first group, groups) of each two cells that may hold links: some 45,000 rows at most, however many groups there are."""
    held = {(hi, lo): (first, parts) for hi, lo, first, parts in routes}
    steps = [(h, l) for h in range(-radius, radius + 1) for l in range(-radius, radius + 1) if abs(h) + abs(l) <= radius]
    return sorted({min(own + held[c], held[c] + own) for (hi, lo), own in held.items() for h, l in steps if (c := (hi + h, lo + l)) in held})


def pair_table(spark: SparkSession, ranges: list[tuple[int, int, int, int]]) -> DataFrame:
    """(g, k), g <= k: the groups to compare. Their number grows with the square of the groups, so they are made in Spark."""
    each = lambda first, parts: F.explode(F.sequence(F.col(first), F.col(first) + F.col(parts) - 1))
    both = spark.createDataFrame(ranges, "a long, n long, b long, m long").select(each("a", "n").alias("x"), "b", "m").select("x", each("b", "m").alias("y"))
    return both.select(F.least("x", "y").alias("g"), F.greatest("x", "y").alias("k")).distinct()


def links(spark: SparkSession, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Spanning edges (a, b) between distinct fingerprints at ``radius`` or fewer differing bits. ``fps`` is a written table (fp)."""
    hi, lo = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = [(r.hi, r.lo, r.n) for r in fps.groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count(F.lit(1)).alias("n")).collect()]  # 33 x 33 at most
    routes = deal(cells)
    if not routes:
        return spark.createDataFrame([], "a long, b long")
    route = spark.createDataFrame(routes, "hi int, lo int, first long, parts long")
    pairs = pair_table(spark, near_ranges(routes, radius))
    side = lambda c, n: F.struct(F.col(c).alias("grp"), "g", "k", F.lit(n).alias("side"))
    where = pairs.select(F.inline(F.when(F.col("g") == F.col("k"), F.array(side("g", 0))).otherwise(F.array(side("g", 0), side("k", 1)))))
    dealt = (
        fps.select("fp", hi.cast("int").alias("hi"), lo.cast("int").alias("lo"))
        .join(F.broadcast(route), ["hi", "lo"])  # 33 x 33 rows at most
        .select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).alias("grp"))
        .join(where, "grp")  # small or large: left to Spark's threshold
        .select("g", "k", "side", "fp")
    )

    def compare(unit: pa.Table) -> pa.Table:
        fp, side = np.asarray(unit["fp"]).view(np.uint64), np.asarray(unit["side"])
        a, b = forest(fp[side == 0], fp[side == 1] if (side == 1).any() else None, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.repartition(min(pairs.count(), 2000), "g", "k").groupBy("g", "k").applyInArrow(compare, "a long, b long")


def stars(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of written edges (a, b): (node, root) for each node that isn't its component's least.

    Alternates large-star and small-star steps until the edges stand still; each step folds by
    partial minima, so a node of very high degree costs one row a task.
    """

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while (now := mark(edges)) != before:
        before, old = now, edges
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, both["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        edges = (
            large.join(small, large["a"] == small["u"])
            .select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))))
            .where("a <> b")
            .distinct()
        )
        edges = scratch.save(edges, "stars")
        scratch.drop(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def members(spark: SparkSession, scratch: Scratch, marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, first, root): of each distinct fingerprint the least id and the class. ``marked`` is a written table (doc_id, fp)."""
    fps = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = scratch.save(links(spark, fps.select("fp"), radius), "links")
    root = stars(scratch, edges)
    return fps.join(root, fps["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``."""
    scratch = Scratch(spark, "simhash")
    marked = scratch.save(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    member = members(spark, scratch, marked, radius)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = member.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` (all columns) of each class.

    It is the row of the least id (a null id comes last), then of the least fingerprint, text and other
    columns. What goes is the smaller part, so its ids are joined, not those that stay. Rows whose id is
    null or occurs more than once are settled by id and fingerprint, and folded before they move.
    """
    scratch = Scratch(spark, "simhash-kept")
    marked = scratch.save(fingerprints(docs, doc_id, text), "fingerprints")
    least = members(spark, scratch, marked).groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("least"))
    stay = scratch.save(least.select(F.col("least.first").alias("__id"), F.col("least.fp").alias("__fp")), "stay")
    known = marked.where("doc_id is not null")
    gone = scratch.save(known.join(stay, (known["doc_id"] == stay["__id"]) & (known["fp"] == stay["__fp"]), "left_anti").select(F.col("doc_id").alias("__gone")), "gone")
    vague = scratch.save(marked.groupBy(F.col("doc_id").alias("__vague")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or __vague is null").select("__vague"), "vague")
    if vague.isEmpty():
        return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
    once = docs.where(docs[doc_id].isNotNull())
    once = once.join(vague, once[doc_id] == vague["__vague"], "left_anti")
    once = once.join(gone, once[doc_id] == gone["__gone"], "left_anti")

    @F.pandas_udf("long")
    def own(column: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode() if t is not None else None) for t in column], dtype=np.uint64).view(np.int64))

    some = docs.join(vague, docs[doc_id] == vague["__vague"], "left_semi").unionByName(docs.where(docs[doc_id].isNull()))
    order = F.struct(F.col(text), F.to_json(F.struct(*(c for c in docs.columns if c != text))))
    some = some.withColumn("__own", own(F.col(text))).groupBy(F.col(doc_id).alias("__key"), "__own").agg(F.min_by(F.struct(*docs.columns), order).alias("__row"))
    some = some.join(stay, (some["__own"] == stay["__fp"]) & some["__key"].eqNullSafe(stay["__id"]), "left_semi")
    return once.unionByName(some.select("__row.*"))
