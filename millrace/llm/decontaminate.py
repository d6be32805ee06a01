"""Benchmark decontamination by an inverted index of the test items.

The items are indexed with BM25 impacts, scaled so that an item scores 1 against itself. Every passage of
every document (a window of twice the longest item, moved by half its length, so that each occurrence
lies whole in one) is a query for all items that reach the threshold. As in block-max WAND, a passage is
first held against the sum of its terms' largest impacts anywhere, then, block of items by block, against
the sum of their largest impacts in the block, which are kept for the blocks that a term occurs in; only blocks
that could reach the threshold are scored. Bounds and scores are taken for a batch of passages at once. What is
retrieved is then verified on the whole text: four fifths of the item's five-word shingles, and half of the
closing words (its answer), must be there; an item of fewer than five words must be there word for word.

Words are lower-cased (A-Z) and freed of punctuation. A benchmark beyond the bounded size of an index is
searched in parts, one pass over the documents a part, and only one part is on the driver and in the workers.

Cases: a null or empty text is clean; null or empty items are left out; equal items are each reported; an item
with a null id can't be reported, but removes documents; without items all is clean; repeated rows each get a
row; a very long text is many passages; an empty table gives an empty result; columns beside the id and text
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, map_text, texts

SHINGLE, OVERLAP = 5, 0.8
ANSWER, ANSWER_OVERLAP = 5, 0.5
#: Share of an item's own score that retrieves it.
THRESHOLD = 0.5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
#: Bytes of item text in one part of the index, which takes some twenty times that in a worker.
PART_BYTES = 4 << 20
PUNCTUATION = b".,;:!?\"'()[]{}|#$%&*<>"
#: Postings, and cells (passages x blocks), that are scored at once: they bound a worker's memory.
CELLS = 1 << 20


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().translate(None, PUNCTUATION).split() if raw else []


def shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def spread(row: np.ndarray, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every posting of each row's term; a term's postings begin at ``first``."""
    size = first[term + 1] - first[term]
    return np.repeat(row, size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[term], size)


def summed(key: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below ``size``), ascending, and the sums of their positive weights; memory is in proportion to the number of keys."""
    if size <= 4 * len(key):
        sums = np.bincount(key, weights=weight, minlength=size)
        keys = np.flatnonzero(sums)
        return keys, sums[keys]
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, weights=weight, minlength=len(keys))


class Index:
    """Postings by term, with the largest impact of each term anywhere and in each block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        items = [(k, w) for k, raw in items if (w := words_of(raw))]
        self.ids = np.array([k for k, _ in items], np.int64)
        self.words = [w for _, w in items]
        self.shingles = [shingles(w) for w in self.words]
        self.answers = [set(w[-ANSWER:]) for w in self.words]
        self.vocabulary: dict[bytes, int] = {}
        postings: list[list[tuple[int, float]]] = []
        counts = [Counter(w) for w in self.words]
        n, mean = len(items), sum(map(len, self.words)) / max(1, len(items))
        df = Counter(t for c in counts for t in c)
        for i, c in enumerate(counts):
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(self.words[i]) / mean)) for t, tf in c.items()}
            whole = sum(raw.values())
            for t, impact in raw.items():
                at = self.vocabulary.setdefault(t, len(postings))
                if at == len(postings):
                    postings.append([])
                postings[at].append((i, impact / whole))
        # One term more than there are, without postings: any word that no item has.
        sizes = np.array([*map(len, postings), 0])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.item = np.array([i for p in postings for i, _ in p], np.int64)
        self.impact = np.array([x for p in postings for _, x in p])
        self.blocks = -(-n // BLOCK_ITEMS)
        # Block maxima by term, for the blocks that the term occurs in; items ascend within a term.
        cell = np.repeat(np.arange(len(sizes)), sizes) * max(1, self.blocks) + self.item // BLOCK_ITEMS
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.block = cell[starts] % max(1, self.blocks)
        self.cell_first = np.append(starts, len(self.item))
        self.block_max = np.maximum.reduceat(self.impact, starts) if len(starts) else np.zeros(0)
        self.block_first = np.searchsorted(cell[starts], np.arange(len(sizes) + 1) * max(1, self.blocks))
        self.list_max = np.zeros(len(sizes))
        np.maximum.at(self.list_max, np.repeat(np.arange(len(sizes)), sizes), self.impact)
        self.window = 2 * max(map(len, self.words), default=1)

    def retrieve(self, docs: list[list[bytes]], threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(number of the text, number of the item, score) of all pairs where a passage reaches the threshold; the largest score of each."""
        if not self.blocks:
            return []
        get, other = self.vocabulary.get, len(self.first) - 2
        sizes = np.array([len(w) for w in docs], np.int64)
        terms = np.fromiter((t for w in docs for t in map(get, w, repeat(other))), np.int64, int(sizes.sum()))
        base = np.concatenate([[0], np.cumsum(sizes)])
        half = self.window // 2
        many = np.maximum(1, -(-(sizes - half) // half)) * (sizes > 0)
        owner = np.repeat(np.arange(len(docs)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = base[owner] + nth * half
        end = np.minimum(start + self.window, base[owner + 1])

        def total(of: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros(1, of.dtype), np.cumsum(of[terms])])
            return run[end] - run[start]

        least = threshold - 1e-9  # sums differ in their last digits
        able = np.flatnonzero(total(self.list_max) >= least)
        many = np.concatenate([[0], np.cumsum(np.maximum(total(np.diff(self.first))[able], self.blocks))])
        best: dict[tuple[int, int], float] = {}
        at, n = 0, len(self.ids)
        while at < len(able):
            stop = max(at + 1, int(np.searchsorted(many, many[at] + CELLS, side="right")) - 1)
            some, at = able[at:stop], stop
            width = end[some] - start[some]
            row = np.repeat(np.arange(len(some)), width)
            place = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width) + start[some][row]
            found = terms[place]
            row, found = row[found != other], found[found != other]
            key = np.unique(row * len(self.first) + found)  # a term counts once a passage
            row, term = key // len(self.first), key % len(self.first)
            of, posting = spread(row, term, self.block_first)
            cell = of * self.blocks + self.block[posting]
            reach = np.bincount(cell, weights=self.block_max[posting], minlength=len(some) * self.blocks) >= least
            use = reach[cell]
            of, posting = spread(of[use], posting[use], self.cell_first)  # the items of those blocks only
            pair, scores = summed(of * n + self.item[posting], self.impact[posting], len(some) * n)
            for k in np.flatnonzero(scores >= least).tolist():
                match = (int(owner[some[pair[k] // n]]), int(pair[k] % n))
                best[match] = max(best.get(match, 0.0), float(scores[k]))
        return [(d, i, s) for (d, i), s in sorted(best.items())]

    def verified(self, item: int, own: set[bytes], words: set[bytes]) -> bool:
        s, a = self.shingles[item], self.answers[item]
        return len(s & own) >= OVERLAP * len(s) and len(a & words) >= ANSWER_OVERLAP * len(a)

    def search(self, docs: list[bytes | None]) -> list[list[tuple[int, float]]]:
        """For each text, (item id, score) of the items that it holds."""
        split = [words_of(d) for d in docs]
        out: list[list[tuple[int, float]]] = [[] for _ in docs]
        last, own, words, run = -1, set(), set(), b""
        for d, i, score in self.retrieve(split):
            if d != last:
                last, own, words, run = d, shingles(split[d]), set(split[d]), b" %s " % b" ".join(split[d])
            if b" %s " % b" ".join(self.words[i]) in run if len(self.words[i]) < SHINGLE else self.verified(i, own, words):
                out[d].append((int(self.ids[i]), score))
        return out


def parts_of(items: DataFrame, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES, nameless: bool = False) -> tuple[DataFrame, int]:
    """(k, t, part) of the items that can be indexed, and the number of parts; with ``nameless``, items with a null id too (as 0)."""
    own = items.select(F.col(item_id).cast("long").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    own = own.fillna(0, "k") if nameless else own.where("k is not null")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = int(size // part_bytes + 1)
    return own.withColumn("part", F.pmod(F.xxhash64("k", "t"), F.lit(parts))), parts


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", part_bytes: int = PART_BYTES, nameless: bool = False) -> Iterator[tuple[Index, bool]]:
    """The benchmark in as many indexes of bounded text as it takes, one after another, and whether each is the last."""
    own, parts = parts_of(items, item_id, text, part_bytes, nameless)
    for p in range(parts):
        rows = own.where(F.col("part") == p).collect()  # about part_bytes
        yield Index(sorted((r.k, r.t.encode()) for r in rows)), p + 1 == parts


def by_part(spark: SparkSession, rows: DataFrame, items: DataFrame, one: Callable[[DataFrame, Broadcast, bool], DataFrame], part_bytes: int, nameless: bool = False) -> DataFrame:
    """``one`` applied for each index in turn; what a pass returns is written before the next one begins."""
    scratch, old = Scratch(spark, "leaks"), None
    for index, last in indexes(items, part_bytes=part_bytes, nameless=nameless):
        held = spark.sparkContext.broadcast(index)
        rows = one(rows, held, last)
        if not last:
            rows = scratch.save(rows, "pass")
            held.destroy()
            if old is not None:
                scratch.drop(old)
            old = rows
    return rows


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, items array<long>, score): the items that each document holds, ascending, and the best passage's score (0 for none)."""

    def one(rows: DataFrame, index: Broadcast, last: bool) -> DataFrame:
        def columns(batch: pa.RecordBatch) -> list:
            found = index.value.search(texts(batch.column(1)))
            held = [sorted([*old, *(k for k, _ in f)]) for old, f in zip(batch.column(2).to_pylist(), found, strict=True)]
            best = [max([old, *(s for _, s in f)]) for old, f in zip(batch.column(3).to_pylist(), found, strict=True)]
            return [batch.column(0), *([] if last else [batch.column(1)]), held, best]

        return map_text(rows, "text", f"doc_id long, {'' if last else 'text string, '}items array<long>, score double", columns, limit=2 << 20)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("score"))
    return by_part(spark, rows, items, one, part_bytes)


def remove_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no item."""

    def one(rows: DataFrame, index: Broadcast, last: bool) -> DataFrame:
        return keep_rows(rows, text, lambda column: [not f for f in index.value.search(texts(column))], limit=2 << 20)

    return by_part(spark, docs, items, one, part_bytes, nameless=True)
