"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else counts as a space, and n-grams of two and three characters hash
into a fixed number of buckets. The log-probability matrix (buckets x languages) is broadcast; a batch of
texts is scored at once in numpy as a sparse product: rows of the matrix are gathered by n-gram and summed
by text. Whole texts are scored, in blocks of bounded size.

The model has a column of 256 KB a language, on the driver and in each worker.

Cases: a null text, or one without a letter, is ``und`` with score 0; equal likelihoods go to the first
language by code point; null languages are not learned from; with nothing to learn from, all is ``und``;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, map_text, small_batches

BUCKETS = 1 << 16
ORDERS = (2, 3)
SMOOTH = 0.1
#: Documents of each language that the model is fitted on at most (those of the least id hashes).
FIT_ROWS = 4_000
#: Characters of a long text that are hashed at once, and numbers of the matrix that are gathered at once.
BLOCK, CELLS = 1 << 18, 1 << 20
#: Languages whose rates (some bytes each) are broadcast at most.
BROADCAST_LANGUAGES = 100_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()[0])
    return out


def _hashed(chars: np.ndarray, n: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of the first ``starts`` places begin an n-gram without two spaces in a row, the buckets of those that do)."""
    size = max(0, min(len(chars) - n + 1, starts))
    space = chars == 32
    double = space[:-1] & space[1:]
    value, good = np.full(size, n, np.uint32), np.ones(size, bool)
    for k in range(n):
        value = value * np.uint32(0x01000193) ^ chars[k : k + size]
        if k:
            good &= ~double[k - 1 : k - 1 + size]
    return good, ((value[good] * np.uint32(2654435761)) >> np.uint32(32 - 16)).astype(np.int64)


def _chars(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def grams(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of the text) of every n-gram, order by order, and which texts have a letter."""
    chars = _chars("\n" + "".join(f"{t or ''}\n\n" for t in batch))
    # A text owns the separator before it and the first one after it.
    owner = np.repeat(np.arange(len(batch)), [len(t or "") + 2 for t in batch])
    owner = np.append(owner, owner[-1:])
    has = np.bincount(owner[chars != 32], minlength=len(batch)) > 0
    found = [_hashed(chars, n, len(chars)) for n in ORDERS]
    return np.concatenate([b for _, b in found]), np.concatenate([owner[: len(good)][good] for good, _ in found]), has


def _window(text: str, start: int, stop: int) -> np.ndarray:
    """The characters from ``start`` to ``stop`` of the text with a separator on both sides."""
    return _chars(("\n" if start == 0 else "") + text[max(start - 1, 0) : stop - 1] + ("\n" if stop == len(text) + 2 else ""))


def _long_score(text: str, weights: np.ndarray) -> tuple[np.ndarray, bool]:
    """The same for one long text, a block of characters at a time."""
    out, has, most = np.zeros(weights.shape[1]), False, max(ORDERS)
    padded = len(text) + 2
    for at in range(0, padded, BLOCK):
        chars = _window(text, at, min(at + BLOCK + most - 1, padded))
        has = has or bool((chars != 32).any())
        for n in ORDERS:
            _, bucket = _hashed(chars, n, BLOCK)
            step = max(1, CELLS // max(1, weights.shape[1]))
            for k in range(0, len(bucket), step):
                out += weights[bucket[k : k + step]].sum(axis=0, dtype=np.float64)
    return out, has


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of one text, a block of characters at a time."""
    most, padded = max(ORDERS), len(text or "") + 2
    for at in range(0, padded, BLOCK):
        chars = _window(text or "", at, min(at + BLOCK + most - 1, padded))
        for n in ORDERS:
            yield _hashed(chars, n, BLOCK)[1]


def score(batch: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihoods by text and language, which texts have a letter)."""
    long = [k for k, t in enumerate(batch) if t is not None and len(t) > BLOCK]
    bucket, owner, has = grams([None if t is not None and len(t) > BLOCK else t for t in batch])
    out = np.zeros((len(batch), weights.shape[1]))
    order_cuts = np.flatnonzero(np.diff(owner) < 0) + 1  # owners ascend within an order
    cuts = np.unique(np.concatenate([[0], order_cuts, np.arange(0, len(owner), max(1, CELLS // max(1, weights.shape[1]))), [len(owner)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = owner[a:b]
        first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        out[own[first]] += np.add.reduceat(weights[bucket[a:b]], first, axis=0)
    for k in long:
        out[k], has[k] = _long_score(batch[k], weights)
    return out, has


def fit(docs: DataFrame, use: Column, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities, from ``rows`` documents a language that ``use`` allows."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(use & F.col("lang").isNotNull())
    share = [(r.lang, min(1.0, rows / r.n)) for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row a language
    languages = sorted(s for s, _ in share)
    if not languages:
        return [], np.zeros((BUCKETS, 0), np.float32)
    rate = docs.sparkSession.createDataFrame(share, "lang string, rate double")
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    rate = F.broadcast(rate) if len(share) <= BROADCAST_LANGUAGES else rate
    sample = own.withColumn("hashed", hashed).where(F.col("hashed") < max(r for _, r in share)).join(rate, "lang").where(F.col("hashed") < F.col("rate")).select("lang", "text")

    def count(batches):
        """A row a language; the rows come language by language."""
        language, table, held, size = None, np.zeros(BUCKETS), [], 0

        def fold():
            nonlocal size
            if held:
                np.add(table, np.bincount(np.concatenate(held), minlength=BUCKETS), out=table)
                held.clear()
                size = 0

        def made():
            fold()
            return pa.RecordBatch.from_arrays([pa.array([language], pa.string()), pa.array([table.astype("<f4").tobytes()], pa.binary())], ["lang", "counts"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != language:
                    if language is not None:
                        yield made()
                    language, table = name, np.zeros(BUCKETS)
                for found in buckets(text.as_py()):
                    held.append(found)
                    size += len(found)
                    if size > CELLS:
                        fold()
        if language is not None:
            yield made()

    small_batches(docs.sparkSession)
    found = {r.lang: r.counts for r in sample.repartition("lang").sortWithinPartitions("lang").mapInArrow(count, "lang string, counts binary").collect()}  # the model's size
    counts = np.array([np.frombuffer(found[s], "<f4").astype(float) if s in found else np.zeros(BUCKETS) for s in languages]) + SMOOTH
    return languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32))


def predict(spark: SparkSession, docs: DataFrame, languages: list[str], weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the posterior under equal priors."""
    model = spark.sparkContext.broadcast(weights)  # BUCKETS x languages

    def columns(batch: pa.RecordBatch) -> list:
        given = batch.column(1).to_pylist()
        if not languages:
            return [batch.column(0), [UNKNOWN] * len(given), [0.0] * len(given)]
        likely, has = score(given, model.value)
        top = likely.argmax(axis=1)
        sure = 1 / np.exp(likely - likely.max(axis=1, keepdims=True)).sum(axis=1)
        return [batch.column(0), [languages[k] if h else UNKNOWN for k, h in zip(top.tolist(), has.tolist())], np.where(has, sure, 0.0)]

    return map_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "doc_id long, lang_pred string, score double", columns, limit=1 << 20)


def keep_known(spark: SparkSession, docs: DataFrame, languages: list[str], weights: np.ndarray, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language with a posterior of ``least`` or more."""
    model = spark.sparkContext.broadcast(weights)

    def known(column: pa.Array) -> list[bool]:
        given = column.to_pylist()
        if not languages:
            return [False] * len(given)
        likely, has = score(given, model.value)
        return (has & (1 / np.exp(likely - likely.max(axis=1, keepdims=True)).sum(axis=1) >= least)).tolist()

    return keep_rows(docs, text, known, limit=1 << 20)
