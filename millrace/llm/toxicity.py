"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the toxic texts and one on the ordinary texts of the labelled
rows, each by the library's trainer and without a look at the other class. A window (a word; long words are
cut into overlapping windows) is compressed with both, and the bytes that the toxic dictionary saves are its
gain. How many windows of a text reach each gain threshold is turned into a score by logistic regression,
shifted so that the cut that separates held-out labelled rows best (by F1) is the score CUT.

Toxic texts are mostly ordinary language, so the toxic dictionary also holds ordinary words that are missing
in the other. Training on the ordinary texts therefore goes on for some rounds: of the ordinary windows that
the toxic dictionary still compresses better, those that matter most are added to the ordinary dictionary.
Each window stands between fixed bytes that both dictionaries hold, since zstandard neither compresses very
short inputs nor finds matches in their last bytes. The calibration sees gains by dictionaries that were
trained without the rows in question. The folds are trained as tasks; the driver gets counts and dictionaries.

Cases: a null or empty text has no windows and gets the score of a text without any gain; null labels, ids
and texts are not learned from; equal labelled rows are learned from once; without labels of both kinds every
score is 0; repeated rows each get a row; a very long text is scored whole, a slice of its words at a time; an
empty table gives an empty result; columns beside the id and text columns are ignored.
"""

from __future__ import annotations

import contextlib
import functools
import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_text, texts

#: Labelled rows that are learned from at most, and bytes of their texts: about so many, chosen by hash at one rate.
FIT_ROWS, FIT_BYTES = 10_000, 32 << 20
#: Parts of the labelled rows that are scored by dictionaries of the other parts.
FOLDS = 5
#: Bytes of a window, and of the step between windows of a long word.
WINDOW, STEP = 48, 24
#: Size of the toxic dictionary and the trainer's segment and match lengths; the same of the ordinary one.
TOXIC, ORDINARY = (24_576, 16, 8), (112_640, 24, 8)
#: A dictionary is no larger than its samples divided by this, so that it holds what they have in common.
SPARSE = 8
#: Rounds of training on ordinary windows that the toxic dictionary compresses better, and bytes that a round adds.
ROUNDS, ROUND_BYTES = 3, 32_768
#: Gains that count as thresholds; of the lower ones the share of the windows counts too.
GAINS, SHARES = (2, 3, 4, 5, 6, 7, 8), 4
#: Words (none longer than a window) whose gain a worker keeps: some 50 MB; others are compressed again.
CACHE_WORDS = 400_000
#: The score from which a text counts as toxic.
CUT = 0.7
BEFORE, AFTER = bytes(range(1, 9)) + bytes(range(14, 30)), bytes(range(128, 152))


def _compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=18, hash_log=17, chain_log=17, search_log=6, target_length=16, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    trained = zstandard.ZstdCompressionDict(content + AFTER + BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=trained).compress


class Gains(dict):
    """Word to gain: what the toxic dictionary saves, in bytes, at the word's best window."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.other = _compressor(ordinary), _compressor(toxic)

    def __missing__(self, word: bytes) -> int:
        whole = b" " + word + b" "
        gain = 0
        for at in range(0, max(1, len(whole) - STEP), STEP) if len(whole) > WINDOW else (0,):
            window = BEFORE + whole[at : at + WINDOW] + AFTER
            gain = max(gain, len(self.plain(window)) - len(self.other(window)))
        if len(self) < CACHE_WORDS and len(whole) <= WINDOW:
            self[word] = gain
        return gain


def shaped(counts: np.ndarray) -> np.ndarray:
    """From the number of words and the words that reach each threshold: what the score depends on."""
    words, hits = counts[:, :1], counts[:, 1:]
    return np.column_stack([np.log1p(hits), 100 * hits[:, :SHARES] / (words + 50), np.log1p(words), np.ones(len(counts))])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(shaped(counts) @ np.array(self.weights))))


@functools.lru_cache(maxsize=4)
def gains(ordinary: bytes, toxic: bytes) -> Gains:
    """One for each Python worker, kept from task to task."""
    return Gains(ordinary, toxic)


def reached(raw: bytes | None, found: Gains) -> list[int]:
    """The number of words of a whole text, and of those that reach each of GAINS."""
    if not raw:
        return [0] * (1 + len(GAINS))
    words, by_gain = raw.lower().split(), np.zeros(GAINS[-1] + 1, np.int64)
    for at in range(0, len(words), 1 << 16):
        part = words[at : at + (1 << 16)]
        by_gain += np.bincount(np.clip(np.fromiter(map(found.__getitem__, part), np.int64, len(part)), 0, GAINS[-1]), minlength=GAINS[-1] + 1)
    upto = by_gain[::-1].cumsum()[::-1]
    return [int(upto[0]), *(int(upto[g]) for g in GAINS)]


def dictionary(samples: list[bytes], size: int, segment: int, match: int) -> bytes:
    """What the library's trainer makes of the samples, ``size`` or a SPARSE-th of them; their last bytes, if they are too few to train on."""
    size = min(size, sum(map(len, samples)) // SPARSE)
    with contextlib.suppress(zstandard.ZstdError):
        return zstandard.train_dictionary(max(size, 256), samples, k=segment, d=match, level=19).as_bytes()
    return b" ".join([b"", *samples, b""])[-max(size, 256) :]


def train(rows: list[tuple[bytes, bool]]) -> tuple[bytes, bytes]:
    """(ordinary dictionary, toxic dictionary) from (text, toxic) rows."""
    split: dict[bool, list[bytes]] = {True: [], False: []}
    seen: Counter = Counter()
    for raw, toxic in rows:
        words = raw.lower().split()
        if words:
            split[toxic].append(b" ".join(words))
        if not toxic:
            seen.update(set(words))
    ordinary, toxic = dictionary(split[False], *ORDINARY), dictionary(split[True], *TOXIC)
    often = [(w, n) for w, n in seen.items() if n > 1 and len(w) < WINDOW]
    for _ in range(ROUNDS):
        found = Gains(ordinary, toxic)
        wrong = sorted((-found[w] * n, w) for w, n in often if found[w] >= GAINS[0])
        if not wrong:
            break
        added = b" ".join(w for _, w in wrong)[:ROUND_BYTES].split(b" ")  # by what they would cost, best first
        ordinary = b" " + b" ".join(reversed(added)) + b" " + ordinary
    return ordinary, toxic


def calibrate(counts: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = shaped(counts).astype(float)
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - ridge * w)
    return tuple(float(v) for v in w)


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The value between two of ``z`` from which calling a row toxic has the best F1; the highest of equal ones."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    ends = np.append(z[1:] != z[:-1], True)
    k = int(np.where(ends, f1, -1.0).argmax())
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 1)) / 2)


def both(rows: Iterable[tuple[bytes, bool]]) -> bool:
    return len({toxic for _, toxic in rows}) == 2


TRAINED = "toxic_row boolean, counts array<long>, ordinary binary, toxic binary"


def fold(rows: list[tuple[bytes, bool]], own: list[tuple[bytes, bool]]) -> list[tuple]:
    """TRAINED rows: the dictionaries of ``rows``, or, where there are own ones, the counts of these by them."""
    if not both(rows):
        return []
    ordinary, toxic = train(rows)
    if not own:
        return [(None, None, ordinary, toxic)]
    found = Gains(ordinary, toxic)
    return [(y, reached(raw, found), None, None) for raw, y in own]


def model_of(trained: list[tuple]) -> Model | None:
    """From the TRAINED rows of all folds and of all rows together; none without both kinds of label."""
    held = [(y, c) for y, c, _, _ in trained if c is not None]
    whole = [(o, t) for _, _, o, t in trained if o is not None]
    if not whole or len({y for y, _ in held}) < 2:
        return None
    ordinary, toxic = whole[0]
    counts, y = np.array([c for _, c in held], float), np.array([y for y, _ in held], float)
    *weights, base = calibrate(counts, y)
    base += math.log(CUT / (1 - CUT)) - best_cut(shaped(counts) @ np.array([*weights, base]), y)
    return Model(bytes(ordinary), bytes(toxic), (*weights, base))


def learn(rows: list[tuple[bytes, bool]]) -> Model | None:
    """Here and now, from (text, toxic) rows in an order that has nothing to do with their contents."""
    parts = [rows[k::FOLDS] for k in range(FOLDS)]
    trained = [t for k, part in enumerate(parts) if part for t in fold([r for j, p in enumerate(parts) if j != k for r in p], part)]
    return model_of(trained + fold(rows, []))


def fit(docs: DataFrame, labels: DataFrame, use: Column, rows: int = FIT_ROWS, size: int = FIT_BYTES, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """From labelled rows that ``use`` (over doc_id) allows: about ``rows`` of them, and about ``size`` bytes, at most."""
    known = labels.select(F.col(doc_id).alias("doc_id"), (F.col(label).cast("int") == 1).alias("y")).where(use & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    n, total = own.select("doc_id", F.octet_length("text").alias("size")).join(known, "doc_id").agg(F.count(F.lit(1)), F.sum("size")).first()
    rate = min(1.0, rows / max(1, n), size / max(1, total or 0))
    sample = own.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).join(known, "doc_id").select("h", "text", "y").dropDuplicates(["h", "y"])
    sample = Scratch(docs.sparkSession, "toxicity").save(sample.withColumn("fold", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(FOLDS)).cast("int")), "sample")

    def trained(group: pa.Table) -> pa.Table:
        order = group.sort_by([("h", "ascending"), ("y", "ascending")])
        run, given = order["run"][0].as_py(), list(zip(texts(order["text"].combine_chunks()), order["y"].to_pylist(), order["fold"].to_pylist(), strict=True))
        own = [(t, y) for t, y, f in given if f == run]
        out = fold([(t, y) for t, y, f in given if f != run], own) if own or run == FOLDS else []
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], ["toxic_row", "counts", "ordinary", "toxic"])

    # One task a fold, and one for all rows; each sees the bounded sample.
    runs = sample.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).repartitionById(FOLDS + 1, "run")
    return model_of([tuple(r) for r in runs.groupBy("run").applyInArrow(trained, TRAINED).collect()])


def predict(spark: SparkSession, docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_hits): n_hits counts the words that reach the middle threshold."""
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size, some 230 kB

    def columns(batch: pa.RecordBatch) -> list:
        if (m := sent.value) is None:
            return [batch.column(0), [0.0] * batch.num_rows, [0] * batch.num_rows]
        found = gains(m.ordinary, m.toxic)
        counts = np.array([reached(t, found) for t in texts(batch.column(1))], float).reshape(-1, 1 + len(GAINS))
        return [batch.column(0), m.score(counts), counts[:, 1 + len(GAINS) // 2].astype(np.int64)]

    return map_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "doc_id long, score double, n_hits long", columns)
