"""Quality rules learned as a decision list over text statistics.

Sequential covering: a rule is grown condition by condition (a statistic over or under a threshold) by
information gain on one part of the labelled rows, pruned from its end on another part, and kept if it is
precise enough; the rows that it covers are set aside and the next rule is sought. The list is emitted as
one Spark conditional expression (``when ... when ... otherwise``) over the statistics' columns, so that
applying it needs no Python.

Cases: a null or empty text has all statistics 0 (and fails the base rule of 50 words); ratios over
nothing are 0; null labels are not learned from; equal labelled rows are learned from once; repeated rows each get a row; without labels, or with
labels of one class only, the list is empty and the base rule alone decides; an empty table gives an
empty result; columns beside the id and text columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_text, texts

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_distinct")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
#: Labelled rows that the list is learned from: about so many at most, chosen by hash at one rate.
FIT_ROWS = 20_000


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(ids) < 3:
        return 0
    if kinds < 1_000_000:
        windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:
        windows = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1] * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(len(windows), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(found)] |= found
    return int(inside.sum())


def text_counts(raw: bytes | None) -> tuple[int, ...]:
    """The statistics of a whole text, in the order of COUNTS."""
    if not raw:
        return (0,) * len(COUNTS)
    words = raw.split()
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = int(by_byte[:128].sum() + by_byte[192:].sum())  # bytes that begin a code point
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words), chars - int(by_byte[9:14].sum() + by_byte[32]), int(by_byte[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), _repeated(ids, len(kinds)),
        len(lines), int(by_byte[65:91].sum()), int(by_byte[97:123].sum()), int(by_byte[48:58].sum()), len(kinds),
    )


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, COUNTS...) of every whole text."""

    def columns(batch: pa.RecordBatch) -> list:
        found = [text_counts(t) for t in texts(batch.column(1))]
        return [batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*found))] if found else [batch.column(0), *([[]] * len(COUNTS))]

    return map_text(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", STATS, columns)


def features() -> dict[str, Column]:
    """What rules are about: shares, so that they hold at any length."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = {n: F.col(n) for n in COUNTS}
    return {
        "words": c["n_words"].cast("double"),
        "mean_word": share(c["word_chars"], c["n_words"]),
        "symbol_share": share(c["n_symbols"], c["n_words"]),
        "dup_line_share": share(c["n_dup_lines"], c["n_lines"]),
        "repeat_share": share(c["n_repeat_words"], c["n_words"]),
        "upper_share": share(c["n_upper"], c["n_upper"] + c["n_lower"]),
        "digit_share": share(c["n_digits"], c["word_chars"]),
        "distinct_share": share(c["n_distinct"], c["n_words"]),
        "words_a_line": share(c["n_words"], c["n_lines"]),
    }


@dataclass
class Rule:
    """All conditions hold: (feature, over?, threshold)."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, over, at in self.conditions:
            out &= x[name] > at if over else x[name] <= at
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, over, at in self.conditions:
            out = out & (F.col(name) > at if over else F.col(name) <= at)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>' if over else '<='} {at!r}" for n, over, at in self.conditions)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int, cuts: int) -> Rule:
    rule, inside = Rule(), np.ones(len(y), bool)
    while len(rule.conditions) < most and (p0 := int((y & inside).sum())) and (n0 := int((~y & inside).sum())):
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, v in x.items():
            own, pos = v[inside], y[inside]
            order = np.argsort(own, kind="stable")
            own, upto = own[order], np.cumsum(pos[order])
            ends = np.flatnonzero(own[1:] != own[:-1])  # a threshold between two values
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            for over in (False, True):
                p = (p0 - upto[ends]) if over else upto[ends]
                size = (len(own) - ends - 1) if over else ends + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / size) - base), -1.0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (name, over, float((own[ends[k]] + own[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside &= Rule([best[1]]).covers(x)
    return rule


def learn(x: dict[str, np.ndarray], y: np.ndarray, precision: float = 0.9, cover: int = 5, rules: int = 12, conditions: int = 3, cuts: int = 256) -> list[Rule]:
    """An ordered list of rules for the rows where ``y`` is true. Rows: in an order that has nothing to do with their contents."""
    out, left = [], np.ones(len(y), bool)
    part = np.arange(len(y)) % 3 == 2
    while len(out) < rules and y[left].any():
        grow, prune = left & ~part, left & part
        rule = _grow({k: v[grow] for k, v in x.items()}, y[grow], conditions, cuts)
        if not rule.conditions:
            break

        def worth(r: Rule) -> float:
            inside = r.covers(x) & prune
            p, n = int((y & inside).sum()), int((~y & inside).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule.conditions) > 1 and worth(Rule(rule.conditions[:-1])) >= worth(rule):
            rule.conditions.pop()
        inside = rule.covers(x)
        held, seen = inside & prune, inside & left
        p, n = int((y & seen).sum()), int((~y & seen).sum())
        if p < cover or p < precision * (p + n) or (held.any() and (y & held).sum() < precision * held.sum()):
            break
        out.append(rule)
        left &= ~inside
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: true keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> list[Rule]:
    """``stats`` has doc_id, COUNTS and features; ``label`` 0 marks what to reject."""
    known = labels.where(F.col(label).isNotNull()).select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y")).distinct()
    labelled = stats.join(known, stats["doc_id"] == known["k"]).select(F.xxhash64("k", "y", *COUNTS).alias("h"), "y", *features())
    rate = min(1.0, rows / max(1, labelled.count()))
    # Equal rows count once, so that about ``rows`` come to the driver whatever is repeated.
    sample = labelled.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).dropDuplicates(["h"]).toPandas().sort_values("h", kind="stable")
    if sample["y"].nunique() < 2:
        return []
    return learn({n: sample[n].to_numpy(float) for n in features()}, sample["y"].to_numpy() == 0)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(doc_id, COUNTS, features, base_failed, kept) and the learned list."""
    stats = Scratch(spark, "quality").save(statistics(docs, doc_id, text), "statistics").withColumns(features())
    rules = fit(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
