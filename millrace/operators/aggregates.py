"""Aggregates by key, by epoch and by count, and the statistics built on them.

Groups are global (the reference groups what one worker has, and its users exchange by key first).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import lag_rows, number_rows, running_sum
from .folds import fold_ordered

WARM_UP, WINDOW_ROWS = 20, 10


def aggregate(df: DataFrame, key: Sequence[str], count: int, order: str, ties: Sequence[str] = (), **aggs: Column) -> DataFrame:
    """Every ``count`` rows of a key, in order, make one group; a group that isn't full never shows. Adds the group's number as ``chunk``."""
    numbered = number_rows(df, order, by=key, ties=ties, out="__rn")
    chunk = F.floor((F.col("__rn") - 1) / count).cast("long")
    grouped = numbered.groupBy(*key, chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("__n"), *(c.alias(n) for n, c in aggs.items()))
    return grouped.where(F.col("__n") == count).drop("__n")


def counted_aggregate(df: DataFrame, key: Sequence[str], count: str, order: Sequence[str], agg: Callable[[list[dict]], dict], schema: str) -> DataFrame:
    """The same with the count in the data: a key's rows gather until there are as many as the current row's ``count`` says."""

    def step(rows, row):
        rows.append(row)
        return ([], [agg(rows)]) if len(rows) == row[count] else (rows, [])

    return fold_ordered(df, key, order, list, step, schema)


def timestamp_aggregate(df: DataFrame, key: Sequence[str], epoch: str = "epoch", **aggs: Column) -> DataFrame:
    """One group for each epoch and key."""
    return df.groupBy(epoch, *key).agg(*(c.alias(n) for n, c in aggs.items()))


timestamp_incremental_aggregate = keyed_aggregate = timestamp_aggregate


def incremental_aggregate(df: DataFrame, key: Sequence[str], order: Sequence[str], start: Callable[[], Any], fold: Callable[[Any, dict], tuple[Any, bool]], emit: Callable[[tuple, Any], dict], schema: str) -> DataFrame:
    """Folds a key's rows in order; when ``fold`` says so, emits and starts anew."""

    def step(state, row):
        state, full = fold(state, row)
        return (start(), [emit(tuple(row[k] for k in key), state)]) if full else (state, [])

    return fold_ordered(df, key, order, start, step, schema)


def state_machine(df: DataFrame, key: Sequence[str], order: Sequence[str], start: Callable[[], Any], fold: Callable[[Any, dict], tuple[bool, Any, Iterable[dict]]], schema: str) -> DataFrame:
    """Keyed state over all epochs in order; ``fold`` says whether to drop the state, the state, and what to emit."""

    def step(state, row):
        drop, state, out = fold(state, row)
        return (start() if drop else state), out

    return fold_ordered(df, key, order, start, step, schema)


def running_totals(df: DataFrame, value: str, order: str, key: Sequence[str], ties: Sequence[str] = (), out: str = "total") -> DataFrame:
    """The state machine that sums, as columns."""
    return running_sum(df, value, order, by=key, ties=ties, out=out)


def accumulate(df: DataFrame, start: Column, merge: Callable[[Column, Column], Column], value: Column, epoch: str = "epoch", order: Column | None = None, out: str = "value") -> DataFrame:
    """A fold over each epoch's values, ordered by ``order``. For sums, counts and extremes use ``timestamp_aggregate``: it never gathers."""
    items = F.sort_array(F.collect_list(F.struct((order if order is not None else value).alias("o"), value.alias("v"))))
    return df.groupBy(epoch).agg(F.aggregate(items, start, lambda a, x: merge(a, x["v"])).alias(out))


def count(df: DataFrame, epoch: str = "epoch", out: str = "n") -> DataFrame:
    return df.groupBy(epoch).agg(F.count(F.lit(1)).alias(out))


def distinct(df: DataFrame, *columns: str, epoch: str = "epoch") -> DataFrame:
    """The values that are new in their epoch."""
    return df.select(epoch, *columns).distinct()


def word_totals(df: DataFrame, word: str, diff: str, epoch: str = "epoch") -> DataFrame:
    """(word, epoch, total): the running signed count at each epoch that changes it."""
    changes = df.groupBy(word, epoch).agg(F.sum(diff).alias("__d"))
    return running_sum(changes, "__d", epoch, by=[word], out="total").select(word, epoch, "total")


def latency_histogram(df: DataFrame, latency: str, low_bits: int = 5) -> DataFrame:
    """(high, low, n): by the highest bit and the next ``low_bits`` bits."""
    x = F.col(latency).cast("long")
    high = (F.length(F.bin(x)) - 1).cast("int")
    low = F.when(high >= low_bits, F.expr(f"shiftright({latency}, greatest(length(bin({latency})) - 1 - {low_bits}, 0))").bitwiseAND(F.lit((1 << low_bits) - 1))).otherwise(x.bitwiseAND(F.lit((1 << low_bits) - 1)))
    return df.where(x > 0).groupBy(high.alias("high"), low.cast("int").alias("low")).agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, key: Sequence[str], item: str, position: str, out: str = "items") -> DataFrame:
    """Per key (item, count) pairs, the most frequent first, equal ones by first occurrence."""
    counted = df.groupBy(*key, item).agg(F.count(F.lit(1)).alias("__n"), F.min(position).alias("__p"))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__p").alias("p"), F.col(item).alias("i"))))
    return counted.groupBy(*key).agg(F.transform(pairs, lambda x: F.struct(x["i"].alias("item"), (-x["n"]).alias("count"))).alias(out))


def top_items(df: DataFrame, item: str, n: int) -> DataFrame:
    """(item, n): by count, equal ones by item, both descending."""
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc(item)).limit(n)


def _named(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def percentiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., p10, ...): exact, linearly interpolated percentiles of each group, or of the whole table.

    Equal values are counted first, and the counts are summed up in order over the cluster: no task holds a
    group's values. Nulls don't count; a group without values has nulls.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    upto = running_sum(counts, "__n", "__v", by=by, out="__upto")
    if by:
        total = counts.groupBy(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by))).agg(F.sum("__n").alias("__all"))
        on = F.lit(True)
        for i, c in enumerate(by):
            on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
        ranked = upto.join(total, on)
    else:
        ranked = upto.withColumn("__all", F.lit(counts.agg(F.sum("__n")).first()[0]).cast("long"))
    place = [F.lit(float(p)) * (F.col("__all") - 1) for p in at]
    ends = [F.min(F.when(F.col("__upto") > f(h), F.col("__v"))).alias(f"__{n}{k}") for k, h in enumerate(place) for n, f in (("l", F.floor), ("h", F.ceil))]
    found = ranked.groupBy(*by).agg(F.max("__all").alias("__all"), *ends)
    return found.select(*by, *((F.col(f"__l{k}") + (F.col(f"__h{k}") - F.col(f"__l{k}")) * (h - F.floor(h))).alias(_named(p)) for k, (p, h) in enumerate(zip(at, place))))


def _moments(value: Column) -> list[Column]:
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def profile(df: DataFrame, value: str, by: Sequence[str] = (), at: Sequence[float] = (0.1, 0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """(by..., mean, std, min, max, p10, ...): mean, population deviation, extremes and exact percentiles of each group."""
    ends = percentiles(df, value, at, by)
    if not by:
        found = ends.first()
        return df.agg(*_moments(F.col(value)), *(F.lit(found[c]).cast("double").alias(c) for c in ends.columns))
    renamed = ends.select(*(F.col(c).alias(f"__r{i}") for i, c in enumerate(by)), *(c for c in ends.columns if c not in by))
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__r{i}"))
    return df.groupBy(*by).agg(*_moments(F.col(value))).join(renamed, on, "left").drop(*(f"__r{i}" for i in range(len(by))))


def approximate_profile(value: Column, at: Sequence[float] = (0.1, 0.5, 0.75, 0.9, 0.95, 0.99), accuracy: int = 10_000) -> list[Column]:
    """The same as columns to aggregate, percentiles from a bounded sketch."""
    return _moments(value) + [F.percentile_approx(value, p, accuracy).alias(_named(p)) for p in at]


def message_sizes(df: DataFrame, size: str, by: Sequence[str] = ()) -> DataFrame:
    """``profile`` of sizes in bytes, in KB, with the median."""
    return profile(df.withColumn(size, F.col(size) / 1024.0), size, by).withColumn("median", F.col("p50"))


def latencies(df: DataFrame, value_ns: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles in milliseconds; p99_9 is the 99.9th."""
    return percentiles(df.withColumn(value_ns, F.col(value_ns) / 1e6), value_ns, (0.1, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999), by)


def throughput_windows(df: DataFrame, time_ns: str, rows: int = WINDOW_ROWS, warm_up: int = WARM_UP) -> DataFrame:
    """(window, throughput): rows a second over every ``rows`` rows after the first ``warm_up``."""
    numbered = number_rows(df.select(time_ns), time_ns, out="__rn").where(F.col("__rn") > warm_up)
    windows = numbered.groupBy(F.floor((F.col("__rn") - 1 - warm_up) / rows).cast("long").alias("window")).agg(F.max(time_ns).alias("__end"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == rows)
    spans = lag_rows(windows, "__end", "window", out="__from")
    return spans.where("__from is not null and __end > __from").select("window", (rows * 1e9 / (F.col("__end") - F.col("__from"))).alias("throughput"))


def completion_seconds(start_ns: Column, end_ns: Column) -> Column:
    """From the first start to the last end."""
    return (F.max(end_ns) - F.min(start_ns)) / 1e9


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def last_value(value: Column, step: Column) -> Column:
    return F.max_by(value, step)


def accuracy_at(k: int, ranked: Column, target: Column) -> Column:
    """Percent of rows whose target is among the first k of ``ranked``."""
    return F.avg(F.when(F.array_contains(F.slice(ranked, 1, k), target), 100.0).otherwise(0.0))


def _edits(a: list[str], b: list[str]) -> int:
    ids: dict[str, int] = {}
    x, y = (np.array([ids.setdefault(w, len(ids)) for w in words], np.int64) for words in (a, b))
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, w in enumerate(x.tolist(), 1):
        kept = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != w))])
        row = np.minimum.accumulate(kept - place) + place  # insertions: one more for each place to the right
    return int(row[-1])


@F.pandas_udf(T.LongType())
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word-level edit distance."""
    return pd.Series([_edits((r or "").split(), (h or "").split()) for r, h in zip(reference, hypothesis)])


def word_error_rate(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """(edits, words, wer) over the whole table."""
    words = F.size(F.filter(F.split(F.coalesce(reference, F.lit("")), r"\s+"), lambda x: x != ""))
    return df.select(word_edits(reference, hypothesis).alias("e"), words.alias("w")).agg(F.sum("e").alias("edits"), F.sum("w").cast("long").alias("words"), (F.sum("e") / F.sum("w")).alias("wer"))


def cheapest_units(df: DataFrame, cost: Column, capacity: Column, n: int, out: str = "unit_cost") -> DataFrame:
    """The ``n`` rows of least cost for what they can do, then of least cost, with that cost; rows that can do nothing go."""
    return df.where(capacity > 0).withColumn(out, cost / capacity).orderBy(out, cost).limit(n)


def aggregated_telemetry(now_ns: Column, start_ns: str = "start_ns") -> dict[str, Column]:
    """Of a group: the earliest start, and the time from it until ``now_ns``, when the group is emitted."""
    return {"start_ns": F.min(start_ns), "latency_ns": F.max(now_ns) - F.min(start_ns)}


def lowest_per_group(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


aggregate_local, timestamp_aggregate_local, incremental_aggregate_local, timestamp_incremental_aggregate_local = aggregate, timestamp_aggregate, incremental_aggregate, timestamp_incremental_aggregate
