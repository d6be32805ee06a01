"""Ordered computations that stay spread over the cluster.

A window over a whole table, or over a key that holds a third of it, runs in one task. Here rows are cut
into buckets of the order column (a number or a time); the window runs inside each bucket, and what a
bucket hands on (its row count, sum or last values) is carried by a window over one row a bucket.

Buckets hold about ROWS rows each, whatever the column's unit and distribution: a first pass over the order
column takes its approximate quantiles, and the ranges between them are cut evenly. Nulls, and a value that fills
whole ranges, have buckets of their own; if no tie columns order their rows, they are dealt by hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a bucket, about; ranges between quantiles.
ROWS, RANGES = 1 << 20, 64


def _position(df: DataFrame, order: str) -> Column:
    kind = df.schema[order].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(order))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(order))
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(order))
    return F.col(order) if isinstance(kind, T.IntegralType) else F.col(order).cast("double")


def _tree(x: Column, cuts: list, leaves: list[Column]) -> Column:
    """``leaves[k]`` where ``x`` lies from ``cuts[k - 1]`` up to below ``cuts[k]``."""
    if not cuts:
        return leaves[0]
    mid = len(cuts) // 2
    return F.when(x < F.lit(cuts[mid]), _tree(x, cuts[:mid], leaves[: mid + 1])).otherwise(_tree(x, cuts[mid + 1 :], leaves[mid + 1 :]))


def bucketed(df: DataFrame, order: str, ties: Sequence[str], width: int | None = None) -> DataFrame:
    """Adds ``__bucket``, which never falls as the order column grows; nulls come first."""
    x = _position(df, order)
    if width is not None:
        return df.withColumn("__bucket", F.coalesce(F.floor(x / F.lit(width)).cast("long"), F.lit(-(1 << 62))))
    floating = isinstance(df.schema[order].dataType, (T.DoubleType, T.FloatType))
    known = F.when(~F.isnan(x), x) if floating else x
    points = [k / RANGES for k in range(RANGES + 1)]
    n, every, found = df.select(known.alias("x")).agg(F.count("x"), F.count(F.lit(1)), F.percentile_approx("x", points, 100 * RANGES)).first()
    rows = ROWS
    if every <= rows:
        return df.withColumn("__bucket", F.lit(0).cast("long"))
    share = math.ceil(n / RANGES / rows)
    dealt = F.xxhash64(*(f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    at, leaves, values = 0, [], sorted(set(found or []))
    for low, high in zip([None, *values], [*values, None]):
        times = 0 if low is None else found.count(low)
        point, many = None, 1 if ties else max(1, times * share)
        if times > 1:  # the value fills ranges
            point = F.lit(at) + (F.pmod(dealt, F.lit(many)) if many > 1 else F.lit(0))
            at += many
        if low is None or high is None or share == 1:
            leaf, parts = F.lit(at), 1
        else:
            leaf, parts = F.lit(at) + F.greatest(F.lit(0), F.least(F.lit(share - 1), F.floor((x.cast("double") - float(low)) / ((float(high) - float(low)) / share)))), share
        at += parts
        leaves.append(leaf if point is None else F.when(x == F.lit(low), point).otherwise(leaf))
    bucket = _tree(x, values, leaves)
    if floating:
        bucket = F.when(F.isnan(x), F.lit(at)).otherwise(bucket)
    empty = 1 if ties else max(1, math.ceil((every - n) / rows))
    return df.withColumn("__bucket", F.when(x.isNull(), -1 - F.pmod(dealt, F.lit(empty))).otherwise(bucket).cast("long"))


def _windows(order: str, by: Sequence[str], ties: Sequence[str]):
    inner = Window.partitionBy(*by, "__bucket").orderBy(order, *ties)
    outer = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return inner, outer


def _carried(df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "__bucket"]
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    right = summary.select(*(F.col(k).alias(n) for k, n in names.items()), *(c for c in summary.columns if c not in keys))
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(right, on).drop(*names.values())


def number_rows(df: DataFrame, order: str, by: Sequence[str] = (), ties: Sequence[str] = (), out: str = "row_number", width: int | None = None) -> DataFrame:
    """Adds the 1-based place of each row in its group."""
    cut = bucketed(df, order, ties, width)
    inner, outer = _windows(order, by, ties)
    summary = cut.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n")).select(*by, "__bucket", F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__carry"))
    return _carried(cut.withColumn(out, F.row_number().over(inner)), summary, by).withColumn(out, F.col(out) + F.col("__carry")).drop("__bucket", "__carry")


def running_sum(df: DataFrame, value: str, order: str, by: Sequence[str] = (), ties: Sequence[str] = (), out: str = "running", width: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to and with this one."""
    cut = bucketed(df, order, ties, width)
    inner, outer = _windows(order, by, ties)
    summary = cut.groupBy(*by, "__bucket").agg(F.sum(value).alias("__s")).select(*by, "__bucket", F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__carry"))
    own = F.coalesce(F.sum(value).over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return _carried(cut.withColumn(out, own), summary, by).withColumn(out, F.col(out) + F.col("__carry")).drop("__bucket", "__carry")


def lag_rows(df: DataFrame, value: str, order: str, by: Sequence[str] = (), ties: Sequence[str] = (), out: str = "lagged", width: int | None = None) -> DataFrame:
    """Adds ``value`` of the row before (null for the first); rows that nothing else orders come by value."""
    cut = bucketed(df, order, ties, width)
    inner, outer = _windows(order, by, [*ties, value])
    last = F.max(F.struct(*(F.col(c) for c in (order, *ties)), F.col(value).alias("__v")))
    summary = cut.groupBy(*by, "__bucket").agg(last.alias("__l")).select(*by, "__bucket", F.last("__l").over(outer)["__v"].alias("__carry"))
    own = F.when(F.row_number().over(inner) > 1, F.struct(F.lag(value).over(inner).alias("v")))
    found = _carried(cut.withColumn("__own", own), summary, by)
    return found.withColumn(out, F.when(F.col("__own").isNotNull(), F.col("__own")["v"]).otherwise(F.col("__carry"))).drop("__bucket", "__carry", "__own")
