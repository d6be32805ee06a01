"""Numeric functions: class scores, rates, images, small demonstrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of the value, computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def softmax(scores: Column) -> Column:
    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda a, y: a + y)
        return let(total, lambda t: F.transform(exps, lambda x: x / t))

    return let(F.array_max(scores), lambda top: let(F.transform(scores, lambda x: F.exp(x - top)), shares))


def argmax(scores: Column) -> Column:
    """The 0-based place of the largest, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)) - 1


def top_k(scores: Column, k: int) -> Column:
    """The 0-based places of the k largest, equal ones by place."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: p["i"])


def throughput(latency_ms: Column) -> Column:
    """Requests a second; null where the latency isn't a positive number."""
    return F.when(~F.isnan(latency_ms) & (latency_ms > 0), 1000.0 / latency_ms)


def gb_per_hour(kb_per_second: Column) -> Column:
    return kb_per_second * 3600 / 1024 / 1024


@F.pandas_udf(T.ArrayType(T.FloatType()))
def mean_pool(raw: pd.Series, shape: pd.Series) -> pd.Series:
    """The mean over height and width of channel-first features (channels, height, width)."""
    return pd.Series([np.asarray(r, np.float32).reshape(tuple(s)).mean(axis=(1, 2)).tolist() if r is not None and s is not None else None for r, s in zip(raw, shape)])


@F.pandas_udf(T.BinaryType())
def swap_channels(data: pd.Series, shape: pd.Series) -> pd.Series:
    """The last axis of an 8-bit image (height, width, channels) reversed."""
    return pd.Series([np.frombuffer(d, np.uint8).reshape(tuple(s))[..., ::-1].tobytes() if d is not None and s is not None else None for d, s in zip(data, shape)])


def collatz_step(x: Column) -> Column:
    return F.when(x % 2 == 0, F.floor(x / 2).cast("long")).otherwise(3 * x + 1)


def is_prime(x: Column) -> Column:
    """By trial division."""
    divisors = F.when(x >= 4, F.sequence(F.lit(2).cast("long"), F.floor(F.sqrt(x)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return (x >= 2) & ~F.exists(divisors, lambda d: x % d == 0)


def interpolate(points: DataFrame, wanted: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds y at each x of ``wanted`` by straight lines between ``points``; null outside their range."""
    w = Window.partitionBy(*by).orderBy(x)
    ends = points.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).select(*by, F.col(x).alias("__x0"), F.col(y).alias("__y0"), F.lead(x).over(w).alias("__x1"), F.lead(y).over(w).alias("__y1"))
    on = (F.col(x) >= F.col("__x0")) & ((F.col(x) < F.col("__x1")) | (F.col("__x1").isNull() & (F.col(x) == F.col("__x0"))))
    for c in by:
        on = wanted[c].eqNullSafe(ends[c]) & on
    value = F.when(F.col("__x1").isNull() | (F.col("__x1") == F.col("__x0")), F.col("__y0")).otherwise(F.col("__y0") + (F.col(x) - F.col("__x0")) * (F.col("__y1") - F.col("__y0")) / (F.col("__x1") - F.col("__x0")))
    joined = wanted.join(ends, on, "left")
    return joined.select(*(wanted[c] for c in wanted.columns), value.alias(y))
