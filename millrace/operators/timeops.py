"""Epochs: stamping, delay, re-clocking, extraction, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import bucketed, lag_rows, number_rows


def stamp_epochs(df: DataFrame, step: Column, order: str, ties: Sequence[str] = (), stripes: int = 1, first: int = 0, out: str = "epoch") -> DataFrame:
    """A source sends, then advances: a row has the time that the row before it set (``step``), the first row the least time.

    With ``stripes`` sources, row i goes to source i mod stripes, and each stamps its own rows.
    """
    timed = df.withColumn("__step", step.cast("long"))
    by: list[str] = []
    if stripes > 1:
        timed = number_rows(timed, order, ties=ties, out="__rn").withColumn("__stripe", F.pmod(F.col("__rn") - 1, F.lit(stripes))).drop("__rn")
        by = ["__stripe"]
    return lag_rows(timed, "__step", order, by=by, ties=ties, out="__before").withColumn(out, F.coalesce("__before", F.lit(first).cast("long"))).drop("__step", "__before", *by)


def forward_only(df: DataFrame, order: str, epoch: str = "epoch") -> DataFrame:
    """The same rows; fails if an epoch lies before that of an earlier row, since late rows can't be."""
    before = lag_rows(df, epoch, order, out="__before")
    return before.withColumn(epoch, F.when(F.col("__before") > F.col(epoch), F.raise_error(F.lit("time went back"))).otherwise(F.col(epoch))).drop("__before")


def delay(df: DataFrame, to: Column, epoch: str = "epoch") -> DataFrame:
    """Rows re-stamped to a later epoch; an earlier one is an error."""
    return df.withColumn(epoch, F.when(to >= F.col(epoch), to).otherwise(F.raise_error(F.lit("delay into the past"))).cast("long"))


delay_total = delay


def delay_batch(df: DataFrame, to, epoch: str = "epoch") -> DataFrame:
    """Re-stamps whole epochs: ``to`` (epoch column) -> later epoch."""
    return delay(df, to(F.col(epoch)), epoch)


def tumbling(epoch: Column, width: int) -> Column:
    """The next multiple of ``width``."""
    return (F.ceil(epoch / F.lit(width)) * width).cast("long")


def reclock(df: DataFrame, ticks: DataFrame, time: str = "epoch", tick: str = "tick", out: str = "tick", width: int | None = None) -> DataFrame:
    """Rows held until the first tick at or after their time; those after the last tick, or without a time, never show.

    Both inputs are cut into the same buckets of time; a row without a later tick in its bucket takes the first
    tick of the buckets after it, which is carried backwards over one row a bucket.
    """
    clock = ticks.select(F.col(tick).cast("long").alias("__t")).where("__t is not null").distinct()
    both = df.where(F.col(time).isNotNull()).select(F.struct(*df.columns).alias("__row"), F.col(time).cast("long").alias("__at"), F.lit(None).cast("long").alias("__t"))
    both = both.unionByName(clock.select(F.lit(None).cast(df.schema).alias("__row"), F.col("__t").alias("__at"), "__t"))
    cut = bucketed(both, "__at", ["__t"], width)
    # Backwards in time, so that the frame only grows; at one time, a tick comes before the rows that it frees.
    inner = Window.partitionBy("__bucket").orderBy(F.desc("__at"), F.col("__t").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    held = cut.withColumn("__next", F.min("__t").over(inner)).where("__row is not null")
    later = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy("__bucket").agg(F.min("__t").alias("__first")).select(F.col("__bucket").alias("__b"), F.min("__first").over(later).alias("__after"))  # one row a bucket
    found = held.join(carried, held["__bucket"] == carried["__b"]).select("__row", F.coalesce("__next", "__after").alias("__o"))
    return found.where("__o is not null").select("__row.*", F.col("__o").alias(out))


def extract(df: DataFrame, value: Column, epoch: str = "epoch", out: str = "rows") -> DataFrame:
    """(epoch, its values sorted). Gathers an epoch's values: for what a person reads."""
    return df.groupBy(epoch).agg(F.sort_array(F.collect_list(value)).alias(out))


def complete_before(df: DataFrame, frontier: int, epoch: str = "epoch") -> tuple[DataFrame, DataFrame]:
    """(rows of epochs that no more input can reach, rows still open): what a notification at the frontier delivers."""
    return df.where(F.col(epoch) < frontier), df.where(~(F.col(epoch) < frontier) | F.col(epoch).isNull())


def frontier(*inputs: DataFrame, epoch: str = "epoch") -> int | None:
    """The least epoch that any input may still hold: the smallest of their largest."""
    tops = [df.agg(F.max(epoch)).first()[0] for df in inputs]
    return None if any(t is None for t in tops) else min(tops)


def sort_take_renumber(df: DataFrame, order: Sequence[str], n: int, out: str = "uid") -> DataFrame:
    """The first n rows, numbered from 0. n is a bounded number of rows."""
    taken = df.orderBy(*order).limit(n)
    return taken.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def arrivals(df: DataFrame, order: str, rate: float, out: str = "arrival_ns") -> DataFrame:
    """When each row arrives at a source held to ``rate`` rows a second."""
    numbered = number_rows(df, order, out="__rn")
    return numbered.withColumn(out, F.floor((F.col("__rn") - 1) * (1e9 / rate)).cast("long")).drop("__rn")
