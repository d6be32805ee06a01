"""Projections, filters and routing.

Where the reference semantics distinguish an operator whose output crosses workers from a local one, Spark
decides itself when to exchange rows: each function also has a ``_local`` name for the same thing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ordered import number_rows

BATCH = 64
BUFFER = 512


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One row to one row: exactly the given columns."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def map_in_place(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def flat_map(df: DataFrame, items: Column, out: str = "item", keep: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """One row to as many as ``items`` has elements (none for null)."""
    if position:
        return df.select(*keep, F.posexplode(items).alias(position, out))
    return df.select(*keep, F.explode(items).alias(out))


def batch_ids(df: DataFrame, epoch: str, order: str, size: int = BATCH, out: str = "batch") -> DataFrame:
    """Adds the number of each row's batch in its epoch; the last may be short."""
    numbered = number_rows(df, order, by=[epoch], out="__rn")
    return numbered.withColumn(out, F.floor((F.col("__rn") - 1) / size).cast("long")).drop("__rn")


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = BATCH) -> DataFrame:
    """A vectorised function over batches of up to ``size`` rows; it must return a row for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                got = fn(part)
                if len(got) != len(part):
                    raise ValueError(f"a batch of {len(part)} rows became {len(got)}")
                yield got

    return df.mapInPandas(run, schema)


def buffered_map(df: DataFrame, buffer: int = BUFFER, **columns: Column) -> DataFrame:
    """The rows of ``map_rows``: when they are handed on can't be seen in the result."""
    return map_rows(df, **columns)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def inspect(df: DataFrame, name: str = "inspect", by: str | None = None, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and metrics that are there once an action has run (rows and the largest of ``by``, such as the epoch, at least)."""
    seen = Observation(name)
    more = {"last": F.max(by)} if by else {}
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(n) for n, m in {**more, **metrics}.items())), seen


def inspect_batches(df: DataFrame, see: Callable[[int, int], None]) -> DataFrame:
    """The same rows; ``see`` (partition, rows) is called on the executors for each batch."""
    from pyspark import TaskContext

    def run(batches):
        for batch in batches:
            see(TaskContext.get().partitionId(), batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def exchange(df: DataFrame, peers: int, *key: Column | str) -> DataFrame:
    """Rows of a key go to one worker."""
    return df.repartition(peers, *key)


def route(key: Column, peers: int) -> Column:
    """The worker of a key."""
    return F.pmod(key, F.lit(peers)).cast("int")


def gather(df: DataFrame) -> DataFrame:
    """All rows to one worker. Only for results that are known to be small."""
    return df.coalesce(1)


def replicate(df: DataFrame, peers: int, out: str = "peer") -> DataFrame:
    """Every row once for each worker."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(peers - 1))))


def branch(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where it doesn't hold, or is null; rows where it holds)."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.where(~holds), df.where(holds)


def branch_when(df: DataFrame, epoch: str, predicate: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """``branch`` by the epoch alone."""
    return branch(df, predicate(F.col(epoch)))


def partition(df: DataFrame, n: int, index: Column) -> list[DataFrame]:
    """One frame for each index below n; other indices are an error of the caller and go nowhere."""
    return [df.where(index == k) for k in range(n)]


# Results: a struct of ok and err, one of them null.


def as_result(ok: Column, err: Column) -> Column:
    """``err`` only where ``ok`` is null."""
    return F.struct(ok.alias("ok"), F.when(ok.isNull(), err).alias("err"))


def ok_err(df: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose result is ok, with its value; those whose result is an error)."""
    r = F.col(result)
    return df.where(r["ok"].isNotNull()).withColumn(result, r["ok"]), df.where(r["ok"].isNull()).withColumn(result, r["err"])


def ok(df: DataFrame, result: str) -> DataFrame:
    return ok_err(df, result)[0]


def err(df: DataFrame, result: str) -> DataFrame:
    return ok_err(df, result)[1]


def map_ok(result: Column, fn: Callable[[Column], Column]) -> Column:
    return F.struct(F.when(result["ok"].isNotNull(), fn(result["ok"])).alias("ok"), result["err"].alias("err"))


def map_err(result: Column, fn: Callable[[Column], Column]) -> Column:
    return F.struct(result["ok"].alias("ok"), F.when(result["ok"].isNull(), fn(result["err"])).alias("err"))


def and_then(result: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` gives a result for the value of an ok one; errors stay."""
    after = fn(result["ok"])
    good = result["ok"].isNotNull()
    return F.struct(F.when(good, after["ok"]).alias("ok"), F.when(good, after["err"]).otherwise(result["err"]).alias("err"))


def unwrap_or_else(result: Column, fn: Callable[[Column], Column]) -> Column:
    return F.coalesce(result["ok"], fn(result["err"]))


map_local, flat_map_local, batch_map_local, buffered_map_local, filter_local, inspect_local = map_rows, flat_map, batch_map, buffered_map, filter_rows, inspect
