"""Operators of the caller's own making, over batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unary(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """One input: ``fn`` sees a partition's batches one after another, so it may keep state between them."""
    return df.mapInPandas(fn, schema)


def unary_notify(df: DataFrame, epoch: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` is called once an epoch is complete, with its rows. Epochs must fit in a worker's memory."""
    return df.groupBy(epoch).applyInPandas(fn, schema)


def binary(left: DataFrame, right: DataFrame, key: Sequence[str], fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Two inputs: ``fn`` sees both sides' rows of a key. Keys must fit in a worker's memory."""
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(fn, schema)


binary_notify = binary


def tagged(df: DataFrame, fn: Callable[[pd.DataFrame], Iterable[tuple[int, pd.DataFrame]]], schema: str, outputs: int, tag: str = "output") -> list[DataFrame]:
    """Several outputs: ``fn`` gives (output number, rows); each output is the frame of its tag."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, rows in fn(frame):
                yield rows.assign(**{tag: n})

    both = df.mapInPandas(run, f"{schema}, {tag} int")
    return [both.where(both[tag] == n).drop(tag) for n in range(outputs)]


def combined(inputs: Sequence[DataFrame], key: Sequence[str], fn: Callable[[tuple, list[pd.DataFrame]], Iterable[tuple[int, pd.DataFrame]]], schema: str, outputs: int, tag: str = "output") -> list[DataFrame]:
    """Several inputs and outputs: ``fn`` sees all inputs' rows of a key and gives (output number, rows). Keys must fit in a worker's memory."""
    columns, names = [df.columns for df in inputs], T._parse_datatype_string(schema).names
    wide = [df.select(*key, F.lit(n).alias("__input"), F.struct(*df.columns).alias(f"__r{n}")) for n, df in enumerate(inputs)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame(list(group.loc[group["__input"] == n, f"__r{n}"]), columns=c) for n, c in enumerate(columns)]
        out = [rows.assign(**{tag: n}) for n, rows in fn(tuple(group[k].iloc[0] for k in key), parts)]
        return pd.concat(out) if out else pd.DataFrame(columns=[*names, tag])

    found = both.groupBy(*key).applyInPandas(run, f"{schema}, {tag} int")
    return [found.where(found[tag] == n).drop(tag) for n in range(outputs)]


def sink(df: DataFrame, fn: Callable[[pd.DataFrame], None]) -> None:
    """``fn`` on the executors, for every batch; a worker holds one batch at a time. Columns may share a name."""
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fn(frame.iloc[:, :-1].set_axis(names, axis=1))
        yield from ()

    by_place = df.toDF(*(f"c{n}" for n in range(len(names)))).withColumn("row", F.lit(0))  # so that a row without columns is one, too
    by_place.mapInPandas(run, "nothing int").write.format("noop").mode("overwrite").save()


def in_step(df: DataFrame, phases: Sequence[Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Each phase begins once every worker has ended the one before. All partitions run at once, and each must fit in memory."""
    from pyspark import BarrierTaskContext

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [f for f in frames if len(f)]
        for phase in phases:
            own = [phase(f) for f in own]
            BarrierTaskContext.get().barrier()
        yield from own

    return df.mapInPandas(run, schema, barrier=True)


def sequenced(df: DataFrame, time: str, worker: str, place: str, out: str = "sequence") -> DataFrame:
    """One order for what several workers say: by time, worker and place in the worker's own sequence, numbered from 0."""
    from ..functions.ordered import number_rows

    numbered = number_rows(df, time, ties=[worker, place], out=out)
    return numbered.withColumn(out, numbered[out] - 1)
