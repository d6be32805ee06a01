"""Capture of a stream to a log, replay of logs, extraction by epoch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.timeops import extract as by_epoch


def capture(df: DataFrame, path: str) -> None:
    """Writes a batch's rows, with their epochs, to the log."""
    df.write.mode("append").parquet(path)


def capture_stream(df: DataFrame, path: str, checkpoint: str, name: str | None = None):
    """Writes a stream's rows to the log until what is there now has been read; returns the query."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def capture_into(df: DataFrame, name: str):
    """Into a table in memory, for tests and small results."""
    return df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()


def replay(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of logs."""
    return reduce(DataFrame.unionByName, (spark.read.parquet(p) for p in paths))


def replay_stream(spark: SparkSession, schema, *paths: str, files_per_trigger: int = 1) -> DataFrame:
    return reduce(DataFrame.unionByName, (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(p) for p in paths))


def extract(df: DataFrame, value: Column, epoch: str = "epoch") -> DataFrame:
    """(epoch, sorted values) ascending; empty epochs don't show."""
    return by_epoch(df, value, epoch).orderBy(epoch)
