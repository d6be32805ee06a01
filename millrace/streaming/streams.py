"""Epoch operators over unbounded input: watermarks stand for frontiers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timestamp_aggregate_stream(df: DataFrame, time: str, epoch: str, late: str, key: Sequence[str], **aggs: Column) -> DataFrame:
    """Groups by (epoch, key), where an epoch is a span of event time such as '1 day'; emitted once the watermark passes it (append mode)."""
    window = F.window(time, epoch)
    return df.withWatermark(time, late).groupBy(window.alias("epoch"), *key).agg(*(c.alias(n) for n, c in aggs.items())).select(F.col("epoch.start").alias("epoch"), *key, *aggs)


def timestamp_join_stream(left: DataFrame, right: DataFrame, time: str, late: str, key: Sequence[str]) -> DataFrame:
    """Inner join on (event time, key); state goes as the smaller of both watermarks passes."""
    left.sparkSession.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    return left.withWatermark(time, late).join(right.withWatermark(time, late), [time, *key])


def distinct_stream(df: DataFrame, time: str, late: str, *columns: str) -> DataFrame:
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([time, *columns])


def for_each_epoch(df: DataFrame, fn: Callable[[DataFrame, int], Any], checkpoint: str):
    """``fn`` (rows, number of the micro-batch), until what is there now has been read."""
    return df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completed(query) -> dict[str, Any]:
    """What a probe tells: the watermark and how many rows have been read."""
    last = query.lastProgress or {}
    return {"watermark": (last.get("eventTime") or {}).get("watermark"), "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def less_than(query, time: str) -> bool:
    """Whether rows before ``time`` (ISO) may still come."""
    mark = completed(query)["watermark"]
    return mark is None or mark < time


def step_until_done(query) -> None:
    query.processAllAvailable()
