"""Sources of rows: closures, queues, distributed and buffered loaders, push handles, streams."""

from __future__ import annotations

import base64
import json
import pickle
import time
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.ordered import number_rows
from ..operators.timeops import stamp_epochs


def to_stream(spark: SparkSession, rows: Iterable[tuple], schema: str, epoch: str = "epoch") -> DataFrame:
    """An iterator's rows at epoch 0."""
    return spark.createDataFrame(list(rows), schema).withColumn(epoch, F.lit(0).cast("long"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def new_input(spark: SparkSession, closure: Callable[[], tuple[Any, int | None]], schema: str, rate: float | None = None, epoch: str = "epoch") -> DataFrame:
    """Calls ``closure`` for (row or None, epoch to advance to or None) until both are None. ``rate`` holds it to so many rows a second."""
    rows, now, gap, last = [], 0, 1 / rate if rate else 0.0, 0.0
    while True:
        if gap and (wait := last + gap - time.monotonic()) > 0:
            time.sleep(wait)
        last = time.monotonic()
        row, to = closure()
        if row is None and to is None:
            break
        if row is not None:
            rows.append((*row, now))
        if to is not None:
            if to < now:
                raise ValueError(f"time went back from {now} to {to}")
            now = to
    return spark.createDataFrame(rows, T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(epoch, T.LongType())]))


def input_from_source(df: DataFrame, advance: Column, order: str, epoch: str = "epoch") -> DataFrame:
    """A queue's rows in order; each advances the time for the next."""
    return stamp_epochs(df, advance, order, out=epoch)


def input_from_source_distributed(df: DataFrame, advance: Column, order: str, peers: int, epoch: str = "epoch") -> DataFrame:
    """Row i goes to worker i mod ``peers``, which stamps its own rows."""
    return stamp_epochs(df, advance, order, stripes=peers, out=epoch)


def input_buffered(metadata: DataFrame, load: Callable[[pd.DataFrame], pd.DataFrame], schema: str, peers: int | None = None, buffer: int = 512, order: str | None = None) -> DataFrame:
    """Loads the data that metadata rows name, ``buffer`` rows at a time; with ``peers``, spread over so many workers (row i in ``order`` to worker i mod peers, or evenly)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), buffer):
                yield load(frame.iloc[at : at + buffer])

    spread = metadata
    if peers and order:
        peer = F.pmod(F.col("__row") - 1, F.lit(peers)).cast("int")
        spread = number_rows(metadata, order, out="__row").withColumn("__peer", peer).drop("__row").repartitionById(peers, "__peer").drop("__peer")
    elif peers:
        spread = metadata.repartition(peers)
    return spread.mapInPandas(run, schema)


class Handle:
    """A push input: rows are sent at the present epoch, which only advances; each closed epoch is a file that a stream reads.

    Several handles on one folder, or epochs given to ``send_at``, make an input with several open epochs.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, epoch: str = "epoch"):
        self.spark, self.folder, self.epoch = spark, folder, epoch
        self.schema = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField(epoch, T.LongType())])
        self.now, self.open, self.closed = 0, {}, False

    def send(self, *row: Any) -> None:
        self.send_at(self.now, *row)

    def send_batch(self, rows: Iterable[tuple]) -> None:
        for row in rows:
            self.send(*row)

    def send_at(self, epoch: int, *row: Any) -> None:
        if self.closed or epoch < self.now:
            raise ValueError("that epoch is closed")
        self.open.setdefault(epoch, []).append((*row, epoch))

    def advance_to(self, epoch: int) -> None:
        if epoch < self.now:
            raise ValueError(f"time went back from {self.now} to {epoch}")
        for e in sorted(e for e in self.open if e < epoch):
            self.spark.createDataFrame(self.open.pop(e), self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        self.now = epoch

    def close(self) -> None:
        self.advance_to(max([self.now, *self.open]) + 1)
        self.closed = True

    def stream(self, files_per_trigger: int = 1) -> DataFrame:
        """One epoch's file a micro-batch, or so many."""
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(self.folder)


class _PullReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.pull, self.step = pickle.loads(base64.b64decode(options["pull"])), int(options["rowsPerTrigger"])

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict):
        rows = list(self.pull(start["at"], self.step))
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.pull(start["at"], end["at"] - start["at"]))


class PullSource(DataSource):
    """Rows of any kind, pulled by a function of (place, at most so many) that gives the same rows whenever it is asked again."""

    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return self.options["rowSchema"]

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PullReader(self.options)


def pull_source(spark: SparkSession, pull: Callable[[int, int], Iterable[tuple]], schema: str, rows_per_trigger: int) -> DataFrame:
    """A stream that takes no more than ``rows_per_trigger`` rows for each micro-batch: it doesn't run ahead of what has been completed."""
    spark.dataSource.register(PullSource)
    packed = base64.b64encode(cloudpickle.dumps(pull)).decode()
    return spark.readStream.format("pull").option("pull", packed).option("rowSchema", schema).option("rowsPerTrigger", rows_per_trigger).load()


def iterator_source(spark: SparkSession, rows: int, rows_per_trigger: int) -> DataFrame:
    """The numbers below ``rows`` as a pulled stream."""
    return pull_source(spark, lambda at, most: [(i,) for i in range(at, min(at + most, rows))], "value long", rows_per_trigger)


def rate_source(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def file_source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files of a folder, or one file."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def kafka_options(servers: str, topic: str, *, starting: str = "earliest", per_trigger: int | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, **({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})}


def kafka_source(spark: SparkSession, options: dict[str, str], decode: Callable[[Column], Column]) -> DataFrame:
    """A topic's decoded messages. Needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load().select(decode(F.col("value")).alias("value"), "timestamp", "offset")


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Rows as JSON messages. Needs Spark's Kafka connector on the class path."""
    out = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def read_json_lines(path: str) -> list[dict]:
    return [json.loads(line) for line in Path(path).read_text().splitlines() if line]


new_local_input, input_from_source_local, input_from_source_distributed_local, input_buffered_local = new_input, input_from_source, input_from_source_distributed, input_buffered
