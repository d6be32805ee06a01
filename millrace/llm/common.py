"""Helpers shared by the corpus operators: tables, scratch space and Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space; ``bytes.split()`` yields exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may have an own one, where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch at most: long texts in flight must stay small on both sides.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS, unless they are smaller. The setting counts when a plan runs, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at a task's end a worker, which lives on, gives back what it has freed."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Written tables in the shared folder. They cut lineage and outlive any executor.

    Results read them lazily, so they stay until the driver's Python ends, until ``drop`` frees one, or until
    a ``freed`` block ends in which they were made.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.close)
        Scratch.made.append(self)

    def close(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # the session has ended; a later sweep of the folder finds it
            pass

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            if path.startswith((self.root, self.root.replace("file:///", "file:/"))) or self.root.split("/", 3)[-1] in path:
                remove(self.spark, path)


@contextlib.contextmanager
def freed() -> Iterator[None]:
    """Deletes, at its end, what operators have written within; for results that are written by then."""
    before = len(Scratch.made)
    try:
        yield
    finally:
        for scratch in Scratch.made[before:]:
            scratch.close()
            atexit.unregister(scratch.close)
        del Scratch.made[before:]


def estimated(df: DataFrame) -> int:
    """Bytes of ``df`` by the plan's statistics (of files, their size); 0 where they say nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 62 else 0


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def key_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def texts(column) -> list[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` text bytes, so that long texts don't add up."""
    i = batch.schema.get_field_index(text)
    step = max(1, int(batch.num_rows * limit / max(limit, batch.column(i).nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_text(df: DataFrame, text: str, schema: str, fn: Callable[[pa.RecordBatch], list], limit: int = 8 << 20) -> DataFrame:
    """mapInArrow over slices; ``fn`` returns the columns in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, limit):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) for c, f in zip(fn(part), arrow, strict=True)], schema=arrow)

    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def keep_rows(df: DataFrame, text: str, keep: Callable[[pa.Array], list[bool]], limit: int = 8 << 20) -> DataFrame:
    """The rows, with all their columns, for whose text ``keep`` says true."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text, limit):
                yield part.filter(pa.array(keep(part.column(part.schema.get_field_index(text))), pa.bool_()))

    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: released(run(batches)), df.schema)
