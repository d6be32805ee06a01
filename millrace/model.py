"""Record schemas: the telemetry envelope, tensors and the multimodal records.

Epochs are longs. Telemetry times are long nanoseconds, since Spark's timestamps stop at microseconds.
Unsigned types are widened: u8 to short, u16 to int, u32 to long, u64 to decimal(20,0), u128/i128 to decimal(38,0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "epoch"

TENSOR = T.StructType([T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("raw", T.ArrayType(T.FloatType()))])
IMAGE = T.StructType([T.StructField("uid", T.LongType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])
FEATURE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("raw", T.ArrayType(T.FloatType()))])
SPEECH = T.StructType([T.StructField("uid", T.LongType()), T.StructField("sampling_rate", T.IntegerType()), T.StructField("waveform", T.ArrayType(T.FloatType()))])
TEXT = T.StructType([T.StructField("uid", T.LongType()), T.StructField("text", T.StringType())])
ANSWER = T.StructType([T.StructField("uid", T.LongType()), T.StructField("answer", T.StringType())])

#: By the name of an unsigned or wide type.
WIDENED = {
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "usize": T.DecimalType(20, 0), "u128": T.DecimalType(38, 0),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "isize": T.LongType(), "i128": T.DecimalType(38, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "char": T.StringType(), "string": T.StringType(), "duration": T.LongType(), "unit": T.NullType(),
}


def result_type(ok: T.DataType, err: T.DataType) -> T.StructType:
    """A result: exactly one of its fields is not null."""
    return T.StructType([T.StructField("ok", ok), T.StructField("err", err)])


def envelope(df: DataFrame, start_ns: Column, *, latency_ns: Column | None = None) -> DataFrame:
    """Adds the telemetry columns start_ns, last_ns and latency_ns (execution and network, summed)."""
    return df.withColumns({"start_ns": start_ns.cast("long"), "last_ns": start_ns.cast("long"), "latency_ns": (latency_ns if latency_ns is not None else F.lit(0)).cast("long")})


def timed(df: DataFrame, execution_ns: Column, *, network_ns: Column | None = None, reset: bool = False) -> DataFrame:
    """After an operator: its execution and (simulated) network time are added; ``reset`` starts the clock anew."""
    spent = (execution_ns + (network_ns if network_ns is not None else F.lit(0))).cast("long")
    latency = spent if reset else F.col("latency_ns") + spent
    start = F.col("last_ns") if reset else F.col("start_ns")
    return df.withColumns({"start_ns": start, "last_ns": F.col("last_ns") + spent, "latency_ns": latency})


def at(tensor: Column, *index: int | Column) -> Column:
    """An element of a row-major tensor."""
    place = F.lit(0).cast("long")
    for axis, i in enumerate(index):
        place = place * tensor["shape"][axis] + (i if isinstance(i, Column) else F.lit(i))
    return F.get(tensor["raw"], place.cast("int"))
