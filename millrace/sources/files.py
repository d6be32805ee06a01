"""Files in and out: placement tables, data sets, media, features, metrics."""

from __future__ import annotations

import io
import json
import wave
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import image_name
from ..operators.timeops import sort_take_renumber

# The headerless placement tables by name.
PLACEMENT = {
    "workers_specs": "worker string, cost double",
    "workers_numbers": "worker_type string, number int",
    "workers_workers_link": "a string, b string, cost double",
    "logical_graph": "u string, v string",
    "throughput_normalization_ratios": "u string, v string, ratio double",
    "execution_profile": "node string, worker string, model string, latency double",
    "message_sizes": "u string, v string, u_model string, v_model string, size double",
    "sources_workers_link": "source string, worker string, cost double",
    "input_injection_rates": "node string, rate double",
}
OPTIONAL = {"workers_workers_link", "throughput_normalization_ratios", "sources_workers_link", "workers_numbers"}


def placement_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Permissive: a row with a field too many keeps its first fields. Ratios may also be given by variant."""
    path = f"{folder}/{name}.csv"
    schema = PLACEMENT[name]
    if name == "throughput_normalization_ratios" and len(spark.read.text(path).first()[0].split(",")) == 5:
        schema = "u string, v string, u_model string, v_model string, ratio double"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)


def numbered_workers(numbers: DataFrame) -> DataFrame:
    """A worker ``type_i`` for each of a type's number."""
    return numbers.where("number > 0").select(F.explode(F.sequence(F.lit(0), F.col("number") - 1)).alias("i"), "worker_type").select(F.concat_ws("_", "worker_type", F.col("i").cast("string")).alias("worker"), "worker_type")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def accuracy_requirement(path: str) -> tuple[str, float]:
    found = json.loads(Path(path).read_text())
    return found["sink"], float(found["threshold"])


def read_questions(questions: DataFrame, n: int, split: str) -> tuple[DataFrame, DataFrame]:
    """The first n questions by id, numbered from 0, as (uid, image path) and (uid, speech path)."""
    taken = sort_take_renumber(questions, ["question_id"], n)
    name = image_name(F.lit(split), F.col("image_id"))
    return taken.select("uid", name.alias("image_path")), taken.select("uid", F.format_string("%012d.flac", F.col("question_id").cast("long")).alias("speech_path"))


def load_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of every file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


@F.pandas_udf(T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())]))
def decode_image(content: pd.Series) -> pd.DataFrame:
    """Portable pixmaps (P6) as (height, width, 3) in BGR; other formats if the imaging library is installed; else null."""

    def one(raw: bytes):
        if raw[:2] == b"P6":
            fields, at = [], 2
            while len(fields) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                stop = at
                while not raw[stop : stop + 1].isspace():
                    stop += 1
                fields.append(int(raw[at:stop]))
                at = stop
            w, h, _ = fields
            pixels = np.frombuffer(raw, np.uint8, w * h * 3, at + 1).reshape(h, w, 3)
        else:
            try:
                from PIL import Image
            except ImportError:
                return None
            pixels = np.asarray(Image.open(io.BytesIO(raw)).convert("RGB"))
        return {"shape": list(pixels.shape), "data": pixels[..., ::-1].tobytes()}

    return pd.DataFrame([one(c) or {"shape": None, "data": None} for c in content], columns=["shape", "data"])


@F.pandas_udf(T.StructType([T.StructField("sampling_rate", T.IntegerType()), T.StructField("waveform", T.ArrayType(T.FloatType()))]))
def decode_speech(content: pd.Series) -> pd.DataFrame:
    """16-bit WAV as mono floats; other formats if the sound library is installed; else null."""

    def one(raw: bytes):
        if raw[:4] == b"RIFF":
            with wave.open(io.BytesIO(raw)) as w:
                samples = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                return {"sampling_rate": w.getframerate(), "waveform": samples.astype(np.float32).tolist()}
        try:
            import soundfile
        except ImportError:
            return None
        samples, rate = soundfile.read(io.BytesIO(raw), always_2d=True)
        return {"sampling_rate": rate, "waveform": samples.mean(axis=1).astype(np.float32).tolist()}

    return pd.DataFrame([one(c) or {"sampling_rate": None, "waveform": None} for c in content], columns=["sampling_rate", "waveform"])


def write_features(df: DataFrame, path: str) -> None:
    """A feature store: (name, features), ordered so that a read by name skips files."""
    df.select("name", "features").sortWithinPartitions("name").write.parquet(path)


def read_features(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    return spark.read.parquet(path).join(names.select("name"), "name")


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON object a line, for (pipeline, worker) folders."""
    df.write.partitionBy("pipeline", "worker").json(path)


def write_answers_csv(df: DataFrame, path: str, arrays: list[str]) -> None:
    """Fields by ``~``, array elements by ``|``."""
    df.select(*(F.concat_ws("|", c).alias(c) if c in arrays else F.col(c) for c in df.columns)).write.option("sep", "~").csv(path)


def write_plan(plan: dict, path: str) -> None:
    """JSON or YAML, as the name asks."""
    Path(path).write_text(json.dumps(plan, indent=4, sort_keys=True) if path.endswith(".json") else to_yaml(plan))


def to_yaml(value, indent: int = 0) -> str:
    pad = "  " * indent
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:{_inline(v)}" if not isinstance(v, (dict, list)) or not v else f"{pad}{k}:\n{to_yaml(v, indent + 1)}" for k, v in sorted(value.items()))
    return "".join(f"{pad}-{_inline(v)}" if not isinstance(v, (dict, list)) or not v else f"{pad}-\n{to_yaml(v, indent + 1)}" for v in value)


def _inline(value) -> str:
    return f" {json.dumps(value)}\n"
