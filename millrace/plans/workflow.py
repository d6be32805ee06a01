"""Workflows by a builder of named operators, and model stages on pluggable backends.

A ``Stream`` wraps a DataFrame: every call adds a node to the builder's graph and a lazy plan to the
frame. The graph is what placement and stage queries are about; running is Spark's business.
"""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, joins, routing, sets


@dataclass
class Pipeline:
    """What one stage runs, and how."""

    operators: list[str]
    workers: list[str] = field(default_factory=list)
    relay_weights: list[float] = field(default_factory=list)
    models: dict[str, str] = field(default_factory=dict)
    devices: dict[str, list[str]] = field(default_factory=dict)
    network_ns: dict[str, int] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)  # batch_size, buffer_size, request_rate, reset_timestamp


class FlowBuilder:
    def __init__(self, pipelines: dict[str, Pipeline] | None = None):
        self.pipelines, self.nodes, self.edges = pipelines or {}, {}, []

    def _name(self, name: str) -> str:
        out, n = name, 0
        while out in self.nodes:
            n += 1
            out = f"{name}_{n}"
        return out

    def add(self, name: str, kind: str, frame: DataFrame, *inputs: Stream) -> Stream:
        name = self._name(name)
        self.nodes[name] = kind
        self.edges += [(i.name, name) for i in inputs]
        return Stream(self, name, frame)

    def input(self, name: str, frame: DataFrame) -> Stream:
        return self.add(name, "input", frame)

    def option(self, operator: str, key: str, default: Any = None) -> Any:
        for p in self.pipelines.values():
            if operator in p.operators and key in p.options:
                return p.options[key]
        return default

    def edges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.edges, "u string, v string")

    def stages_frame(self, spark: SparkSession) -> DataFrame:
        """(node, stage); every operator must be on one stage exactly."""
        rows = [(o, n) for n, p in self.pipelines.items() for o in p.operators]
        if sorted(o for o, _ in rows) != sorted(self.nodes):
            raise ValueError("every operator belongs to one pipeline")
        return spark.createDataFrame(rows, "node string, stage string")


@dataclass
class Stream:
    builder: FlowBuilder
    name: str
    frame: DataFrame

    def _to(self, name: str, frame: DataFrame, *others: Stream) -> Stream:
        return self.builder.add(name, "compute", frame, self, *others)

    def map(self, name: str, **columns: Column) -> Stream:
        return self._to(name, routing.map_rows(self.frame, **columns))

    def flat_map(self, name: str, items: Column, out: str = "item", keep: Sequence[str] = ()) -> Stream:
        return self._to(name, routing.flat_map(self.frame, items, out, keep))

    def batch_map(self, name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Stream:
        return self._to(name, routing.batch_map(self.frame, fn, schema, self.builder.option(name, "batch_size", routing.BATCH)))

    def buffered_map(self, name: str, **columns: Column) -> Stream:
        return self._to(name, routing.buffered_map(self.frame, self.builder.option(name, "buffer_size", routing.BUFFER), **columns))

    def filter(self, name: str, predicate: Column) -> Stream:
        return self._to(name, routing.filter_rows(self.frame, predicate))

    def inspect(self, name: str, **metrics: Column) -> tuple[Stream, Any]:
        frame, seen = routing.inspect(self.frame, name, **metrics)
        return self._to(name, frame), seen

    def exchange(self, name: str, peers: int, *key: Column | str) -> Stream:
        return self._to(name, routing.exchange(self.frame, peers, *key))

    def gather(self, name: str) -> Stream:
        return self._to(name, routing.gather(self.frame))

    def union(self, name: str, *others: Stream) -> Stream:
        return self._to(name, sets.union(self.frame, *(o.frame for o in others)), *others)

    def join(self, name: str, other: Stream, key: str | Sequence[str]) -> Stream:
        return self._to(name, joins.join(self.frame, other.frame, key), other)

    def timestamp_join(self, name: str, other: Stream, key: str | Sequence[str]) -> Stream:
        return self._to(name, joins.timestamp_join(self.frame, other.frame, key), other)

    def concat(self, name: str, other: Stream, key: Sequence[str], order: str) -> Stream:
        return self._to(name, joins.concat_join(self.frame, other.frame, key, order), other)

    def timestamp_concat(self, name: str, other: Stream, key: Sequence[str], order: str) -> Stream:
        return self._to(name, joins.timestamp_concat(self.frame, other.frame, key, order), other)

    def aggregate(self, name: str, key: Sequence[str], count: int, order: str, **aggs: Column) -> Stream:
        return self._to(name, aggregates.aggregate(self.frame, key, count, order, **aggs))

    def timestamp_aggregate(self, name: str, key: Sequence[str], **aggs: Column) -> Stream:
        return self._to(name, aggregates.timestamp_aggregate(self.frame, key, **aggs))

    def apply(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Stream:
        return self._to(name, fn(self.frame))


# Models: a backend is a function from a batch of inputs to a batch of outputs, loaded once in a worker.

Backend = Callable[[list], list]
_LOADERS: dict[tuple[str, str], Callable[[], Backend]] = {}


def register(operator: str, variant: str, load: Callable[[], Backend]) -> None:
    _LOADERS[(operator, variant)] = load


@functools.lru_cache(maxsize=8)
def _loaded(load: Callable[[], Backend]) -> Backend:
    return load()


def model_map(df: DataFrame, operator: str, variant: str, inputs: str, output: str, kind: str, batch: int = 64) -> DataFrame:
    """Adds ``output`` (of SQL type ``kind``): the variant's answer to column ``inputs``, in batches."""
    load = _LOADERS[(operator, variant)]

    @F.pandas_udf(kind)
    def infer(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = _loaded(load)
        for column in columns:
            out: list = []
            for at in range(0, len(column), batch):
                out += backend(column.iloc[at : at + batch].tolist())
            yield pd.Series(out)

    return df.withColumn(output, infer(inputs))


def _stub_transcript() -> Backend:
    return lambda waves: [None if w is None else " ".join(hashlib.md5(np.asarray(w, "<f4").tobytes()).hexdigest()[i : i + 4] for i in (0, 4, 8)) for w in waves]


def _stub_features(size: int) -> Callable[[], Backend]:
    def load() -> Backend:
        def run(images: list) -> list:
            out = []
            for data in images:
                pixels = np.frombuffer(data or b"\0", np.uint8).astype(np.float32)
                out.append([float(pixels[k::size].sum()) for k in range(size)])
            return out

        return run

    return load


# The variants of the workflow's operators; each has a deterministic stand-in.
for _variant in ("wav2vec2-base-960h", "wav2vec2-large-960h-lv60-self"):
    register("speech", _variant, _stub_transcript)
for _variant, _size in (("resnet18", 16), ("resnet34", 16), ("resnet50", 64), ("resnet101", 64), ("resnet152", 64)):
    register("image", _variant, _stub_features(_size))


def answer(features: Column, question: Column, classes: int) -> Column:
    """The stand-in answer: a class from the features' sum and the question's length."""
    total = F.aggregate(features, F.lit(0).cast("bigint"), lambda a, x: a + F.round(x * 1000).cast("bigint"))
    return F.pmod(total + F.length(question), F.lit(classes)).cast("long")


def question_answering(features: DataFrame, questions: DataFrame, classes: int = 10) -> FlowBuilder:
    """The workflow: features (uid, feature) and questions (uid, text) meet by uid; ``answers`` is its last stream."""
    flow = FlowBuilder()
    image, speech = flow.input("ReadImage", features), flow.input("ReadSpeech", questions)
    feat = image.map("ExtractImageFeature", uid=F.col("uid"), feature=F.col("feature"))
    text = speech.map("SpeechRecognition", uid=F.col("uid"), text=F.lower("text"))
    both = feat.join("Concat", text, "uid")
    flow.answers = both.map("VQA", uid=F.col("uid"), answer=answer(F.col("feature"), F.col("text"), classes))
    return flow


def replicated_run(df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]], times: int = 3, single: bool = False) -> list[DataFrame]:
    """The comparison baselines: all stages in one pass over the rows, so many times; ``single``: in one task, as one thread would."""
    out = []
    for _ in range(times):
        frame = df.coalesce(1) if single else df
        for stage in stages:
            frame = stage(frame)
        out.append(frame)
    return out


def measured(runs: Sequence[DataFrame], instances: int) -> list[tuple[float, float]]:
    """(seconds, instances a second) of computing each run's whole result, one after another."""
    out = []
    for frame in runs:
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        out.append((seconds, instances / seconds))
    return out
