"""Placement inputs from a folder of tables, and the whole search from them to a plan."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import fallback_lookup
from ..sources import files
from ..storage import exists
from . import placement as P
from .tiers import partition_workers

DEFAULT = "default"


@dataclass
class Settings:
    """How to search; ``None`` sets no limit."""

    latency_ratio: float = 1.0
    link_scale: float = 1.0
    strategy: str = "same-tier"
    allocation: str = "dp"
    beam: int | None = 10
    sample_limit: int | None = None
    expansions: int | None = None
    most_orders: int | None = None
    best_k: int | None = None


@dataclass
class Inputs:
    workers: DataFrame
    tiers: list[list[str]]
    edges: DataFrame
    profile: DataFrame  # node, worker (or worker type), model, latency
    sizes: DataFrame  # u, v, u_model, v_model, size
    rates: DataFrame
    links: DataFrame
    source_links: DataFrame
    ratios: DataFrame  # u, v, u_model, v_model, ratio
    by_type: bool = False
    names: dict[str, str] = field(default_factory=dict)  # worker to type


def read_folder(spark: SparkSession, folder: str, partition: str | None = None, tiers: int = 2) -> Inputs:
    """Concrete workers, or (with a table of numbers) a number of each type; optional tables that aren't there are empty.

    Tiers are those of the partition file, else those that the strategy ``partition`` finds, else the workers that free links join.
    """

    def get(name: str) -> DataFrame:
        if name in files.OPTIONAL and not exists(spark, f"{folder}/{name}.csv"):
            return spark.createDataFrame([], files.PLACEMENT[name])
        return files.placement_table(spark, folder, name)

    specs, numbers = get("workers_specs"), get("workers_numbers")
    by_type = not numbers.isEmpty()
    workers, names = specs, {}
    if by_type:
        every = files.numbered_workers(numbers)
        workers = every.join(specs.withColumnRenamed("worker", "worker_type"), "worker_type").select("worker", "cost")
        names = {r.worker: r.worker_type for r in every.collect()}
    ratios = get("throughput_normalization_ratios")
    if "u_model" not in ratios.columns:
        ratios = ratios.select("u", "v", F.lit(DEFAULT).alias("u_model"), F.lit(DEFAULT).alias("v_model"), "ratio")
    part = f"{folder}/workers_partition.json"
    if exists(spark, part):
        found = json.loads(spark.read.text(part, wholetext=True).first()[0])
    elif partition:
        found = partition_workers({r.worker: r.cost for r in workers.collect()}, {(r.a, r.b): r.cost for r in get("workers_workers_link").collect()}, partition, tiers)
    else:
        rows = P.tiers_by_links(workers, get("workers_workers_link")).collect()
        found = [sorted(r.worker for r in rows if r.tier == t) for t in sorted({r.tier for r in rows})]
    return Inputs(workers, found, get("logical_graph"), get("execution_profile"), get("message_sizes"), get("input_injection_rates"), get("workers_workers_link"), get("sources_workers_link"), ratios, by_type, names)


def with_variants(spark: SparkSession, inputs: Inputs, variants: dict[str, str], settings: Settings) -> P.Problem:
    """The problem of one choice of variants. Sizes and ratios fall back to the default variant of either end; a missing ratio is 1."""
    chosen = spark.createDataFrame([(n, m) for n, m in variants.items()] or [("", "")], "node string, model string")
    latency = inputs.profile.join(chosen, ["node", "model"]).select("node", "worker", (F.col("latency") * settings.latency_ratio).alias("latency")).collect()
    u = chosen.select(F.col("node").alias("u"), F.col("model").alias("u_model"))
    v = chosen.select(F.col("node").alias("v"), F.col("model").alias("v_model"))
    ends = inputs.edges.join(u, "u", "left").join(v, "v", "left").fillna(DEFAULT, ["u_model", "v_model"])
    found = fallback_lookup(ends, inputs.sizes, "u_model", "v_model", "size", keys=["u", "v"])
    found = fallback_lookup(found, inputs.ratios, "u_model", "v_model", "ratio", keys=["u", "v"], otherwise=F.lit(1.0)).collect()
    if missing := [(r.u, r.v) for r in found if r["size"] is None]:
        raise ValueError(f"no message size for {missing}")
    type_of = inputs.names or {w: w for t in inputs.tiers for w in t}
    speed = {(r.node, r.worker): r.latency for r in latency if r.latency is not None}
    return P.Problem(
        costs={r.worker: r.cost for r in inputs.workers.collect()},
        tiers=inputs.tiers,
        edges=[(r.u, r.v) for r in inputs.edges.collect()],
        latency={(n, w): speed[(n, t)] for n in variants for w, t in type_of.items() if (n, t) in speed},
        rates={r.node: float(r.rate) for r in inputs.rates.collect()},
        sizes={(r.u, r.v): r["size"] for r in found},
        ratios={(r.u, r.v): r.ratio for r in found},
        links={(r.a, r.b): r.cost for r in inputs.links.collect()},
        source_links={(r.source, r.worker): r.cost for r in inputs.source_links.collect()},
        link_scale=settings.link_scale,
    )


def end_to_end_accuracy(measured: dict[tuple[tuple[str, str], ...], float], variants: dict[str, str]) -> float | None:
    """The measured accuracy of exactly these variants."""
    return measured.get(tuple(sorted(variants.items())))


def optimize(spark: SparkSession, inputs: Inputs, profiles: Sequence[P.Profile], sink: str, threshold: float, settings: Settings, measured: dict[tuple[tuple[str, str], ...], float] | None = None) -> dict | None:
    """Variants by beam search, workers by assignment, the plan of least overall cost; None if there is none."""
    candidates = []
    for variants, _ in P.beam_search(list(profiles), sink, threshold, settings.beam, settings.sample_limit, settings.expansions):
        accuracy = end_to_end_accuracy(measured or {}, variants)
        candidates.append((variants, threshold if accuracy is None else accuracy, with_variants(spark, inputs, variants, settings)))
    return P.best_plan(candidates, strategy=settings.strategy, allocation=settings.allocation, most_orders=settings.most_orders, best_k=settings.best_k)


def exhaustive(spark: SparkSession, inputs: Inputs, choices: Sequence[tuple[dict[str, str], float]], threshold: float, settings: Settings, tiered: bool = False) -> dict | None:
    """Every choice of variants that is accurate enough, with every assignment: for checking the searches on small problems."""
    best: tuple[float, dict] | None = None
    for variants, accuracy in choices:
        if accuracy < threshold:
            continue
        problem = with_variants(spark, inputs, variants, settings)
        found = P.brute_force(problem, tiered)
        if found is not None and not math.isinf(cost := P.overall(problem, found)) and (best is None or cost < best[0]):
            best = (cost, {"model_assignment": variants, "end_to_end_accuracy": accuracy, "cost": cost, "worker_assignment": {n: [w for w, _ in ws] for n, ws in found.workers}})
    return best[1] if best else None
