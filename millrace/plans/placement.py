"""Choosing model variants and workers for a multi-stage inference workflow.

Costs, traffic, lookups and exhaustive search are DataFrame queries; the heuristic searches are small
decision problems (a few nodes, tens of workers) and run on the driver over plain values.

A node is served at the least, over its inputs, of the input's rate times the edge's ratio. Traffic flows
from lower tiers to higher ones; sources sit on the first tier. A worker serves one node.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import gb_per_hour

EPSILON = 1e-9
STRATEGIES = ("same-tier", "cross-tier", "cross-tier-one-hop", "all-tiers", "multiple-tiers")
ALLOCATIONS = ("greedy", "greedy-backtrace", "dp", "meet-in-the-middle")


@dataclass
class Problem:
    """One choice of variants: latencies (ms) by (node, worker), message sizes (KB) and ratios by edge."""

    costs: dict[str, float]
    tiers: list[list[str]]
    edges: list[tuple[str, str]]
    latency: dict[tuple[str, str], float]
    rates: dict[str, float]
    sizes: dict[tuple[str, str], float]
    ratios: dict[tuple[str, str], float] = field(default_factory=dict)
    links: dict[tuple[str, str], float] = field(default_factory=dict)
    source_links: dict[tuple[str, str], float] = field(default_factory=dict)
    link_scale: float = 1.0

    def __post_init__(self) -> None:
        if len(set(self.edges)) != len(self.edges) or any((v, u) in set(self.edges) for u, v in self.edges):
            raise ValueError("edges are given twice or in both directions")
        self.tier = {w: i for i, t in enumerate(self.tiers) for w in t}
        if sum(map(len, self.tiers)) != len(self.tier):
            raise ValueError("a worker is in several tiers")
        self.speed = {k: 1000.0 / ms for k, ms in self.latency.items() if not math.isnan(ms) and ms > 0}
        self.inputs: dict[str, list[str]] = {}
        for u, v in self.edges:
            self.inputs.setdefault(v, []).append(u)
        self.expected: dict[str, float] = dict(self.rates)
        for v in self.order():
            if v not in self.rates:
                self.expected[v] = min(self.expected[u] * self.ratios.get((u, v), 1.0) for u in self.inputs[v])

    def order(self) -> list[str]:
        graph = {v: set(us) for v, us in self.inputs.items()} | {s: set() for s in self.rates}
        return list(TopologicalSorter(graph).static_order())

    def orders(self, most: int | None = None) -> Iterator[list[str]]:
        """All topological orders of the nodes that aren't sources, or the first ``most``."""

        def extend(done: list[str], left: list[str]) -> Iterator[list[str]]:
            if not left:
                yield done
            for v in left:
                if all(u in self.rates or u in done for u in self.inputs[v]):
                    yield from extend([*done, v], [x for x in left if x != v])

        return itertools.islice(extend([], [v for v in self.order() if v not in self.rates]), most)


@dataclass(frozen=True)
class Assignment:
    """By node: (worker, the share of the node's rate that it serves)."""

    workers: tuple[tuple[str, tuple[tuple[str, float], ...]], ...] = ()

    def of(self, node: str) -> tuple[tuple[str, float], ...]:
        return dict(self.workers)[node]

    def used(self) -> set[str]:
        return {w for _, ws in self.workers for w, _ in ws}

    def add(self, node: str, ws: list[tuple[str, float]]) -> Assignment:
        return Assignment((*self.workers, (node, tuple(ws))))


# Allocation of one node to workers of a pool: (worker, speed, cost) triples.


def _shared(chosen: list[tuple[str, float, float]], rate: float) -> list[tuple[str, float]]:
    """Each takes as much as it can, in order; workers that would get nothing are left out."""
    out, left = [], rate
    for w, speed, _ in chosen:
        if left <= EPSILON * rate:
            break
        out.append((w, min(speed, left)))
        left -= min(speed, left)
    return out if left <= EPSILON * max(rate, 1.0) else []


def _greedy_choice(pool: list[tuple[str, float, float]], rate: float) -> list[tuple[str, float, float]]:
    """The cheapest worker that can serve all that is left; while there is none, the one of least cost for its speed."""
    chosen, rest, left = [], list(pool), rate
    while left > EPSILON * rate and rest:
        able = [x for x in rest if x[1] >= left]
        pick = min(able, key=lambda x: x[2]) if able else min(rest, key=lambda x: (x[2] / x[1], x[2]))
        chosen.append(pick)
        rest.remove(pick)
        left -= pick[1]
    return chosen if left <= EPSILON * rate else []


def greedy(pool: list[tuple[str, float, float]], rate: float) -> list[tuple[str, float]]:
    return _shared(_greedy_choice(pool, rate), rate)


def greedy_backtrace(pool: list[tuple[str, float, float]], rate: float) -> list[tuple[str, float]]:
    """Greedy; then the slowest workers that the others make needless are let go."""
    chosen = sorted(_greedy_choice(pool, rate), key=lambda x: x[1])
    spare = sum(x[1] for x in chosen) - rate
    while chosen and chosen[0][1] <= spare:
        spare -= chosen.pop(0)[1]
    return _shared(chosen, rate)


def knapsack(pool: list[tuple[str, float, float]], rate: float, scale: int = 100) -> list[tuple[str, float]]:
    """The dearest set of workers that can be let go while the others serve the rate, in hundredths of a request."""
    sizes = [math.floor(x[1] * scale) for x in pool]
    spare = sum(sizes) - math.ceil(rate * scale - EPSILON)
    if spare < 0:
        return []
    best = np.zeros((len(pool) + 1, spare + 1))
    for m, (size, (_, _, cost)) in enumerate(zip(sizes, pool), 1):
        best[m] = best[m - 1]
        if size <= spare:
            best[m, size:] = np.maximum(best[m, size:], best[m - 1, : spare + 1 - size] + cost)
    kept, room = [], spare
    for m in range(len(pool), 0, -1):
        if best[m, room] > best[m - 1, room]:
            room -= sizes[m - 1]
        else:
            kept.append(pool[m - 1])
    return _shared(sorted(kept, key=lambda x: -x[1]), rate)


def meet_in_the_middle(pool: list[tuple[str, float, float]], rate: float) -> list[tuple[str, float]]:
    """The cheapest set that serves the rate: both halves' subsets, matched by speed."""

    def subsets(items):
        return [(sum(x[1] for x in s), sum(x[2] for x in s), s) for n in range(len(items) + 1) for s in itertools.combinations(items, n)]

    half = len(pool) // 2
    left, right = subsets(pool[:half]), sorted(subsets(pool[half:]), key=lambda s: s[0])
    speeds = [s[0] for s in right]
    cheapest = list(right)  # the cheapest of all at least as fast
    for i in range(len(cheapest) - 2, -1, -1):
        cheapest[i] = min(cheapest[i], cheapest[i + 1], key=lambda s: s[1])
    found = None
    for speed, cost, s in left:
        at = int(np.searchsorted(speeds, rate - speed - EPSILON))
        if at < len(cheapest) and (found is None or cost + cheapest[at][1] < found[0]):
            found = (cost + cheapest[at][1], [*s, *cheapest[at][2]])
    return _shared(sorted(found[1], key=lambda x: -x[1]), rate) if found else []


ALLOCATE = {"greedy": greedy, "greedy-backtrace": greedy_backtrace, "dp": knapsack, "meet-in-the-middle": meet_in_the_middle}


def compute_cost(problem: Problem, assignment: Assignment) -> float:
    return sum(problem.costs[w] for w in assignment.used())


def communication_cost(problem: Problem, assignment: Assignment, backward: bool = False) -> float:
    """Link costs times GB an hour across tiers. Traffic to a lower tier is infinitely dear, unless it is allowed."""
    total = 0.0
    for u, v in problem.edges:
        given = dict(assignment.workers)
        if v not in given or u not in given and u not in problem.rates:
            continue
        ends = given[v]
        rate = sum(x for _, x in ends)
        volume = rate * problem.sizes[(u, v)]
        starts = [(None, 1.0)] if u in problem.rates else [(w, x / sum(y for _, y in given[u])) for w, x in given[u]]
        for (a, share_a), (b, x) in itertools.product(starts, ends):
            from_tier, to_tier = 0 if a is None else problem.tier[a], problem.tier[b]
            traffic = volume * share_a * (x / rate) * 3600 / 1024 / 1024
            if from_tier > to_tier and not backward:
                return math.inf
            if from_tier != to_tier:
                link = problem.source_links.get((u, b), 0.0) if a is None else problem.links.get((a, b), 0.0)
                total += link * problem.link_scale * traffic
    return total


def _pool(problem: Problem, node: str, tiers: range, used: set[str]) -> list[tuple[str, float, float]]:
    return [(w, problem.speed[(node, w)], problem.costs[w]) for t in tiers for w in problem.tiers[t] if w not in used and (node, w) in problem.speed]


def _floor(problem: Problem, node: str, assignment: Assignment) -> int:
    """The highest tier that an input of the node is on."""
    return max((problem.tier[w] for u in problem.inputs[node] if u not in problem.rates for w, _ in assignment.of(u)), default=0)


def _choices(problem: Problem, node: str, state: Assignment, strategy: str, allocate) -> Iterator[Assignment]:
    low, high = _floor(problem, node, state), len(problem.tiers)
    if strategy == "multiple-tiers":
        spans = [range(a, b) for a in range(low, high) for b in range(a + 1, high + 1)]
    else:
        spans = [range(t, t + 1) for t in range(low, min(high, low + 2) if strategy == "cross-tier-one-hop" else high)]
    for tiers in spans:
        if got := allocate(_pool(problem, node, tiers, state.used()), problem.expected[node]):
            yield state.add(node, got)
            if strategy == "same-tier":
                return


def overall(problem: Problem, assignment: Assignment) -> float:
    return compute_cost(problem, assignment) + communication_cost(problem, assignment)


def assign(problem: Problem, strategy: str = "same-tier", allocation: str = "dp", most_orders: int | None = None, best_k: int | None = None) -> list[Assignment]:
    """Assignments found, the cheapest overall first (none if the rate can't be served).

    same-tier: the first tier that can serve the node, not below its inputs'. cross-tier: the tier that is
    cheapest with its traffic, at most one above with -one-hop. all-tiers and multiple-tiers keep the best_k
    cheapest states (all, if None) over every tier, or every run of tiers, and over several orders of nodes.
    """
    if strategy not in STRATEGIES or allocation not in ALLOCATIONS:
        raise ValueError(f"unknown strategy or allocation: {strategy}, {allocation}")
    if allocation == "dp" and strategy == "multiple-tiers" or allocation == "meet-in-the-middle" and strategy == "multiple-tiers":
        raise ValueError("several tiers are allocated greedily only")
    allocate, wide = ALLOCATE[allocation], strategy in ("all-tiers", "multiple-tiers")
    ended: dict[Assignment, float] = {}
    for order in problem.orders(most_orders if wide else 1):
        states = [Assignment()]
        for node in order:
            after = {a for s in states for a in _choices(problem, node, s, strategy, allocate)}
            ranked = sorted(((overall(problem, a), a) for a in after), key=lambda x: (x[0], x[1].workers))
            states = [a for cost, a in ranked if not math.isinf(cost)][: best_k if wide else 1]
        ended |= {a: overall(problem, a) for a in states}
    return sorted(ended, key=lambda a: (ended[a], a.workers))


def all_assignments(problem: Problem, tiered: bool = False) -> Iterator[Assignment]:
    """Every minimal assignment: each node any set of free workers that can serve it (of one tier, if tiered) and could not without one of them."""

    def extend(state: Assignment, order: list[str]) -> Iterator[Assignment]:
        if not order:
            yield state
            return
        node, rate = order[0], problem.expected[order[0]]
        pools = [_pool(problem, node, range(t, t + 1), state.used()) for t in range(len(problem.tiers))] if tiered else [_pool(problem, node, range(len(problem.tiers)), state.used())]
        for pool in pools:
            for n in range(1, len(pool) + 1):
                for s in itertools.combinations(pool, n):
                    speed = sum(x[1] for x in s)
                    if speed >= rate - EPSILON and all(speed - x[1] < rate - EPSILON for x in s):
                        yield from extend(state.add(node, _shared(sorted(s, key=lambda x: -x[1]), rate)), order[1:])

    return extend(Assignment(), [v for v in problem.order() if v not in problem.rates])


def brute_force(problem: Problem, tiered: bool = False) -> Assignment | None:
    return min(all_assignments(problem, tiered), key=lambda a: overall(problem, a), default=None)


# Model variants.


@dataclass(frozen=True)
class Profile:
    """By variant: (accuracies asked of the inputs, accuracy given); the variant's cost, the operator's weight."""

    op: str
    inputs: tuple[str, ...]
    samples: dict[str, tuple[tuple[tuple[float, ...], float], ...]]
    cost: dict[str, float]
    weight: float = 1.0

    def __hash__(self) -> int:
        return hash(self.op)


def sample_profile(profile: Profile, variant: str, threshold: float, limit: int | None = None) -> list[tuple[tuple[float, ...], float]]:
    """Samples that give the threshold or more, the lowest first."""
    return sorted((s for s in profile.samples[variant] if s[1] >= threshold), key=lambda s: (s[1], s[0]))[:limit]


def on_faces(x: np.ndarray, y: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The values at ``points`` on the faces of the Delaunay triangulation of the samples; NaN outside of their hull.

    Of all simplices that hold a point, the triangulation's is the one with the least mean of squared norms at its
    corners. A profile has tens of samples, so all simplices are tried.
    """
    corners = np.array(list(itertools.combinations(range(len(x)), x.shape[1] + 1)), int).reshape(-1, x.shape[1] + 1)
    systems = np.concatenate([x[corners].transpose(0, 2, 1), np.ones((len(corners), 1, x.shape[1] + 1))], axis=1)
    solid = np.abs(np.linalg.det(systems)) > 1e-12
    corners, systems = corners[solid], systems[solid]
    inverse, lifted = np.linalg.inv(systems), (x**2).sum(axis=1)[corners]
    out = np.full(len(points), np.nan)
    for n, point in enumerate(points):
        shares = inverse @ np.append(point, 1.0)
        held = np.flatnonzero((shares >= -1e-9).all(axis=1))
        if len(held):
            k = held[np.argmin((shares[held] * lifted[held]).sum(axis=1))]
            out[n] = shares[k] @ y[corners[k]]
    return out


def on_spline(x: np.ndarray, y: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The values at ``points`` of the thin plate spline through the samples, with a linear part."""

    def bent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = np.linalg.norm(a[:, None] - b[None], axis=2)
        return np.where(r > 0, r**2 * np.log(np.maximum(r, 1e-300)), 0.0)

    flat, n = np.column_stack([np.ones(len(x)), x]), len(x)
    system = np.block([[bent(x, x), flat], [flat.T, np.zeros((flat.shape[1], flat.shape[1]))]])
    weights = np.linalg.lstsq(system, np.append(y, np.zeros(flat.shape[1])), rcond=None)[0]
    return bent(points, x) @ weights[:n] + np.column_stack([np.ones(len(points)), points]) @ weights[n:]


def interpolated(profile: Profile, points: int = 5, method: str = "linear") -> Profile:
    """Each variant's samples and those on an even grid over them: linear (where the grid lies within their hull), or a thin plate spline ("rbf")."""
    if method not in ("linear", "rbf"):
        raise ValueError(f"unknown method: {method}")
    out = {}
    for variant, samples in profile.samples.items():
        x, y = np.array([s[0] for s in samples], float), np.array([s[1] for s in samples], float)
        more: list[tuple[tuple[float, ...], float]] = []
        if x.size and x.shape[1]:
            grid = np.array(list(itertools.product(*(np.linspace(x[:, k].min(), x[:, k].max(), points) for k in range(x.shape[1])))))
            if method == "rbf":
                values = on_spline(x, y, grid)
            elif x.shape[1] == 1:
                at = np.argsort(x[:, 0])
                values = np.interp(grid[:, 0], x[at, 0], y[at])
            else:
                values = on_faces(x, y, grid)
            more = [(tuple(float(c) for c in point), float(v)) for point, v in zip(grid, values) if not math.isnan(v)]
        out[variant] = (*samples, *more)
    return Profile(profile.op, profile.inputs, out, profile.cost, profile.weight)


def beam_search(profiles: list[Profile], sink: str, threshold: float, best_k: int | None = 10, sample_limit: int | None = None, expansions: int | None = None) -> list[tuple[dict[str, str], float]]:
    """(variant by operator, cost), cheapest first: from the sink back, each operator must give the most that any consumer asks."""
    by = {p.op: p for p in profiles}
    order = [op for op in reversed(list(TopologicalSorter({p.op: [i for i in p.inputs if i in by] for p in profiles}).static_order())) if op != sink]
    states: list[tuple[float, dict[str, str], dict[str, float]]] = [(0.0, {}, {sink: threshold})]
    for op in [sink, *order]:
        profile, after = by[op], {}
        for cost, chosen, asked in states:
            grown = []
            for variant in profile.samples:
                for wants, _ in sample_profile(profile, variant, asked.get(op, 0.0), sample_limit):
                    more = dict(asked)
                    for source, want in zip(profile.inputs, wants):
                        more[source] = max(more.get(source, 0.0), want)
                    grown.append((cost + profile.weight * profile.cost[variant], {**chosen, op: variant}, more))
            grown.sort(key=lambda s: (s[0], sorted(s[2].items())))
            for state in grown[:expansions]:
                after.setdefault((tuple(sorted(state[1].items())), tuple(sorted(state[2].items()))), state)
        states = sorted(after.values(), key=lambda s: (s[0], sorted(s[2].items()), sorted(s[1].items())))[:best_k]
    best: dict[tuple, tuple[dict[str, str], float]] = {}
    for cost, chosen, _ in states:
        best.setdefault(tuple(sorted(chosen.items())), (chosen, cost))
    return list(best.values())


def best_plan(candidates: list[tuple[dict[str, str], float, Problem]], **how) -> dict | None:
    """Over (variants, accuracy, problem): the plan of least overall cost; of equal ones, the more accurate."""
    best: tuple[float, float, dict] | None = None
    for variants, accuracy, problem in candidates:
        for a in assign(problem, **how):
            cost = overall(problem, a)
            if best is None or cost < best[0] and not math.isclose(cost, best[0], rel_tol=1e-5, abs_tol=1e-8) or math.isclose(cost, best[0], rel_tol=1e-5, abs_tol=1e-8) and accuracy > best[1]:
                plan = {"communication_cost": communication_cost(problem, a), "compute_cost": compute_cost(problem, a), "end_to_end_accuracy": accuracy, "model_assignment": variants, "worker_assignment": {n: [w for w, _ in ws] for n, ws in a.workers}}
                best = (cost, accuracy, plan)
    return best[2] if best else None


# As queries.


def assigned_frame(spark: SparkSession, assignment: Assignment) -> DataFrame:
    return spark.createDataFrame([(n, w, float(x)) for n, ws in assignment.workers for w, x in ws], "node string, worker string, rate double")


def edge_traffic(edges: DataFrame, assigned: DataFrame, tiers: DataFrame, sizes: DataFrame) -> DataFrame:
    """(u, v, u_worker, v_worker, u_tier, v_tier, kb): KB a second between workers; a source is on tier 0 and has no worker.

    edges (u, v), assigned (node, worker, rate), tiers (worker, tier), sizes (u, v, size).
    """
    served = assigned.groupBy("node").agg(F.sum("rate").alias("total"))
    share = assigned.join(served, "node").join(tiers, "worker").select("node", "worker", "tier", "rate", (F.col("rate") / F.col("total")).alias("share"))
    start = share.select(F.col("node").alias("u"), F.col("worker").alias("u_worker"), F.col("tier").alias("u_tier"), F.col("share").alias("u_share"))
    end = share.select(F.col("node").alias("v"), F.col("worker").alias("v_worker"), F.col("tier").alias("v_tier"), F.col("rate").alias("v_rate"))
    flows = edges.join(sizes, ["u", "v"]).join(end, "v").join(start, "u", "left")
    kb = F.col("v_rate") * F.col("size") * F.coalesce("u_share", F.lit(1.0))
    return flows.select("u", "v", "u_worker", "v_worker", F.coalesce("u_tier", F.lit(0)).alias("u_tier"), "v_tier", kb.alias("kb"))


def communication_cost_query(traffic: DataFrame, links: DataFrame, source_links: DataFrame, scale: float = 1.0, backward: bool = False) -> DataFrame:
    """(communication_cost): links (a, b, cost), source_links (source, worker, cost); missing links cost 0."""
    joined = traffic.join(links.select(F.col("a").alias("u_worker"), F.col("b").alias("v_worker"), F.col("cost").alias("link")), ["u_worker", "v_worker"], "left")
    joined = joined.join(source_links.select(F.col("source").alias("u"), F.col("worker").alias("v_worker"), F.col("cost").alias("from_source")), ["u", "v_worker"], "left")
    link = F.coalesce(F.when(F.col("u_worker").isNull(), F.col("from_source")).otherwise(F.col("link")), F.lit(0.0)) * scale
    cost = F.when(F.col("u_tier") == F.col("v_tier"), 0.0)
    if not backward:
        cost = cost.when(F.col("u_tier") > F.col("v_tier"), float("inf"))
    return joined.agg(F.sum(cost.otherwise(link * gb_per_hour(F.col("kb")))).alias("communication_cost"))


def traffic_volume_query(traffic: DataFrame, forward: float = 1.0, backward: float = 10.0) -> DataFrame:
    """(traffic_volume): GB an hour across tiers, backward traffic weighted."""
    weight = F.when(F.col("u_tier") < F.col("v_tier"), forward).when(F.col("u_tier") > F.col("v_tier"), backward).otherwise(0.0)
    return traffic.agg(F.sum(weight * gb_per_hour(F.col("kb"))).alias("traffic_volume"))


def compute_cost_query(assigned: DataFrame, workers: DataFrame) -> DataFrame:
    return assigned.select("worker").distinct().join(workers, "worker").agg(F.sum("cost").alias("compute_cost"))


def subsets_query(workers: DataFrame, order: str, rate: float) -> DataFrame:
    """(mask, speed, cost) of every set of workers (order, speed, cost) that serves the rate: two to the number of workers, so for tens at most."""
    n = workers.count()
    if n > 20:
        raise ValueError("too many workers to try every set")
    placed = workers.withColumn("__bit", F.col(order))
    masks = workers.sparkSession.range(1, 1 << n).withColumnRenamed("id", "mask")
    member = F.expr("shiftright(mask, __bit) & 1") == 1
    return masks.join(F.broadcast(placed), member).groupBy("mask").agg(F.sum("speed").alias("speed"), F.sum("cost").alias("cost")).where(F.col("speed") >= rate)


def tiers_by_links(workers: DataFrame, links: DataFrame) -> DataFrame:
    """(worker, tier): workers that are joined by links of no cost make a tier; tiers count by their least worker."""
    from pyspark.sql import Window

    from ..operators.graph import connected_components

    names = sorted(r.worker for r in workers.select("worker").distinct().collect())  # tens of workers
    free = workers.sparkSession.createDataFrame(list(itertools.combinations(names, 2)), "src string, dst string")
    dear = links.where("cost > 0").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    joined = free.join(dear, ["src", "dst"], "left_anti").unionByName(workers.select(F.col("worker").alias("src"), F.col("worker").alias("dst")))
    found = connected_components(joined)
    return found.select(F.col("node").alias("worker"), (F.dense_rank().over(Window.orderBy("component")) - 1).alias("tier"))


def balance_weights(rates: list[float]) -> list[int]:
    """Whole-number shares of about a hundred, at least 1 each."""
    total = sum(rates)
    return [max(math.floor(100 * r / total + 0.5), 1) for r in rates]


def balanced(key, weights: list[int]):
    """The worker (from 0) of a key: keys spread over the weights' cumulative buckets."""
    place = F.pmod(key, F.lit(sum(weights)))
    out = F.lit(len(weights) - 1)
    for n, w in reversed(list(enumerate(weights))):
        out = F.when(place < sum(weights[: n + 1]), F.lit(n)).otherwise(out)
    return out


def stage_io(edges: DataFrame, stages: DataFrame) -> DataFrame:
    """(stage, inputs, outputs): operators whose results a stage needs from others, and those that others need from it.

    edges (u, v), stages (node, stage).
    """
    a = stages.select(F.col("node").alias("u"), F.col("stage").alias("u_stage"))
    b = stages.select(F.col("node").alias("v"), F.col("stage").alias("v_stage"))
    cut = edges.join(a, "u").join(b, "v").where("u_stage <> v_stage")
    ins = cut.groupBy(F.col("v_stage").alias("stage")).agg(F.sort_array(F.collect_set("u")).alias("inputs"))
    outs = cut.groupBy(F.col("u_stage").alias("stage")).agg(F.sort_array(F.collect_set("u")).alias("outputs"))
    none = F.array().cast("array<string>")
    found = stages.select("stage").distinct().join(ins, "stage", "left").join(outs, "stage", "left")
    return found.select("stage", F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"))
