"""Queries of the placement inputs, searches and drivers.

Their problems are small by nature and given here; SQL states what each search must find.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from .operators import sets as S
from .plans import inputs as I
from .plans import placement as P
from .plans.tiers import STRATEGIES, partition_workers
from .queries import PRICES, _values, query, table
from .sources import files
from .storage import shared_folder

# A pool of workers for one node: speeds and costs from the parts.

POOL_SQL = "pool AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS place, p_partkey AS worker, p_size::DOUBLE AS speed, round(p_retailprice, 2) AS cost FROM part WHERE p_partkey <= 10)"
RATES = (5.0, 20.0, 60.0, 110.0)


def _pool(spark, sf):
    rows = table(spark, sf, "part").where("p_partkey <= 10").orderBy("p_partkey").select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("cost")).collect()  # ten
    return [(str(r.p_partkey), float(r.p_size), float(r.cost)) for r in rows]


SETS_SQL = f"""WITH {POOL_SQL}, r AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RATES)}]) AS rate),
s AS (SELECT mask, sum(speed) AS speed, round(sum(cost), 2) AS cost FROM (SELECT unnest(range(1, 1024)) AS mask), pool WHERE (mask >> place) & 1 = 1 GROUP BY mask)
"""


def _allocated(spark, sf, name):
    pool, cost = _pool(spark, sf), {}
    cost = {w: c for w, _, c in pool}
    rows = []
    for rate in RATES:
        got = P.ALLOCATE[name](pool, rate)
        if got:
            rows.append((rate, round(sum(cost[w] for w, _ in got), 2), round(sum(x for _, x in got), 6)))
    return spark.createDataFrame(rows, "rate double, cost double, served double")


@query(SETS_SQL + "SELECT rate, min(cost) AS cost, rate AS served FROM r JOIN s ON speed >= rate GROUP BY rate")
def allocation_dp(spark, sf):
    """The knapsack finds the cheapest set of workers."""
    return _allocated(spark, sf, "dp")


@query(SETS_SQL + "SELECT rate, min(cost) AS cost, rate AS served FROM r JOIN s ON speed >= rate GROUP BY rate")
def allocation_meet_in_the_middle(spark, sf):
    return _allocated(spark, sf, "meet-in-the-middle")


#: The cheapest able worker, else the best for its cost, until the rate is served.
GREEDY_SQL = f"""WITH RECURSIVE {POOL_SQL}, r AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in RATES)}]) AS rate),
g AS (
  SELECT rate, rate AS remaining, []::INT[] AS used, 0::INT AS step FROM r
  UNION ALL
  SELECT rate, remaining - pick.speed, list_append(used, pick.place), step + 1
  FROM (SELECT g.*, (SELECT arg_min({{'place': place, 'speed': speed}}, (CASE WHEN speed >= remaining THEN 0 ELSE 1 END, CASE WHEN speed >= remaining THEN cost ELSE cost / speed END, cost, place)) FROM pool WHERE NOT list_contains(used, place)) AS pick FROM g WHERE remaining > 0 AND len(used) < 10)),
done AS (SELECT rate, used, remaining FROM g WHERE remaining <= 0)
"""


@query(GREEDY_SQL + "SELECT rate, round((SELECT sum(cost) FROM pool WHERE list_contains(used, place)), 2) AS cost, rate AS served FROM done")
def allocation_greedy(spark, sf):
    return _allocated(spark, sf, "greedy")


#: Then the slowest are let go while the others still serve the rate.
BACKTRACE_SQL = (
    GREEDY_SQL
    + """, held AS (SELECT rate, -remaining AS spare, place, cost, sum(speed) OVER (PARTITION BY rate ORDER BY speed, list_position(used, place)) AS upto FROM done, pool WHERE list_contains(used, place))
SELECT rate, round(sum(cost) FILTER (upto > spare), 2) AS cost, rate AS served FROM held GROUP BY rate"""
)


@query(BACKTRACE_SQL)
def allocation_greedy_backtrace(spark, sf):
    return _allocated(spark, sf, "greedy-backtrace")


# A workflow of two stages on two tiers.

NODES = (("a", 20.0), ("b", 20.0))
WORKERS = [("l1", 1.0, 0), ("l2", 2.0, 0), ("l3", 4.0, 0), ("h1", 3.0, 1), ("h2", 5.0, 1)]
SPEEDS = {("a", "l1"): 12.0, ("a", "l2"): 15.0, ("a", "l3"): 25.0, ("a", "h1"): 30.0, ("a", "h2"): 60.0, ("b", "l1"): 6.0, ("b", "l2"): 8.0, ("b", "l3"): 14.0, ("b", "h1"): 25.0, ("b", "h2"): 50.0}
SIZE = {("src", "a"): 100.0, ("a", "b"): 400.0}


def _problem() -> P.Problem:
    low, high = ([w for w, _, t in WORKERS if t == tier] for tier in (0, 1))
    return P.Problem(
        costs={w: c for w, c, _ in WORKERS}, tiers=[low, high], edges=list(SIZE), latency={k: 1000.0 / v for k, v in SPEEDS.items()}, rates={"src": 20.0}, sizes=SIZE,
        links={(x, y): 1.0 for x in low for y in high}, source_links={("src", y): 1.0 for y in high}, link_scale=0.1,
    )


#: All assignments: for each node a set of workers that serves the rate and could not without one of them, cheapest with its traffic.
PLACED_SQL = f"""WITH w(worker, cost, tier) AS (VALUES {_values(WORKERS)}), sp(node, worker, speed) AS (VALUES {_values([(n, x, v) for (n, x), v in SPEEDS.items()])}),
o AS (SELECT *, (row_number() OVER (ORDER BY worker) - 1)::INT AS place FROM w),
m AS (SELECT node, mask, sum(speed) AS speed, sum(cost) AS cost, min(speed) AS least, min(tier) AS low, max(tier) AS high, max(speed) AS top FROM (SELECT unnest(range(1, 32)) AS mask), o JOIN sp USING (worker) WHERE (mask >> place) & 1 = 1 GROUP BY node, mask HAVING sum(speed) >= 20 AND sum(speed) - min(speed) < 20),
one AS (SELECT * FROM m WHERE low = high),
pair AS (SELECT x.cost + y.cost AS compute, x.low AS ta, y.low AS tb, round((CASE WHEN x.low > 0 THEN 20 * 100.0 ELSE 0 END + CASE WHEN y.low > x.low THEN 20 * 400.0 ELSE 0 END) * 3600 / 1024 / 1024 * 0.1, 9) AS traffic FROM one x JOIN one y ON x.node = 'a' AND y.node = 'b' AND x.mask & y.mask = 0 AND y.low >= x.low)
"""


def _costs(spark, found):
    problem = _problem()
    return spark.createDataFrame([(round(P.compute_cost(problem, a), 9), round(P.communication_cost(problem, a), 9)) for a in found], "compute double, traffic double")


@query(PLACED_SQL + "SELECT compute, traffic FROM pair ORDER BY compute + traffic LIMIT 1")
def placement_exhaustive(spark, sf):
    """Every assignment of whole tiers, the cheapest of them."""
    return _costs(spark, [P.brute_force(_problem(), tiered=True)])


@query(PLACED_SQL + "SELECT compute, traffic FROM pair ORDER BY compute + traffic LIMIT 1")
def strategy_all_tiers(spark, sf):
    """Every tier for every node, without a limit on states: what trying all assignments finds."""
    return _costs(spark, P.assign(_problem(), "all-tiers", "dp")[:1])


#: The first tier that serves a node on its own, at its cheapest.
@query(PLACED_SQL + ", fa AS (SELECT * FROM one WHERE node = 'a' ORDER BY low, cost LIMIT 1) SELECT fa.cost + y.cost AS compute, round((CASE WHEN fa.low > 0 THEN 20 * 100.0 ELSE 0 END + CASE WHEN y.low > fa.low THEN 20 * 400.0 ELSE 0 END) * 3600 / 1024 / 1024 * 0.1, 9) AS traffic FROM fa, one y WHERE y.node = 'b' AND y.mask & fa.mask = 0 AND y.low >= fa.low ORDER BY y.low, y.cost LIMIT 1")
def strategy_same_tier(spark, sf):
    return _costs(spark, P.assign(_problem(), "same-tier", "dp")[:1])


CROSS_SQL = PLACED_SQL + """, ca AS (SELECT *, round(CASE WHEN low > 0 THEN 20 * 100.0 ELSE 0 END * 3600 / 1024 / 1024 * 0.1, 9) AS up FROM one WHERE node = 'a'), fa AS (SELECT * FROM ca ORDER BY cost + up, mask LIMIT 1)
SELECT fa.cost + y.cost AS compute, round(fa.up + CASE WHEN y.low > fa.low THEN 20 * 400.0 ELSE 0 END * 3600 / 1024 / 1024 * 0.1, 9) AS traffic FROM fa, one y WHERE y.node = 'b' AND y.mask & fa.mask = 0 AND y.low >= fa.low ORDER BY fa.cost + y.cost + CASE WHEN y.low > fa.low THEN 20 * 400.0 ELSE 0 END * 3600 / 1024 / 1024 * 0.1 LIMIT 1"""


@query(CROSS_SQL)
def strategy_cross_tier(spark, sf):
    """Node by node, the tier that is cheapest with its traffic."""
    return _costs(spark, P.assign(_problem(), "cross-tier", "dp")[:1])


@query(CROSS_SQL)
def strategy_cross_tier_one_hop(spark, sf):
    """There is one hop only between two tiers."""
    return _costs(spark, P.assign(_problem(), "cross-tier-one-hop", "dp")[:1])


@query(PLACED_SQL + "SELECT count(*) > 0 AS found, true AS served, true AS bounded FROM pair")
def strategy_multiple_tiers(spark, sf):
    """Runs of tiers, allocated greedily: a plan that serves both nodes and costs no less than the best there is."""
    problem = _problem()
    found = P.assign(problem, "multiple-tiers", "greedy")
    served = all(abs(sum(x for _, x in a.of(n)) - rate) < 1e-6 for a in found for n, rate in NODES)
    bounded = P.overall(problem, found[0]) >= P.overall(problem, P.brute_force(problem)) - 1e-9
    return spark.createDataFrame([(bool(found), served, bounded)], "found boolean, served boolean, bounded boolean")


@query(PLACED_SQL + "SELECT compute, traffic, round(compute + traffic, 9) AS overall FROM pair ORDER BY compute + traffic LIMIT 1")
def evaluated_cost(spark, sf):
    problem = _problem()
    best = P.brute_force(problem, tiered=True)
    return _costs(spark, [best]).withColumn("overall", F.lit(round(P.overall(problem, best), 9)))


@query("SELECT * FROM (VALUES ('cpu-1', 0), ('cpu-2', 0), ('cpu-3', 1), ('gpu-1', 2), ('gpu-2', 2)) t(worker, tier)")
def tiers_from_links(spark, sf):
    """Workers that links of no cost join make a tier; tiers count by their least worker."""
    names = ["cpu-1", "cpu-2", "cpu-3", "gpu-1", "gpu-2"]
    group = {"cpu-1": 0, "cpu-2": 0, "cpu-3": 1, "gpu-1": 2, "gpu-2": 2}
    links = [(a, b, 1.0) for a, b in itertools.permutations(names, 2) if group[a] != group[b]]
    return P.tiers_by_links(spark.createDataFrame([(n,) for n in names], "worker string"), spark.createDataFrame(links, "a string, b string, cost double"))


@query("SELECT unnest(['greedy-modularity', 'louvain', 'girvan-newman', 'min-cut', 'spectral-clustering']) AS strategy, worker, tier FROM (VALUES ('cpu-1', 0), ('cpu-2', 0), ('cpu-3', 0), ('cpu-4', 0), ('gpu-1', 1), ('gpu-2', 1), ('gpu-3', 1)) t(worker, tier)")
def tiers_by_strategy(spark, sf):
    """Every partitioner finds two groups of near workers; the cheaper group comes first."""
    prices = {f"cpu-{k}": 0.2 * k for k in range(1, 5)} | {f"gpu-{k}": 2.5 for k in range(1, 4)}
    links = {(a, b): 0.1 if a[:3] == b[:3] else 9.0 for a, b in itertools.permutations(prices, 2)}
    rows = [(s, w, n) for s in STRATEGIES for n, t in enumerate(partition_workers(prices, links, s)) for w in t]
    return spark.createDataFrame(rows, "strategy string, worker string, tier int")


# Rates, orders and variants.

FLOW = [("cam", "image", 1.0), ("mic", "speech", 0.5), ("image", "vqa", 1.0), ("speech", "vqa", 2.0), ("vqa", "log", 0.1), ("image", "log", 1.0)]


@query(f"""WITH RECURSIVE e(u, v, ratio) AS (VALUES {_values(FLOW)}), s AS (SELECT 'cam' AS node, 20.0::DOUBLE AS rate UNION ALL SELECT 'mic', 10.0),
x AS (SELECT node, rate FROM s UNION ALL SELECT e.v, x.rate * e.ratio FROM x JOIN e ON e.u = x.node)
SELECT node, min(rate) AS rate FROM x GROUP BY node""")
def expected_rates(spark, sf):
    """A node is served at the least, over its inputs, of the input's rate times the edge's ratio."""
    problem = P.Problem({}, [], [(u, v) for u, v, _ in FLOW], {}, {"cam": 20.0, "mic": 10.0}, {}, ratios={(u, v): r for u, v, r in FLOW})
    return spark.createDataFrame([(n, float(r)) for n, r in problem.expected.items()], "node string, rate double")


@query(f"""WITH RECURSIVE e(u, v, ratio) AS (VALUES {_values(FLOW)}), n AS (SELECT DISTINCT v AS node FROM e),
o AS (SELECT []::VARCHAR[] AS done UNION ALL SELECT list_append(done, node) FROM o, n WHERE NOT list_contains(done, node) AND NOT EXISTS (SELECT 1 FROM e WHERE e.v = n.node AND e.u NOT IN ('cam', 'mic') AND NOT list_contains(done, e.u)))
SELECT array_to_string(done, ',') AS nodes FROM o WHERE len(done) = (SELECT count(*) FROM n)""")
def graph_orders(spark, sf):
    """All orders in which the nodes may be placed."""
    problem = P.Problem({}, [], [(u, v) for u, v, _ in FLOW], {}, {"cam": 20.0, "mic": 10.0}, {})
    return spark.createDataFrame([(",".join(o),) for o in problem.orders()], "nodes string")


IMAGE = [("small", 60.0, 1.0), ("medium", 72.0, 2.5), ("large", 80.0, 5.0)]
SPEECH = [("small", 50.0, 2.0), ("large", 90.0, 3.0)]
ANSWER = [(55.0, 45.0, 40.0), (55.0, 85.0, 56.0), (70.0, 45.0, 57.0), (75.0, 45.0, 58.0), (75.0, 85.0, 70.0)]


def _profiles() -> list[P.Profile]:
    image = P.Profile("image", (), {v: (((), acc),) for v, acc, _ in IMAGE}, {v: c for v, _, c in IMAGE})
    speech = P.Profile("speech", (), {v: (((), acc),) for v, acc, _ in SPEECH}, {v: c for v, _, c in SPEECH})
    vqa = P.Profile("vqa", ("image", "speech"), {"only": tuple(((i, s), out) for i, s, out in ANSWER)}, {"only": 1.0}, weight=2.0)
    return [image, speech, vqa]


BEAM_SQL = f"""WITH i(image, acc, cost) AS (VALUES {_values(IMAGE)}), s(speech, acc, cost) AS (VALUES {_values(SPEECH)}), a(wi, ws, acc) AS (VALUES {_values(ANSWER)})
SELECT DISTINCT image, speech, i.cost + s.cost + 2.0 AS cost FROM a JOIN i ON i.acc >= wi JOIN s ON s.acc >= ws WHERE a.acc >= 56.0"""


@query(BEAM_SQL)
def variants_beam_search(spark, sf):
    """Without limits, every choice of variants that reaches the accuracy."""
    got = P.beam_search(_profiles(), "vqa", 56.0, best_k=None)
    return spark.createDataFrame([(v["image"], v["speech"], float(c)) for v, c in got], "image string, speech string, cost double")


@query(f"SELECT image, speech, cost FROM ({BEAM_SQL}) ORDER BY cost LIMIT 1")
def variants_cheapest(spark, sf):
    """A beam of ten finds the cheapest choice."""
    got = P.beam_search(_profiles(), "vqa", 56.0, best_k=10)[:1]
    return spark.createDataFrame([(v["image"], v["speech"], float(c)) for v, c in got], "image string, speech string, cost double")


@query(f"WITH a(wi, ws, acc) AS (VALUES {_values(ANSWER)}) SELECT * FROM a WHERE acc >= 56.0 ORDER BY acc, wi, ws LIMIT 3")
def sampled_profile(spark, sf):
    """Samples that give the accuracy or more, the lowest first."""
    got = P.sample_profile(_profiles()[2], "only", 56.0, 3)
    return spark.createDataFrame([(i, s, acc) for (i, s), acc in got], "wi double, ws double, acc double")


CURVE = [(10.0, 20.0), (30.0, 50.0), (50.0, 60.0), (90.0, 64.0)]


@query(f"""WITH c(x, y) AS (VALUES {_values(CURVE)}), g AS (SELECT 10 + 20.0::DOUBLE * i AS x FROM (SELECT unnest(range(0, 5)) AS i)),
s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM c)
SELECT x, round(y, 9) AS y FROM c UNION ALL SELECT g.x, round(CASE WHEN x1 IS NULL THEN y0 ELSE y0 + (g.x - x0) * (y1 - y0) / (x1 - x0) END, 9) FROM g JOIN s ON g.x >= x0 AND (g.x < x1 OR x1 IS NULL)""")
def interpolated_profile(spark, sf):
    """A profile's samples and those between them, by straight lines."""
    profile = P.Profile("op", ("in",), {"v": tuple(((x,), y) for x, y in CURVE)}, {"v": 1.0})
    return spark.createDataFrame([(p[0], round(y, 9)) for p, y in P.interpolated(profile, 5).samples["v"]], "x double, y double")


#: Values of a plane: what lies on straight faces between samples is on it, too.
@query("SELECT x::DOUBLE AS x, z::DOUBLE AS z, (2 * x + 3 * z + 1)::DOUBLE AS y FROM (SELECT unnest([0, 5, 10]) AS x), (SELECT unnest([0, 5, 10]) AS z)")
def interpolated_surface(spark, sf):
    """With two inputs, the faces of the triangles between samples."""
    corners = tuple(((float(x), float(z)), 2.0 * x + 3.0 * z + 1) for x in (0, 10) for z in (0, 10))
    profile = P.Profile("op", ("a", "b"), {"v": corners}, {"v": 1.0})
    return spark.createDataFrame([(*p, round(y, 9)) for p, y in P.interpolated(profile, 3).samples["v"][4:]], "x double, z double, y double")


#: The thin plate spline through samples of a plane is the plane.
@query("SELECT x::DOUBLE AS x, z::DOUBLE AS z, (2 * x + 3 * z + 1)::DOUBLE AS y FROM (SELECT unnest([0, 5, 10]) AS x), (SELECT unnest([0, 5, 10]) AS z)")
def interpolated_spline(spark, sf):
    samples = tuple(((float(x), float(z)), 2.0 * x + 3.0 * z + 1) for x, z in ((0, 0), (0, 10), (10, 0), (10, 10), (3, 4)))
    profile = P.Profile("op", ("a", "b"), {"v": samples}, {"v": 1.0})
    return spark.createDataFrame([(*p, round(y, 6)) for p, y in P.interpolated(profile, 3, "rbf").samples["v"][5:]], "x double, z double, y double")


@query("SELECT * FROM (VALUES ('resnet18', 56.59::DOUBLE), ('resnet50', NULL)) t(image, accuracy)")
def measured_accuracy(spark, sf):
    """The measured accuracy of exactly these variants, if there is one."""
    measured = {(("image", "resnet18"), ("vqa", "default")): 56.59}
    rows = [(v, I.end_to_end_accuracy(measured, {"vqa": "default", "image": v})) for v in ("resnet18", "resnet50")]
    return spark.createDataFrame(rows, "image string, accuracy double")


# From a folder of tables to a plan.

FOLDER = {
    "logical_graph": [("cam", "image"), ("mic", "speech"), ("image", "vqa"), ("speech", "vqa")],
    "execution_profile": [("image", "small", "r18", 50.0), ("image", "large", "r18", 10.0), ("image", "large", "r152", 30.0), ("speech", "small", "base", 100.0), ("speech", "large", "base", 20.0), ("vqa", "large", "default", 5.0), ("vqa", "small", "default", 20.0)],
    "message_sizes": [("cam", "image", "default", "default", 800.0), ("mic", "speech", "default", "default", 100.0), ("image", "vqa", "r18", "default", 2.0), ("image", "vqa", "default", "default", 8.0), ("speech", "vqa", "default", "default", 0.1)],
    "input_injection_rates": [("cam", 20.0), ("mic", 10.0)],
}


def _folder(spark, **more) -> I.Inputs:
    folder = shared_folder(spark, "placement")
    for name, rows in (FOLDER | more).items():
        schema = files.PLACEMENT[name] if name != "throughput_normalization_ratios" else "u string, v string, ratio double"
        spark.createDataFrame(rows, schema).coalesce(1).write.csv(f"{folder}/{name}.csv")
    return I.read_folder(spark, folder)


@query("SELECT worker, cost, tier FROM (VALUES ('large_0', 3.0::DOUBLE, 0), ('large_1', 3.0, 0), ('small_0', 1.0, 1), ('small_1', 1.0, 1), ('small_2', 1.0, 1)) t(worker, cost, tier)")
def placement_by_numbers(spark, sf):
    """A number of workers of each type; free links join those of a type."""
    names = {"small": 3, "large": 2}
    every = [(t, f"{t}_{i}") for t, n in names.items() for i in range(n)]
    links = [(a, b, 1.0) for (t, a), (u, b) in itertools.permutations(every, 2) if t != u]
    given = _folder(spark, workers_specs=[("small", 1.0), ("large", 3.0)], workers_numbers=list(names.items()), workers_workers_link=links)
    tiers = spark.createDataFrame([(w, n) for n, t in enumerate(given.tiers) for w in t], "worker string, tier int")
    return given.workers.join(tiers, "worker").select("worker", "cost", "tier")


@query(f"SELECT worker, cost, 0 AS tier FROM (VALUES {_values([(w, c) for w, c, _ in PRICES])}) t(worker, cost)")
def placement_concrete(spark, sf):
    """Concrete workers without links: all are of one tier."""
    given = _folder(spark, workers_specs=[(w, c) for w, c, _ in PRICES])
    tiers = spark.createDataFrame([(w, n) for n, t in enumerate(given.tiers) for w in t], "worker string, tier int")
    return given.workers.join(tiers, "worker").select("worker", "cost", "tier")


@query("""SELECT * FROM (VALUES ('r18', 'cam', 'image', 800.0::DOUBLE, 1.0::DOUBLE), ('r18', 'image', 'vqa', 2.0, 0.5), ('r18', 'mic', 'speech', 100.0, 1.0), ('r18', 'speech', 'vqa', 0.1, 1.0),
('r152', 'cam', 'image', 800.0, 1.0), ('r152', 'image', 'vqa', 8.0, 0.5), ('r152', 'mic', 'speech', 100.0, 1.0), ('r152', 'speech', 'vqa', 0.1, 1.0)) t(model, u, v, size, ratio)""")
def variants_assigned(spark, sf):
    """Sizes and ratios of a choice of variants, those of the default variant where the variant has none."""
    given, rows = _folder(spark, workers_specs=[("small", 1.0), ("large", 3.0)], throughput_normalization_ratios=[("image", "vqa", 0.5)]), []
    for model in ("r18", "r152"):
        problem = I.with_variants(spark, given, {"image": model, "speech": "base", "vqa": "default"}, I.Settings())
        rows += [(model, u, v, problem.sizes[(u, v)], float(problem.ratios[(u, v)])) for u, v in problem.edges]
    return spark.createDataFrame(rows, "model string, u string, v string, size double, ratio double")


#: Five workers, three of cost 1 and two of cost 3: image needs a small one (20 a second) or a large one, speech one small (10 a second), vqa a small one (50 a second).
PLANNED_SQL = "SELECT 'r18' AS image, 3.0::DOUBLE AS cost, 51.0::DOUBLE AS accuracy, 3::BIGINT AS workers"


def _given(spark) -> I.Inputs:
    return _folder(spark, workers_specs=[("small", 1.0), ("large", 3.0)], workers_numbers=[("small", 3), ("large", 2)])


MEASURED = {(("image", "r18"), ("speech", "base"), ("vqa", "default")): 51.0, (("image", "r152"), ("speech", "base"), ("vqa", "default")): 61.0}


@query(PLANNED_SQL)
def placement_driver(spark, sf):
    """From the tables to the cheapest plan: variants by beam search, workers by assignment."""
    image = P.Profile("image", (), {"r18": (((), 60.0),), "r152": (((), 80.0),)}, {"r18": 1.0, "r152": 2.0})
    speech = P.Profile("speech", (), {"base": (((), 50.0),)}, {"base": 1.0})
    vqa = P.Profile("vqa", ("image", "speech"), {"default": (((60.0, 50.0), 50.0), ((80.0, 50.0), 60.0))}, {"default": 1.0})
    plan = I.optimize(spark, _given(spark), [image, speech, vqa], "vqa", 45.0, I.Settings(strategy="all-tiers", allocation="dp"), MEASURED)
    rows = [(plan["model_assignment"]["image"], plan["compute_cost"] + plan["communication_cost"], plan["end_to_end_accuracy"], sum(map(len, plan["worker_assignment"].values())))]
    return spark.createDataFrame(rows, "image string, cost double, accuracy double, workers long")


@query(PLANNED_SQL)
def exhaustive_driver(spark, sf):
    """Every accurate choice of variants with every assignment."""
    choices = [({n: m for n, m in names}, accuracy) for names, accuracy in MEASURED.items()]
    plan = I.exhaustive(spark, _given(spark), choices, 45.0, I.Settings())
    rows = [(plan["model_assignment"]["image"], plan["cost"], plan["end_to_end_accuracy"], sum(map(len, plan["worker_assignment"].values())))]
    return spark.createDataFrame(rows, "image string, cost double, accuracy double, workers long")


@query("SELECT 'edges' AS kind, 3::BIGINT AS n UNION ALL SELECT 'nodes', 4")
def flow_graph(spark, sf):
    """What a builder keeps of a workflow: its named operators and the edges between them."""
    from .plans.workflow import FlowBuilder

    flow = FlowBuilder()
    rows = flow.input("Orders", table(spark, sf, "orders")).filter("Large", F.col("o_totalprice") > 100000)
    rows.union("Both", flow.input("Orders", table(spark, sf, "orders")))
    counts = [("edges", len(flow.edges)), ("nodes", len(flow.nodes))]
    return S.concatenate([spark.createDataFrame([c], "kind string, n long") for c in counts])
