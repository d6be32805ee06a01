import json
import math
import random

import pytest

from millrace.plans import placement as P
from millrace.sources import files


def problem(rng, nodes=3, workers=5):
    names = [f"w{i}" for i in range(workers)]
    cut = rng.randrange(1, workers)
    edges = [("src", "n0")] + [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, nodes)]
    return P.Problem(
        costs={w: float(rng.randrange(1, 9)) for w in names},
        tiers=[names[:cut], names[cut:]],
        edges=edges,
        latency={(f"n{i}", w): 1000 / rng.randrange(5, 60) for i in range(nodes) for w in names if rng.random() < 0.9},
        rates={"src": 20.0},
        sizes={e: rng.random() * 100 for e in edges},
        links={(a, b): 1.0 for a in names[:cut] for b in names[cut:]},
        source_links={("src", w): 1.0 for w in names[cut:]},
        link_scale=0.1,
    )


def served(p, a):
    for n, ws in a.workers:
        assert math.isclose(sum(x for _, x in ws), p.expected[n])
        assert all(x <= p.speed[(n, w)] + 1e-9 for w, x in ws)
    used = [w for _, ws in a.workers for w, _ in ws]
    assert len(used) == len(set(used))


@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_searches_never_beat_brute_force(strategy):
    rng, found = random.Random(1), 0
    for _ in range(40):
        p = problem(rng)
        best = P.brute_force(p)
        for allocation in ("greedy", "greedy-backtrace") if strategy == "multiple-tiers" else P.ALLOCATIONS:
            for a in P.assign(p, strategy, allocation, best_k=10):
                served(p, a)
                assert not math.isinf(P.overall(p, a)) and P.overall(p, a) >= P.overall(p, best) - 1e-6
                found += 1
    assert found > 20


def test_allocations():
    pool = [("a", 10.0, 3.0), ("b", 6.0, 1.0), ("c", 5.0, 1.0), ("d", 30.0, 9.0)]
    cost = lambda got: sum(dict((w, c) for w, _, c in pool)[w] for w, _ in got)
    for rate in (4.0, 9.0, 11.0, 20.0, 40.0, 51.0):
        least = cost(P.meet_in_the_middle(pool, rate))
        assert cost(P.knapsack(pool, rate)) == least
        for f in (P.greedy, P.greedy_backtrace):
            got = f(pool, rate)
            assert math.isclose(sum(x for _, x in got), rate) and cost(got) >= least
    assert all(f(pool, 52.0) == [] for f in P.ALLOCATE.values())


def test_query_costs_equal_plain_costs(spark):
    rng = random.Random(2)
    for _ in range(4):
        p = problem(rng)
        a = next(iter(P.assign(p, "multiple-tiers", "greedy", best_k=5)), None)
        if a is None:
            continue
        frame = P.assigned_frame(spark, a)
        tiers = spark.createDataFrame(list(p.tier.items()), "worker string, tier int")
        sizes = spark.createDataFrame([(u, v, s) for (u, v), s in p.sizes.items()], "u string, v string, size double")
        traffic = P.edge_traffic(sizes.select("u", "v"), frame, tiers, sizes)
        links = spark.createDataFrame([(x, y, c) for (x, y), c in p.links.items()], "a string, b string, cost double")
        sources = spark.createDataFrame([(x, y, c) for (x, y), c in p.source_links.items()], "source string, worker string, cost double")
        assert math.isclose(P.communication_cost_query(traffic, links, sources, p.link_scale).first()[0], P.communication_cost(p, a), abs_tol=1e-9)
        workers = spark.createDataFrame(list(p.costs.items()), "worker string, cost double")
        assert math.isclose(P.compute_cost_query(frame, workers).first()[0], P.compute_cost(p, a))


# A published plan's latencies in milliseconds and its costs.
PRICES = {"cpu-1": 0.096, "cpu-2": 0.192, "cpu-3": 0.384, "cpu-4": 0.384, "cpu-5": 0.768, "cpu-6": 2.305, "gpu-1": 2.497, "gpu-2": 2.497, "gpu-3": 2.497}


def test_published_plan_costs():
    low, high = ["cpu-1", "cpu-2", "cpu-3", "cpu-4", "cpu-5"], ["cpu-6", "gpu-1", "gpu-2", "gpu-3"]
    sizes = {("ReadImage", "Image"): 794.0348300933838, ("ReadSpeech", "Speech"): 97.07174682617188, ("Image", "VQA"): 2.00390625, ("Speech", "VQA"): 0.10}
    p = P.Problem(
        costs=PRICES, tiers=[low, high], edges=list(sizes), rates={"ReadImage": 40.0, "ReadSpeech": 40.0}, sizes=sizes, link_scale=0.1, latency={},
        links={(a, b): 1.0 for a in low for b in high}, source_links={(s, b): 1.0 for s in ("ReadImage", "ReadSpeech") for b in high},
    )
    speech = 40 - 2.8180
    a = P.Assignment((("Image", (("cpu-1", 7.4), ("cpu-2", 9.97), ("cpu-5", 22.63))), ("Speech", (("gpu-1", speech), ("cpu-3", 40 - speech))), ("VQA", (("cpu-6", 40.0),))))
    assert math.isclose(P.compute_cost(p, a), 6.242)
    assert math.isclose(P.communication_cost(p, a), 1.2667783071018048, rel_tol=1e-4)


def test_beam_search():
    image = P.Profile("image", (), {"small": (((), 60.0),), "large": (((), 80.0),)}, {"small": 1.0, "large": 5.0})
    speech = P.Profile("speech", (), {"small": (((), 50.0),), "large": (((), 90.0),)}, {"small": 2.0, "large": 3.0})
    vqa = P.Profile("vqa", ("image", "speech"), {"only": (((55.0, 45.0), 40.0), ((55.0, 85.0), 56.0), ((75.0, 45.0), 58.0), ((75.0, 85.0), 70.0))}, {"only": 1.0}, weight=2.0)
    got = P.beam_search([image, speech, vqa], "vqa", 56.0)
    assert got[0] == ({"vqa": "only", "image": "small", "speech": "large"}, 6.0)
    assert [c for _, c in got] == sorted(c for _, c in got)
    assert P.beam_search([image, speech, vqa], "vqa", 99.0) == []
    assert P.sample_profile(vqa, "only", 56.0, 2) == [((55.0, 85.0), 56.0), ((75.0, 45.0), 58.0)]
    assert len(P.interpolated(vqa, 3).samples["only"]) == 4 + 9


def test_best_plan_prefers_accuracy_at_equal_cost():
    p = problem(random.Random(4))
    plan = P.best_plan([({"m": "a"}, 50.0, p), ({"m": "b"}, 60.0, p)], strategy="all-tiers", allocation="greedy")
    assert plan["model_assignment"] == {"m": "b"} and set(plan["worker_assignment"]) == {"n0", "n1", "n2"}


def test_bad_graphs():
    with pytest.raises(ValueError):
        P.Problem({}, [], [("a", "b"), ("b", "a")], {}, {"a": 1.0}, {})
    with pytest.raises(ValueError):
        P.assign(problem(random.Random(1)), "nowhere")


def test_tiers_from_free_links(spark):
    workers = spark.createDataFrame([("a",), ("b",), ("c",)], "worker string")
    links = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 1.0)], "a string, b string, cost double")
    assert sorted(map(tuple, P.tiers_by_links(workers, links).collect())) == [("a", 0), ("b", 0), ("c", 1)]


def test_placement_files(spark, tmp_path):
    (tmp_path / "execution_profile.csv").write_text("n,w,m,1.5\nn,w2,m,2.5,\n")
    assert sorted(r.latency for r in files.placement_table(spark, str(tmp_path), "execution_profile").collect()) == [1.5, 2.5]
    (tmp_path / "throughput_normalization_ratios.csv").write_text("u,v,a,b,0.5\n")
    assert files.placement_table(spark, str(tmp_path), "throughput_normalization_ratios").columns == ["u", "v", "u_model", "v_model", "ratio"]
    (tmp_path / "need.json").write_text(json.dumps({"sink": "VQA", "threshold": 56.0}))
    assert files.accuracy_requirement(str(tmp_path / "need.json")) == ("VQA", 56.0)
    types = spark.createDataFrame([("gpu", 2), ("cpu", 0)], "worker_type string, number int")
    assert sorted(r.worker for r in files.numbered_workers(types).collect()) == ["gpu_0", "gpu_1"]
    plan = {"b": {"x": [1, 2]}, "a": 1.5}
    files.write_plan(plan, str(tmp_path / "plan.json"))
    assert json.loads((tmp_path / "plan.json").read_text()) == plan
    files.write_plan(plan, str(tmp_path / "plan.yaml"))
    assert (tmp_path / "plan.yaml").read_text() == "a: 1.5\nb:\n  x:\n    - 1\n    - 2\n"


def folder(path):
    tables = {
        "workers_specs": "small,1.0\nlarge,3.0\n",
        "logical_graph": "cam,image\nmic,speech\nimage,vqa\nspeech,vqa\n",
        "execution_profile": "image,small,r18,50\nimage,large,r18,10\nimage,large,r152,30\nspeech,small,base,100\nspeech,large,base,20\nvqa,large,default,5\nvqa,small,default,20\n",
        "message_sizes": "cam,image,default,default,800\nmic,speech,default,default,100\nimage,vqa,r18,default,2\nimage,vqa,default,default,8\nspeech,vqa,default,default,0.1\n",
        "input_injection_rates": "cam,20\nmic,10\n",
    }
    for name, text in tables.items():
        (path / f"{name}.csv").write_text(text)
    return str(path)


def test_from_folder_to_plan(spark, tmp_path):
    from millrace.plans import inputs as I

    at = folder(tmp_path)
    (tmp_path / "workers_numbers.csv").write_text("small,3\nlarge,2\n")
    (tmp_path / "workers_partition.json").write_text(json.dumps([["small_0", "small_1", "small_2"], ["large_0", "large_1"]]))
    given = I.read_folder(spark, at)
    image = P.Profile("image", (), {"r18": (((), 60.0),), "r152": (((), 80.0),)}, {"r18": 1.0, "r152": 2.0})
    speech = P.Profile("speech", (), {"base": (((), 50.0),)}, {"base": 1.0})
    vqa = P.Profile("vqa", ("image", "speech"), {"default": (((60.0, 50.0), 50.0), ((80.0, 50.0), 60.0))}, {"default": 1.0})
    settings = I.Settings(strategy="multiple-tiers", allocation="greedy", best_k=20, link_scale=0.1)
    measured = {(("image", "r18"), ("speech", "base"), ("vqa", "default")): 51.0}
    plan = I.optimize(spark, given, [image, speech, vqa], "vqa", 45.0, settings, measured)
    best = I.exhaustive(spark, given, [({"image": "r18", "speech": "base", "vqa": "default"}, 51.0), ({"image": "r152", "speech": "base", "vqa": "default"}, 61.0)], 45.0, settings)
    assert plan["end_to_end_accuracy"] == 51.0 and plan["model_assignment"]["image"] == "r18"
    assert plan["compute_cost"] + plan["communication_cost"] >= best["cost"] - 1e-9
    problem = I.with_variants(spark, given, {"image": "r18", "speech": "base", "vqa": "default"}, I.Settings(latency_ratio=2.0))
    assert problem.sizes[("image", "vqa")] == 2.0 and problem.ratios[("cam", "image")] == 1.0 and problem.latency[("image", "small_1")] == 100.0
    assert problem.expected == {"cam": 20.0, "mic": 10.0, "image": 20.0, "speech": 10.0, "vqa": 10.0}
    assert I.with_variants(spark, given, {"image": "r152", "speech": "base", "vqa": "default"}, settings).sizes[("image", "vqa")] == 8.0


def test_concrete_workers_without_partition(spark, tmp_path):
    from millrace.plans import inputs as I

    at = folder(tmp_path)
    (tmp_path / "workers_workers_link.csv").write_text("small,large,1.0\n")
    assert I.read_folder(spark, at).tiers == [["large"], ["small"]]
