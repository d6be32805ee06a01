"""Ordered computations on order columns of every kind, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import ordered as O
from millrace.operators import aggregates as A
from millrace.operators import timeops as T
from millrace.plans import placement as P

RNG = random.Random(3)
N = 3000
COLUMNS = {
    "nanoseconds": [1_700_000_000_000_000_000 + RNG.randrange(10**15) for _ in range(N)],
    "dense": list(range(N)),
    "outliers": [RNG.randrange(100) for _ in range(N - 2)] + [-(1 << 62), (1 << 62)],
    "one value": [7] * N,
    "a third null": [None if k % 3 == 0 else RNG.randrange(50) for k in range(N)],
    "all null": [None] * N,
    "a third equal": [5 if k % 3 == 0 else RNG.randrange(1000) for k in range(N)],
    "skewed": [int(RNG.paretovariate(0.5)) % (1 << 60) for _ in range(N)],
}


def key(value):
    return (value is not None, value or 0)


@pytest.fixture(params=COLUMNS)
def column(request, spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 100)
    values = COLUMNS[request.param]
    df = spark.createDataFrame([(x, k, k % 5, "a" if k % 2 else "b") for k, x in enumerate(values)], "o long, t long, v long, g string")
    return values, df


@pytest.mark.parametrize("by", [[], ["g"]])
def test_with_ties_ordered(column, by):
    values, df = column
    rows = sorted(((x, k, k % 5, "a" if k % 2 else "b") for k, x in enumerate(values)), key=lambda r: (key(r[0]), r[1]))
    want, seen = {}, {}
    for x, k, v, g in rows:
        n, total, last = seen.get(g if by else "", (0, 0, None))
        want[k] = (n + 1, total + v, last)
        seen[g if by else ""] = (n + 1, total + v, v)
    num = {r.t: r["row_number"] for r in O.number_rows(df, "o", by, ["t"]).collect()}
    run = {r.t: r.running for r in O.running_sum(df, "v", "o", by, ["t"]).collect()}
    lag = {r.t: r.lagged for r in O.lag_rows(df, "v", "o", by, ["t"]).collect()}
    assert {k: (num[k], run[k], lag[k]) for k in num} == want


def test_without_ties(column):
    values, df = column
    got = sorted(((r["row_number"], r.o) for r in O.number_rows(df, "o").collect()))
    assert [n for n, _ in got] == list(range(1, N + 1)) and [x for _, x in got] == sorted(values, key=key)


def test_buckets_are_small(column):
    values, df = column
    sizes = [r["count"] for r in O.bucketed(df, "o", []).groupBy("__bucket").count().collect()]
    assert sum(sizes) == N and max(sizes) <= 400


@pytest.mark.parametrize("name", ["nanoseconds", "dense", "outliers", "a third null", "a third equal", "skewed"])
def test_percentiles_are_exact(spark, monkeypatch, name):
    monkeypatch.setattr(O, "ROWS", 100)
    values = sorted(float(x) for x in COLUMNS[name] if x is not None)
    df = spark.createDataFrame([(x,) for x in COLUMNS[name]], "x long")
    got = A.percentiles(df, "x", (0.0, 0.1, 0.5, 0.999, 1.0)).first()
    for p, found in zip((0.0, 0.1, 0.5, 0.999, 1.0), got):
        place = p * (len(values) - 1)
        low, high = values[int(place)], values[min(int(place) + (place > int(place)), len(values) - 1)]
        assert found == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-12, abs=1e-6)


def test_percentiles_of_nothing(spark):
    assert list(A.percentiles(spark.createDataFrame([(None,)], "x long"), "x", (0.5,)).first()) == [None]
    assert A.percentiles(spark.createDataFrame([], "g long, x long"), "x", (0.5,), ["g"]).collect() == []
    assert A.profile(spark.createDataFrame([(1, None), (1, 3.0), (None, 4.0), (2, None)], "g long, x double"), "x", ["g"]).orderBy("g").select("g", "p50").collect() == [(None, 4.0), (1, 3.0), (2, None)]


def windows(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin")


def test_reclock_meets_ticks_by_equality(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 100)
    times = [RNG.randrange(10**18) if k % 7 else None for k in range(N)]
    ticks = sorted(RNG.randrange(10**18) for _ in range(40))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k long, epoch long")
    got = T.reclock(rows, spark.createDataFrame([(t,) for t in ticks], "tick long"))
    assert windows(got) == 0
    want = {k: min((x for x in ticks if x >= t), default=None) for k, t in enumerate(times) if t is not None}
    assert {r.k: r.tick for r in got.collect()} == {k: x for k, x in want.items() if x is not None}


def test_word_edits_equal_the_plain_table():
    def plain(a, b):
        table = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return table[-1][-1]

    for _ in range(300):
        a, b = ([RNG.choice("abcd") for _ in range(RNG.randrange(9))] for _ in range(2))
        assert A._edits(a, b) == plain(a, b)


def test_interpolation_on_faces_and_by_spline():
    import numpy as np

    x = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [10.0, 10.0], [4.0, 5.0]])
    y = np.array([0.0, 1.0, 2.0, 3.0, 9.0])
    assert np.allclose(P.on_faces(x, y, x), y) and np.allclose(P.on_spline(x, y, x), y)
    assert np.isnan(P.on_faces(x, y, np.array([[11.0, 5.0], [-1.0, 0.0]]))).all()
    # The middle of an edge of the triangulation lies halfway.
    assert np.allclose(P.on_faces(x, y, np.array([[2.0, 2.5], [7.0, 7.5], [5.0, 0.0]])), [4.5, 6.0, 0.5])
    flat = np.random.default_rng(1).random((30, 3))
    assert np.allclose(P.on_faces(flat, flat @ [1, 2, 3], np.array([[0.5, 0.5, 0.5]])), [3.0])
    with pytest.raises(ValueError):
        P.interpolated(P.Profile("op", (), {}, {}), method="other")


def test_buffered_rows_go_to_their_worker(spark):
    from millrace.sources import inputs

    rows = spark.range(20).select(F.col("id").alias("k"))

    def load(frame):
        from pyspark import TaskContext

        return frame.assign(worker=TaskContext.get().partitionId())

    got = inputs.input_buffered(rows, load, "k long, worker int", peers=3, order="k").collect()
    assert all(r.worker == r.k % 3 for r in got) and len(got) == 20
