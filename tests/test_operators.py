"""Golden vectors and plain-Python models of the operators."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import model
from millrace.functions import numeric as N
from millrace.functions import ordered as O
from millrace.functions import text as X
from millrace.operators import aggregates as A
from millrace.operators import folds, generic
from millrace.operators import graph as G
from millrace.operators import joins as J
from millrace.operators import routing as R
from millrace.operators import sets as S
from millrace.operators import timeops as T


def numbers(spark, n=10):
    return spark.range(n).select(F.col("id").alias("x"), F.lit(0).cast("long").alias("epoch"))


# Golden vectors.


def test_sum_and_count_by_parity(spark):
    by = A.timestamp_aggregate(numbers(spark).withColumn("k", F.col("x") % 2), ["k"], total=F.sum("x"), n=F.count(F.lit(1)))
    assert sorted((r.k, r.total, r.n) for r in by.collect()) == [(0, 20, 5), (1, 25, 5)]


def test_running_sums(spark):
    got = defaultdict(set)
    for r in A.running_totals(numbers(spark).withColumn("k", F.col("x") % 2), "x", "x", ["k"]).collect():
        got[r.k].add(r.total)
    assert got == {0: {0, 2, 6, 12, 20}, 1: {1, 4, 9, 16, 25}}


def test_count_and_accumulate(spark):
    assert [(r.epoch, r.n) for r in A.count(numbers(spark)).collect()] == [(0, 10)]
    assert [(r.epoch, r.value) for r in A.accumulate(numbers(spark), F.lit(0).cast("long"), lambda a, x: a + x, F.col("x")).collect()] == [(0, 45)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 100])
def test_reclock(spark, width):
    ticks = spark.createDataFrame([(3,), (5,), (8,), (5,), (None,)], "tick long")
    got = defaultdict(list)
    for r in T.reclock(spark.range(10).select(F.col("id").alias("epoch")), ticks, width=width).collect():
        got[r.tick].append(r.epoch)
    assert {t: sorted(v) for t, v in got.items()} == {3: [0, 1, 2, 3], 5: [4, 5], 8: [6, 7, 8]}


def test_distinct_and_word_totals(spark):
    values = [0, 1, 2, 2, 2, 3, 3, 4, 0, 0, 3, 4, 4, 5, 7, 7]
    df = spark.createDataFrame([(v, 0) for v in values], "v int, epoch long")
    assert sorted(r.v for r in A.distinct(df, "v").collect()) == [0, 1, 2, 3, 4, 5, 7]
    rounds = spark.createDataFrame([("round", 1, e) for e in range(10)], "word string, diff int, epoch long")
    assert sorted(r.total for r in A.word_totals(rounds, "word", "diff").collect()) == list(range(1, 11))


def test_partition_and_branch(spark):
    parts = R.partition(numbers(spark), 3, R.route(F.col("x"), 3))
    assert [sorted(r.x for r in p.collect()) for p in parts] == [[0, 3, 6, 9], [1, 4, 7], [2, 5, 8]]
    no, yes = R.branch(numbers(spark).withColumn("p", F.when(F.col("x") > 2, F.col("x") > 5)), F.col("p"))
    assert (no.count(), yes.count()) == (6, 4)


def test_map_chain_and_epochs(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 6)], "x int")
    assert sorted(r.y for r in R.map_rows(R.map_rows(df, y=F.col("x") * 2), y=F.col("y") * 2).collect()) == [4, 8, 12, 16, 20]
    assert [(r.x, r.epoch) for r in T.stamp_epochs(df, F.col("x") + 1, "x").orderBy("x").collect()] == [(1, 0), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_results(spark):
    df = spark.createDataFrame([(0, None), (None, "e")], "v int, m string").select(R.as_result(F.col("v"), F.col("m")).alias("r"))
    values = lambda c: [tuple(x[0]) if isinstance(x[0], tuple) else x[0] for x in df.select(c.alias("r")).collect()]
    r = F.col("r")
    assert values(R.map_ok(r, lambda v: v + 1)) == [(1, None), (None, "e")]
    assert values(R.map_err(r, lambda e: F.concat(e, e))) == [(0, None), (None, "ee")]
    assert values(R.and_then(r, lambda v: R.as_result(F.when(v > 0, v), F.lit("low")))) == [(None, "low"), (None, "e")]
    assert values(R.unwrap_or_else(r, lambda e: F.lit(7))) == [0, 7]
    assert [[x.r for x in side.collect()] for side in R.ok_err(df, "r")] == [[0], ["e"]]


def test_word_tokenizer(spark):
    df = spark.createDataFrame([("What's the man-made / thing? (red, blue)",)], "t string")
    assert df.select(X.tokenize_words(F.col("t"))).first()[0] == ["whats", "the", "man", "made", "thing", "red", "blue"]
    assert df.select(X.tokenize_keeping(F.lit("a, b-c\n(d)"))).first()[0] == ["a", ",", "b", "-", "c", "(", "d", ")"]


# Ordered computations against plain models.


def random_rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(-500, 500), i, rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("width", [7, 100, 10_000])
def test_ordered(spark, width):
    rows = random_rows(width)
    df = spark.createDataFrame(rows, "k string, o long, t int, v long")
    num = {r.t: r for r in O.number_rows(df, "o", ["k"], ["t"], width=width).collect()}
    run = {r.t: r for r in O.running_sum(df, "v", "o", ["k"], ["t"], width=width).collect()}
    lag = {r.t: r for r in O.lag_rows(df, "v", "o", ["k"], ["t"], width=width).collect()}
    assert len(num) == len(run) == len(lag) == len(rows)
    for k in ("a", "b", None):
        total, before = 0, None
        for n, (_, o, t, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]), 1):
            total += v
            assert num[t].row_number == n and run[t].running == total and lag[t].lagged == before
            before = v


def test_ordered_by_time_and_empty(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id * 7) AS ts, id AS v FROM range(50)")
    got = O.number_rows(df, "ts").collect()
    assert sorted((r.v, r.row_number) for r in got) == [(i, i + 1) for i in range(50)]
    assert O.lag_rows(df.limit(0), "v", "ts").collect() == []


def test_lag_of_null_values(spark):
    df = spark.createDataFrame([(0, None), (1, 5), (2, None), (3, 7)], "o long, v int")
    assert [r.lagged for r in O.lag_rows(df, "v", "o", width=1).orderBy("o").collect()] == [None, None, 5, None]


def test_time_never_goes_back(spark):
    good = spark.createDataFrame([(0, 0), (1, 0), (2, 5)], "o long, epoch long")
    assert T.forward_only(good, "o").count() == 3
    with pytest.raises(Exception, match="time went back"):
        T.forward_only(spark.createDataFrame([(0, 3), (1, 2)], "o long, epoch long"), "o").collect()
    with pytest.raises(Exception, match="past"):
        T.delay(good, F.col("epoch") - 1).collect()


# Joins.


def test_single_item_join(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.randrange(2)) for i in range(200)]
    left, right = (spark.createDataFrame([(k, i) for i, k, s in rows if s == side], "k string, seq long") for side in (0, 1))
    waiting, want = {}, []
    for i, k, side in rows:
        if k in waiting and waiting[k][0] != side:
            other = waiting.pop(k)[1]
            want.append((other, i) if side else (i, other))
        else:
            waiting[k] = (side, i)
    assert sorted((r.l.seq, r.r.seq) for r in J.concat_join(left, right, ["k"], "seq").collect()) == sorted(want)


def test_counted_join_forgets(spark):
    left = spark.createDataFrame([("a", 1, 1), ("a", 3, 1)], "k string, seq long, n int")
    right = spark.createDataFrame([("a", 2, 1), ("a", 4, 1)], "k string, seq long, n int")
    assert sorted((r.l.seq, r.r.seq) for r in J.counted_join(left, right, ["k"], "seq", "n").collect()) == [(1, 2), (3, 4)]


def test_lookups(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q"), ("z", "p"), ("z", "q")], "u string, v string")
    t = spark.createDataFrame([("x", "p", 1.0), ("default", "p", 2.0), ("y", "default", 3.0)], "u string, v string, size double")
    got = {(r.u, r.v): r["size"] for r in J.fallback_lookup(df, t, "u", "v", "size", otherwise=F.lit(9.0)).collect()}
    assert got == {("x", "p"): 1.0, ("y", "q"): 3.0, ("z", "p"): 2.0, ("z", "q"): 9.0}


# Aggregates.


def test_count_bounded(spark):
    rows = [(i % 3, i) for i in range(20)]
    got = A.aggregate(spark.createDataFrame(rows, "k int, o long"), ["k"], 4, "o", total=F.sum("o")).collect()
    assert sorted((r.k, r.chunk, r.total) for r in got) == [(0, 0, 18), (1, 0, 22), (2, 0, 26)]


def test_counts_in_the_data(spark):
    rows = [("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("a", 4, 3), ("b", 1, 2)]
    got = A.counted_aggregate(spark.createDataFrame(rows, "k string, o int, n int"), ["k"], "n", ["o"], lambda rs: {"k": rs[0]["k"], "os": [r["o"] for r in rs]}, "k string, os array<int>")
    assert sorted((r.k, r.os) for r in got.collect()) == [("a", [1, 2]), ("a", [3])]


def test_most_common_keeps_first_of_ties(spark):
    rows = [(1, w, i) for i, w in enumerate("b a b c a d".split())]
    got = A.most_common(spark.createDataFrame(rows, "k int, w string, p int"), ["k"], "w", "p").first()["items"]
    assert [(x.item, x["count"]) for x in got] == [("b", 2), ("a", 2), ("c", 1), ("d", 1)]


def test_word_errors(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("a", "a b"), ("", None), (None, "z")], "r string, h string")
    assert tuple(A.word_error_rate(df, "r", "h").first()) == (3, 4, 0.75)


def test_histogram(spark):
    got = {(r.high, r.low): r.n for r in A.latency_histogram(spark.createDataFrame([(1,), (31,), (32,), (33,), (64,), (65,), (0,), (None,)], "x long"), "x").collect()}
    assert got == {(0, 1): 1, (4, 31): 1, (5, 0): 1, (5, 1): 1, (6, 0): 2}


def test_fold_streams_over_large_keys(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    got = folds.fold_ordered(df, ["k"], ["o"], lambda: 0, lambda s, r: (s + r["o"], []), "k long, s long", finish=lambda key, s: [{"k": key[0], "s": s}])
    assert sorted(map(tuple, got.collect())) == [(0, sum(range(0, 30_000, 2))), (1, sum(range(1, 30_000, 2)))]


# Sets, generic operators, graphs.


def test_union_counts_each_source_once(spark):
    a = numbers(spark, 2)
    assert S.union(a, a, a).count() == 6 and S.union_multi(a).count() == 2
    assert S.widened(a, spark.range(1)).columns == ["x", "epoch", "id"]


def test_batch_map_checks_rows(spark):
    with pytest.raises(Exception, match="became"):
        R.batch_map(spark.range(5), lambda f: f.iloc[:1], "id long").collect()
    assert R.batch_map(spark.range(7), lambda f: f, "id long", size=2).count() == 7


def test_inspect(spark):
    df, seen = R.inspect(numbers(spark), "seen", by="epoch", top=F.max("x"))
    df.collect()
    assert seen.get == {"rows": 10, "last": 0, "top": 9}
    assert R.inspect_batches(numbers(spark), lambda part, n: None).count() == 10


def test_generic(spark):
    outs = generic.tagged(spark.range(10), lambda f: [(0, f[f["id"] < 4]), (1, f[f["id"] >= 4])], "id long", 2)
    assert [o.count() for o in outs] == [4, 6]
    got = generic.unary_notify(numbers(spark), "epoch", lambda f: pd.DataFrame({"n": [len(f)]}), "n long").collect()
    assert [r.n for r in got] == [10]
    generic.sink(spark.range(3), lambda f: None)


def test_sink_gets_batches(spark):
    """A partition comes in several frames, an empty one in none; nulls, structs and columns of one name or with a dot are kept."""
    calls, rows, total = (spark.sparkContext.accumulator(0) for _ in range(3))

    def fn(f):
        calls.add(1)
        rows.add(len(f))
        total.add(int(f["id"].to_numpy().sum()) + int(f["a.even"].dropna().sum()) + sum(r["x"] for r in f["s"]))

    def given(n, parts):
        i = F.col("id")
        return spark.range(0, n, 1, parts).select(i, F.when(i % 2 == 0, i).alias("a.even"), F.struct(i.alias("x")).alias("s"), (-i).alias("id"))

    generic.sink(given(25_000, 1), fn)
    assert calls.value >= 3
    assert (rows.value, total.value) == (25_000, sum(range(0, 25_000, 2)) + sum(range(25_000)))
    before = calls.value
    generic.sink(given(2, 4), fn)
    assert (calls.value - before, rows.value) == (2, 25_002)
    generic.sink(spark.range(7).select(), lambda f: rows.add(len(f)))
    assert rows.value == 25_009


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_and_bfs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in G.connected_components(df).collect()} == plain_components(edges)
    levels = {r.node: (r.level, r.parent) for r in G.bfs(df, F.lit(100).cast("long")).collect()}
    assert levels == {100: (0, 100)} | {101 + i: (i + 1, 100 + i) for i in range(20)}
    assert G.connected_components(df.limit(0)).collect() == []


def test_collatz(spark):
    def steps(x):
        n = 0
        while x > 1:
            x, n = (x // 2 if x % 2 == 0 else 3 * x + 1), n + 1
        return n

    assert {r.value: r.steps for r in G.collatz(spark.range(0, 30).withColumnRenamed("id", "value")).collect()} == {x: steps(x) for x in range(30)}


def test_pagerank(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]
    rank = dict.fromkeys(range(4), 1000)
    for _ in range(4):
        after = dict.fromkeys(range(4), 1000)
        for s in rank:
            to = sorted(d for a, d in edges if a == s)
            for k, d in enumerate(to):
                spread = rank[s] * 5 // 6
                after[d] += spread // len(to) + (k < spread % len(to))
        rank = after
    assert {r.node: r["rank"] for r in G.pagerank(spark.createDataFrame(edges, "src long, dst long"), rounds=4).collect()} == rank


# Columns.


def test_scores_and_images(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0, 3.0],)], "s array<double>")
    r = df.select(N.argmax(F.col("s")).alias("a"), N.top_k(F.col("s"), 3).alias("t"), N.softmax(F.col("s")).alias("p")).first()
    assert (r.a, r.t) == (1, [1, 3, 2]) and abs(sum(r.p) - 1) < 1e-12
    pooled = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], [2, 2, 2])], "raw array<float>, shape array<long>").select(N.mean_pool("raw", "shape")).first()[0]
    assert pooled == [2.5, 6.5]
    swapped = spark.createDataFrame([(bytearray([1, 2, 3, 4, 5, 6]), [1, 2, 3])], "data binary, shape array<int>").select(N.swap_channels("data", "shape")).first()[0]
    assert bytes(swapped) == bytes([3, 2, 1, 6, 5, 4])


def test_encoding_helpers(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],), ([1],), ([],)], "ids array<long>")
    assert [r[0] for r in df.select(X.pad(F.col("ids"), 3)).collect()] == [[5, 6, 7], [1, 0, 0], [0, 0, 0]]
    assert [r[0] for r in df.select(X.pad(F.col("ids"), 3, left=True)).collect()] == [[5, 6, 7], [0, 0, 1], [0, 0, 0]]
    hot = spark.createDataFrame([([1, 3], [1, 3])], "i array<int>, c array<int>").select(X.n_hot(F.col("i"), F.col("c"), 5)).first()[0]
    assert hot == [0.0, 0.25, 0.0, 0.75, 0.0]
    pairs = spark.createDataFrame([([("yes", 2), ("zebra", 1), ("no", 4)],)], "a array<struct<answer:string,count:int>>")
    got = pairs.select(X.known_answers(F.col("a"), F.create_map(F.lit("yes"), F.lit(0), F.lit("no"), F.lit(1)))).first()[0]
    assert [tuple(x) for x in got] == [("yes", 0, 2), ("no", 1, 4)]
    drawn = spark.range(3000).select(X.sampled(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(3)), 1).alias("s")).groupBy("s").count().collect()
    assert 0.2 < next(r["count"] for r in drawn if r.s == "a") / 3000 < 0.3
    assert X.deep_update({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "e": 4}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 4}
    merged = spark.range(1).select(X.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2)))).first()[0]
    assert merged == {"a": 2, "b": 1}


def test_records(spark):
    df = spark.createDataFrame([(([2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]),)], "t struct<shape:array<bigint>,raw:array<float>>")
    assert df.select(model.at(F.col("t"), 1, 2)).first()[0] == 6.0
    timed = model.timed(model.envelope(spark.range(1), F.lit(100)), F.lit(7), network_ns=F.lit(3)).first()
    assert (timed.start_ns, timed.last_ns, timed.latency_ns) == (100, 110, 10)
    assert model.timed(model.timed(model.envelope(spark.range(1), F.lit(0)), F.lit(7)), F.lit(5), reset=True).first().latency_ns == 5


def test_in_step_and_sequenced(spark):
    got = generic.in_step(spark.range(6).repartition(2), [lambda f: f.assign(id=f["id"] + 1), lambda f: f.assign(id=f["id"] * 10)], "id long")
    assert sorted(r.id for r in got.collect()) == [10, 20, 30, 40, 50, 60]
    rows = [(5, 1, 0), (3, 0, 0), (5, 0, 1), (5, 0, 0)]
    got = generic.sequenced(spark.createDataFrame(rows, "t long, w int, p int"), "t", "w", "p").orderBy("sequence").collect()
    assert [(r.t, r.w, r.p, r.sequence) for r in got] == [(3, 0, 0, 0), (5, 0, 0, 1), (5, 0, 1, 2), (5, 1, 0, 3)]
