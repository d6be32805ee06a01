import hashlib
from collections import defaultdict

from millrace.llm import mixing as M


def plain_targets(size):
    """Capped shares, reshared again and again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * size[s] for s in over}


def run(spark, rows, near=3):
    got = M.mix(spark, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int")).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    want = plain_targets(size)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        most[r.source] += 1
    for s in size:
        assert abs(taken[s] - want[s]) <= near, (s, taken[s], want[s])
    return got


def test_meets_targets(spark):
    rows = [(i, " ".join("w" * (i * 7 % 90)), f"s{i % 11}" if i % 3 else "hot") for i in range(700)] + [(900, None, "s1"), (901, "x y", None), (902, "", "empty"), (None, "a b c", "s2")]
    got = run(spark, rows)
    passes = {r.doc_id: r.taken / r.size for r in got if r.size and r.source == "hot"}
    text = {k: t for k, t, _ in rows}
    place = lambda k: hashlib.md5(f"{k}:{hashlib.md5(text[k].encode()).hexdigest()}".encode()).hexdigest()[:12]
    cut = [place(k) for k, p in passes.items() if p > min(passes.values())]
    rest = [place(k) for k, p in passes.items() if p == min(passes.values())]
    assert not cut or max(cut) < min(rest)


def test_repeated_ids_share(spark):
    """Copies of one id share the rest in whole words: less than a word each is left."""
    run(spark, [(1, "a b c", "x")] * 50 + [(2, "a", "y"), (3, "b c", "z")], near=50)


def test_one_id_with_many_texts(spark):
    """Rows of one id, or of none, are taken by their texts, not all at once."""
    rows = [(None, f"w{i} b c", "x") for i in range(300)] + [(7, f"w{i} d", "x") for i in range(300)] + [(i, "a " * 9, f"y{i % 4}") for i in range(80)]
    got = run(spark, rows)
    kept = [r.taken for r in got if r.source == "x" and r.doc_id is None]
    assert len(set(kept)) > 1 or set(kept) == {9}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = sum(len(r.text.split()) for r in M.mixed_rows(spark, docs).where("source = 'x'").collect())
    target = next(r.target for r in got if r.source == "x")
    assert abs(words - target) <= 3


def test_one_source_and_empty(spark):
    run(spark, [(1, "a b", None), (2, "c", None)])
    assert M.mix(spark, spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert [r.taken for r in M.mix(spark, spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string")).collect()] == [0]


def test_reruns_agree(spark):
    rows = [(i, "w " * (i % 40), f"s{i % 7}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(M.mix(spark, df).collect()) == sorted(M.mix(spark, df.repartition(7)).collect())
