import random

import corpus_pipeline as P
from millrace.llm import decontaminate as D
from millrace.llm.common import Scratch


def plain(docs, items):
    out = []
    for d in docs:
        words = D.words_of(d)
        own, held = D.shingles(words), []
        for k, raw in items:
            w = D.words_of(raw)
            s, a = D.shingles(w), set(w[-5:])
            if len(w) < 5:
                if any(words[i : i + len(w)] == w for i in range(len(words) - len(w) + 1)) and w:
                    held.append(k)
            elif sum(x in own for x in s) >= 0.8 * len(s) and sum(x in words for x in a) >= 0.5 * len(a):
                held.append(k)
        out.append(sorted(held))
    return out


def corpus(seed, n_items=60, n_docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.expovariate(0.01))}" for _ in range(3000)] + ["the", "of"] * 300
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 20, 40, 59]))).encode()) for k in range(n_items)]
    docs = []
    for _ in range(n_docs):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 400]))]
        for _ in range(rng.randrange(3)):
            other = rng.choice(items)[1].decode().split()
            if rng.random() < 0.5:
                other[rng.randrange(len(other))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in other]
        docs.append(" ".join(w).encode())
    return docs, items


def test_finds_what_all_pairs_find():
    for seed in range(4):
        docs, items = corpus(seed)
        got = [sorted(k for k, _ in f) for f in D.Index(items).search(docs)]
        want = plain(docs, items)
        assert got == want and sum(map(len, want)) > 50


def test_bounds_prune_without_loss(monkeypatch):
    docs, items = corpus(7)
    whole = D.Index(items).retrieve([D.words_of(d) for d in docs])
    monkeypatch.setattr(D, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(D, "CELLS", 500)
    cut = D.Index(items).retrieve([D.words_of(d) for d in docs])
    assert [(d, i) for d, i, _ in whole] == [(d, i) for d, i, _ in cut] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(whole, cut))


def test_tables(spark):
    docs, items = corpus(9)
    rows = list(enumerate(d.decode() for d in docs)) + [(500, None), (501, ""), (None, items[5][1].decode()), (7, docs[7].decode())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(k, t.decode()) for k, t in items] + [(99, None), (None, "a b c d e f"), (98, "")], "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r["items"]) for r in D.leaks(spark, df, bench).collect())
    want = sorted((-1 if k is None else k, h) for (k, _), h in zip(rows, plain([(t or "").encode() for _, t in rows], items)))
    assert got == want
    clean = D.remove_leaks(spark, df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == sorted(k for k, h in want if not h)
    none = bench.limit(0)
    assert all(r["items"] == [] for r in D.leaks(spark, df, none).collect()) and D.remove_leaks(spark, df, none).count() == len(rows)
    assert D.leaks(spark, df.limit(0), bench).collect() == []


def test_index_in_parts(spark):
    _, items = corpus(3)
    bench = spark.createDataFrame([(k, t.decode()) for k, t in items], "item_id long, text string")
    parts = [x for x, _ in D.indexes(bench, part_bytes=500)]
    assert len(parts) > 3 and sorted(k for p in parts for k in p.ids.tolist()) == [k for k, t in items if D.words_of(t)]


def test_several_passes_give_the_same(spark):
    docs, items = corpus(5)
    df = spark.createDataFrame([(k, d.decode(), "x") for k, d in enumerate(docs)], "doc_id long, text string, part string")
    bench = spark.createDataFrame([(k, t.decode()) for k, t in items], "item_id long, text string")
    want = [tuple(r) for r in D.leaks(spark, df, bench).sort("doc_id").collect()]
    got = [tuple(r) for r in D.leaks(spark, df, bench, part_bytes=2000).sort("doc_id").collect()]
    assert [r[:2] for r in got] == [r[:2] for r in want] and sum(bool(r[1]) for r in want) > 30
    kept = D.remove_leaks(spark, df, bench, part_bytes=2000)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k, h, _ in want if not h]


def test_memory_of_an_index_is_in_proportion_to_its_items():
    rng = random.Random(8)
    items = [(k, " ".join(f"{rng.randrange(10**9)}" for _ in range(10)).encode()) for k in range(8000)]
    index = D.Index(items)
    assert max(index.block_max.size, index.block.size, index.item.size) <= 80_000 and index.blocks == 500
    assert [[k for k, _ in f] for f in index.search([items[77][1], b"x " * 1000 + items[4000][1] + b" y" * 1000])] == [[77], [4000]]


def test_short_and_nameless_items_remove_documents(spark):
    filler = " ".join(f"f{i}" for i in range(40))
    docs = [(1, f"{filler} Red, green blue! {filler}"), (2, f"{filler} green red blue {filler}"), (3, "red green blue"), (4, "so red green blue"), (5, f"{filler} one two three four five six {filler}"), (6, filler), (7, f"{filler} redgreen blue")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "red green blue"), (None, "one two three four five six"), (None, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.remove_leaks(spark, df, bench).collect()) == [2, 6, 7]
    assert [r["items"] for r in D.leaks(spark, df, bench).sort("doc_id").collect()] == [[1], [], [1], [1], [], [], []]
    assert sorted(r.doc_id for r in P.drop_leaks(spark, df, saved(spark, bench)).collect()) == [2, 6, 7]


def saved(spark, bench):
    folder = Scratch(spark, "bench").root
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return folder
