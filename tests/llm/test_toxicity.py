import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from millrace.llm import toxicity as X


def rows(n, seed):
    rng = random.Random(seed)
    parts = ["an", "er", "th", "ing", "on", "re", "st", "ou"]
    common = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(2000)]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 150))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit", "dunce", "Numskull!"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_catches_held_out_toxic_texts(spark):
    data = rows(700, 1)
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in data] + [(9000, None, 0.0), (9001, "", 0.0), (9002, "x" * 3000, 0.0), (9002, "x" * 3000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(9000, 1), (9001, None)], "doc_id long, toxic int")
    model = X.fit(docs, labels, F.col("doc_id") % 3 != 1)
    got = X.predict(spark, docs, model).collect()
    assert len(got) == len(data) + 4 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    held = [(score[k] >= 0.7, y) for k, _, y in data if k % 3 == 1]
    assert sum(p for p, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.01 * len(held)
    assert max(score[9000], score[9001], score[9002]) < 0.7


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.fit(docs, none, F.lit(True))
    assert model is None and [r.score for r in X.predict(spark, docs, model).collect()] == [0.0, 0.0]
    assert X.predict(spark, docs.limit(0), model).collect() == []


def test_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(X, "CACHE_WORDS", 2)
    ordinary, toxic = X.train([(t.encode(), y == 1) for _, t, y in rows(200, 2)])
    found = X.Gains(ordinary, toxic)
    assert len(ordinary) and b"blockhead" in toxic
    text = b"blockhead other words and a nitwit"
    assert X.reached(text, found) == X.reached(text, found) and len(found) == 2
    assert X.reached(text, found)[2] >= 2 and X.reached(None, found) == [0] * (1 + len(X.GAINS))


def test_scores_equal_a_plain_computation(spark):
    data = rows(300, 3)
    random.Random(1).shuffle(data)
    model = X.learn([(t.encode(), y == 1) for _, t, y in data])
    odd = [None, "", " \n ", "NITWIT nitwit Dunce", "y" * 400, "über Numskull! " * 4000, "a" * 47 + " " + "b" * 46 + " nitwit"]
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate([t for _, t, _ in data[:60]] + odd)], "doc_id long, text string, score string, n_hits int")

    def length(content, window):
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=18, hash_log=17, chain_log=17, search_log=6, target_length=16, write_content_size=False, write_dict_id=False, write_checksum=False
        )
        return len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(content + X.AFTER + X.BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(X.BEFORE + window + X.AFTER))

    seen = {}

    def gain(word):
        if word not in seen:
            whole, best, at = b" " + word + b" ", 0, 0
            while True:
                best = max(best, length(model.ordinary, whole[at : at + 48]) - length(model.toxic, whole[at : at + 48]))
                at += 24
                if len(whole) <= 48 or at >= len(whole) - 24:
                    break
            seen[word] = best
        return seen[word]

    for r, text in zip(sorted(X.predict(spark, docs, model).collect(), key=lambda r: r.doc_id), [t for _, t, _ in data[:60]] + odd, strict=True):
        words = [bytes(w) for w in (text or "").encode().lower().split()]
        hits = [sum(gain(w) >= t for w in words) for t in (2, 3, 4, 5, 6, 7, 8)]
        x = [math.log(1 + h) for h in hits] + [100 * h / (len(words) + 50) for h in hits[:4]] + [math.log(1 + len(words)), 1]
        assert r.score == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True)))), abs=1e-9)
        assert r.n_hits == hits[3]


def test_each_dictionary_is_of_its_class_alone():
    # What is only in the other class is in neither dictionary of one's own.
    ordinary, toxic = X.train([(t.encode(), y == 1) for _, t, y in rows(400, 4)])
    assert b"blockhead" in toxic and b"nitwit" in toxic
    assert not any(w in ordinary for w in (b"blockhead", b"nitwit", b"dunce", b"numskull"))


def test_cut_is_the_best_by_f1():
    rng = random.Random(6)
    for _ in range(200):
        z, y = [rng.randrange(8) for _ in range(12)], [rng.random() < 0.4 for _ in range(11)] + [True]

        def f1(cut):
            hit = sum(t for v, t in zip(z, y) if v >= cut)
            return 2 * hit / (sum(v >= cut for v in z) + sum(y))

        assert f1(X.best_cut(np.array(z, float), np.array(y, float))) == max(f1(c) for c in z)


def test_fit_in_tasks_learns_from_bounded_distinct_rows(spark):
    data = rows(500, 5)
    same = [(0, data[0][1])] * 500  # one id with as many rows as all others
    docs = spark.createDataFrame([(k, t) for k, t, _ in data] + same, "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(0, data[0][2]), (None, 1), (3, None)], "doc_id long, toxic int")
    assert X.fit(docs, labels, F.lit(True), rows=0) is None
    one, two = (X.fit(d, labels, F.lit(True)) for d in (docs, docs.repartition(7)))
    assert one == two and len(one.toxic) > 1000
    assert X.fit(docs.limit(0), labels, F.lit(True)) is None
