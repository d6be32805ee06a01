import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id as L

SOUNDS = {"aa": ["ka", "to", "mi", "na"], "bb": ["sch", "ung", "ein", "er"], "cc": ["δα", "κο", "μι", "ρα"]}


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        out.append((i, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 40))).capitalize() + ".", lang))
    return out


def plain_grams(text):
    """N-grams of lower-case letters, other characters as single spaces; none spans two spaces."""
    s = "\n\n" + "".join(c.lower()[0] if c.isalpha() else " " for c in text or "") + "\n\n"
    s = s.replace("\n", " ")
    out = Counter()
    for n in L.ORDERS:
        for i in range(1, len(s) - n):
            g = s[i : i + n]
            if "  " not in g and i + n <= len(s) - 1:
                out[g] += 1
    return out


def bucket(gram):
    value = len(gram)
    for c in gram:
        value = (value * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
    return (value * 2654435761 & 0xFFFFFFFF) >> 16


def test_scores_match_plain_form():
    rng = random.Random(2)
    weights = np.random.default_rng(1).normal(size=(L.BUCKETS, 3)).astype(np.float32)
    texts = ["first one", None, "", "a", "!!", "Ab c", "x  y", "\n", "İstanbul", "12 ab 3", *("".join(rng.choice("ab cÉ\n.") for _ in range(rng.randrange(40))) for _ in range(100))]
    got, has = L.score(texts, weights)
    for k, t in enumerate(texts):
        want = sum((weights[bucket(g)].astype(float) * n for g, n in plain_grams(t).items()), np.zeros(3))
        assert np.allclose(got[k], want, atol=1e-3), repr(t)
        assert has[k] == any(c.isalpha() for c in t or "")


def test_blocks_do_not_change_scores(monkeypatch):
    weights = np.random.default_rng(1).normal(size=(L.BUCKETS, 3)).astype(np.float32)
    texts = [t for _, t, _ in rows(50, 3)]
    whole = L.score(texts, weights)[0]
    for block in (7, 1, 50):
        monkeypatch.setattr(L, "BLOCK", block)
        got, has = L.score([*texts, None, "1 2 3 4 5 6 7 8 9"], weights)
        assert np.allclose(whole, got[:-2], atol=1e-2) and has.tolist() == [True] * len(texts) + [False, False]


def test_held_out_accuracy_and_odd_texts(spark):
    data = rows(400, 4)
    docs = spark.createDataFrame([(k, t, s, 1.0) for k, t, s in data] + [(9000, None, "aa", 0.0), (9001, " 12 ", None, 0.0), (None, "ka to", None, 0.0)], "doc_id long, text string, lang string, score double")
    languages, weights = L.fit(docs, F.col("doc_id") % 5 != 0)
    assert languages == sorted(SOUNDS) and math.isclose(float(np.exp(weights).sum(axis=0)[0]), 1, rel_tol=1e-3)
    got = {r.doc_id: r for r in L.predict(spark, docs, languages, weights).collect()}
    assert len(got) == 403 and sum(got[k].lang_pred == s for k, _, s in data if k % 5 == 0) >= 78
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (9000, 9001)) and got[None].lang_pred == "aa"
    kept = L.keep_known(spark, docs, languages, weights, 0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {9000, 9001}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    languages, weights = L.fit(docs, F.lit(True))
    assert [r.lang_pred for r in L.predict(spark, docs, languages, weights).collect()] == ["und"]
    assert L.predict(spark, docs.limit(0), languages, weights).collect() == []


def test_letters_of_every_plane():
    weights = np.zeros((L.BUCKETS, 2), np.float32)
    assert L.score([chr(0x30000), chr(0x1F600), "\U0002A6D7 1", "１２"], weights)[1].tolist() == [True, False, True, False]


def test_fit_counts_every_gram_of_a_language(spark, monkeypatch):
    data = [(k, t, s) for k, t, s in rows(60, 5)] + [(100, None, "aa"), (101, "ka to\n" * 50, "bb"), (102, "x", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(5)
    for block in (L.BLOCK, 11):
        monkeypatch.setattr(L, "BLOCK", block)
        languages, weights = L.fit(docs, F.lit(True))
        for k, s in enumerate(languages):
            want = np.full(L.BUCKETS, L.SMOOTH)
            for _, t, lang in data:
                if lang == s:
                    for g, n in plain_grams(t).items():
                        want[bucket(g)] += n
            assert np.allclose(weights[:, k], np.log(want / want.sum()), atol=1e-4)


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "ka to mi " * 60_000, "aa"), (2, "schung ein " * 40, "bb")], "doc_id long, text string, lang string")
    languages, weights = L.fit(docs, F.lit(True))
    assert [r.lang_pred for r in L.predict(spark, docs, languages, weights).sort("doc_id").collect()] == ["aa", "bb"]
