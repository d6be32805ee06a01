import random
import re
from collections import Counter

import numpy as np

from millrace.llm import quality_rules as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_counts_match_plain_form():
    rng = random.Random(1)
    texts = [None, "", " \n \t", "a", "a b c a b c", "a a a a", "x\ny\nx\n\n \nx ", "é#ñ $ <b> & | %\x0b\x0c*", "日本 語\x85x\xa0y"]
    texts += ["".join(rng.choice(["a ", "b ", "cc ", "\n", "# ", "é", "  "]) for _ in range(rng.randrange(120))) for _ in range(300)]
    for t in texts:
        assert Q.text_counts(t.encode() if t is not None else None)[:5] == plain(t), repr(t)


def test_many_kinds_of_words():
    ids = np.arange(1_000_050)
    ids[-3:] = ids[:3]
    assert Q._repeated(ids, 1_000_050) == 6


def test_long_text():
    t = " ".join(f"w{i % 5000}" for i in range(300_000)).encode()
    assert Q.text_counts(t)[4] == 300_000


def test_learns_planted_rules_only():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    y = (x["a"] > 0.8) | ((x["b"] <= 0.2) & (x["c"] > 0.5))
    rules = Q.learn(x, y)
    found = np.zeros(3000, bool)
    for r in rules:
        found |= r.covers(x)
    assert (found == y).mean() > 0.97 and (found & ~y).sum() < 30
    assert Q.learn(x, rng.random(3000) < 0.3) == []


def rows():
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.randrange(60, 200))), 1) for i in range(150)]
    bad = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) + "$$$" for _ in range(rng.randrange(60, 200))), 0) for i in range(150, 300)]
    return good + bad


def test_list_rejects_what_labels_reject(spark):
    data = rows() + [(900, None, None), (901, "", 1), (902, "few words", 1), (None, "x " * 80, 1)]
    docs = spark.createDataFrame([(k, t, 7) for k, t, _ in data], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in data], "doc_id long, quality int, toxic int")
    judged, rules = Q.judge(spark, docs, labels)
    got = {r.doc_id: r for r in judged.collect()}
    assert len(got) == len(data) and rules
    assert all(got[k].kept == (y == 1) for k, _, y in rows() if not got[k].base_failed)
    assert all(got[k].base_failed and not got[k].kept for k in (900, 901, 902, None))
    assert all(str(r) for r in rules) and "CASE WHEN" in str(Q.verdict(rules))


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows()[:5]], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = Q.judge(spark, docs, none)
    assert rules == [] and all(r.kept != r.base_failed for r in judged.collect())
    assert Q.judge(spark, docs.limit(0), none)[0].collect() == []
