import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from millrace.llm import decontaminate, language_id, mixing, simhash_dedup, token_store
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage got and returned, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((docs.toPandas(), got.toPandas()))
        docs = got
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    assert all(list(got.columns) == COLUMNS for _, got in steps[:-1])


def test_language_keeps_documents_with_letters(steps):
    given, got = steps[0]
    assert set(got.doc_id) <= {k for k, t in zip(given.doc_id, given.text) if any(c.isalpha() for c in t)}
    assert len(got) >= 0.99 * len(given)


def test_one_of_each_near_duplicate_class_stays(steps):
    given, got = steps[1]
    fps = {k: simhash_dedup.fingerprint(t.encode()) for k, t in zip(given.doc_id, given.text)}
    label = {k: k for k in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if label[a] > label[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    label[a], changed = label[b], True
    assert sorted(got.doc_id) == sorted(set(label.values())) and len(got) < len(given)


def test_documents_with_items_go(steps, spark):
    given, got = steps[2]
    items = [D for D in (decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())]
    dirty = set()
    for k, t in zip(given.doc_id, given.text):
        own = decontaminate.shingles(decontaminate.words_of(t.encode()))
        if any(len(s & own) >= 0.8 * len(s) for s in map(decontaminate.shingles, items)):
            dirty.add(k)
    assert sorted(got.doc_id) == sorted(set(given.doc_id) - dirty)


def test_mixture_takes_documents_as_planned(steps, spark):
    given, got = steps[3]
    plan = {r.doc_id: round(r.taken / r["size"] + 1e-9) if r["size"] else 0 for r in mixing.mix(spark, spark.createDataFrame(given)).collect()}
    assert Counter(got.doc_id.tolist()) == Counter({k: n for k, n in plan.items() if n})
    assert max(plan.values()) <= 3 and set(map(tuple, got.itertuples(index=False))) <= set(map(tuple, given.itertuples(index=False)))


def test_tokens_are_those_of_the_library(steps):
    given, got = steps[4]
    t = Tokenizer.from_file(token_store.vocabulary())
    at, want = 0, []
    for k, text in sorted(zip(given.doc_id.tolist(), given.text)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want


def test_run_gives_the_last_stage(steps, spark):
    want = sorted(steps[-1][1][["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, SF).collect()) == want


def test_language_model_is_not_fitted_on_held_out(spark):
    docs = spark.createDataFrame([(k, "abc", "x") for k in range(40)], "doc_id long, text string, lang string")
    used = docs.where(P.key_crc(F.col("doc_id")) % 5 != 0)
    assert language_id.fit(docs, P.key_crc(F.col("doc_id")) % 5 != 0)[1].tolist() == language_id.fit(used, F.lit(True))[1].tolist()


WORDS = "river stone market candle winter garden letter bridge harbour mirror silver forest engine copper meadow thunder window planet basket anchor".split()


def odd_documents():
    """(doc_id, text, lang, source) with nulls, repeated ids, copies, ties, an empty text and a very long one."""
    own = lambda k, n=40: " ".join(rng.choice(WORDS) + rng.choice(["", "s"]) for rng in [random.Random(k)] for _ in range(n))
    rows = [(k, own(k), "en", ["a", "b", "c"][k % 3]) for k in range(30)]
    rows += [(5, own(40), "en", "a"), (5, own(41), "en", "a"), (None, own(42), "en", None), (None, own(43), None, None), (60, own(3), "en", "b"), (None, own(3), "en", "b")]
    rows += [(70, None, "en", "a"), (71, "", "en", "a"), (72, "12 34 !?", "en", "a"), (73, own(44, 30_000), "en", "c"), (7, own(7), "en", "b"), (7, own(7), "en", "b")]
    return rows


def odd_folder(spark, tmp_path, rows):
    names = "doc_id long, text string, lang string, source string, __gone string, __row int, copies int, taken string"
    spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, " ".join(rows[9][1].split()[5:30])), (None, " ".join(rows[11][1].split()[:20])), (3, None)] if rows else []
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_rows_through_all_stages(spark, tmp_path):
    rows = odd_documents()
    folder = odd_folder(spark, tmp_path, rows)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = Counter(docs.select(docs.columns[:2]).rdd.map(tuple).collect()) if name != "tokens" else docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "__gone", "__row", "copies", "taken"]
    texts = [(k, t) for k, t, _, _ in rows]
    assert kept["language"] == Counter((k, t) for k, t in texts if t and any(c.isalpha() for c in t))
    # One row of each class of near copies: here only equal texts are near.
    distinct = {t for _, t in kept["language"]}
    fps = [simhash_dedup.fingerprint(t.encode()) for t in distinct]
    assert all((a ^ b).bit_count() > 4 for a, b in itertools.combinations(fps, 2))
    least = {}
    for k, t in kept["language"]:
        least[t] = min(least.get(t, (True, 0)), (k is None, k or 0))
    assert kept["near_duplicates"] == Counter((None if none else k, t) for t, (none, k) in least.items())
    assert kept["decontaminate"] == Counter({(k, t): n for (k, t), n in kept["near_duplicates"].items() if t not in (rows[9][1], rows[11][1])})
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and max(kept["mix"].values()) <= 3
    assert len(kept["tokens"]) == sum(kept["mix"].values()) and {r.doc_id for r in kept["tokens"]} == {k for k, _ in kept["mix"]}
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in P.run(spark, folder).collect()) == sorted((r.start, r.n_tokens, r.ids_crc32) for r in kept["tokens"])


def test_empty_tables_through_all_stages(spark, tmp_path):
    assert P.run(spark, odd_folder(spark, tmp_path, [])).collect() == []
