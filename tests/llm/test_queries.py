"""Every corpus query that has SQL, against it, and what SQL can't express for its columns."""

import math

import duckdb
import pytest

from millrace.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op2_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op3_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_page_text": ["page_id", "url", "text", "n_chars"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
}


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    found = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_the_columns_and_a_row_each(spark, name):
    df = Q.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    assert df.count() == spark.read.parquet(f"{SF}/{'pages' if 'page' in name else 'documents'}.parquet").count()


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))
