"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, mixing, quality_rules, shard_store, simhash_dedup, token_store, toxicity, warc_fixity
from .common import Scratch, key_crc, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.encode_and_read(spark, table(spark, sf_dir, "documents"), added=True)


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = key_crc(F.col("doc_id")) % 3 == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.predict(spark, docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = key_crc(F.col("doc_id")) % 5 == 0
    languages, weights = language_id.fit(docs, ~held_out)
    return language_id.predict(spark, docs, languages, weights).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a WARC archive, audited against a replica in which one record in 97 has decayed."""
    root = Scratch(spark, "warc").root
    warc_fixity.write(table(spark, sf_dir, "pages"), f"{root}/first")

    def decay(key: int | None, raw: bytes) -> bytes:
        if key is None or key % 97 != 5:
            return raw
        at = len(raw) // 2
        return raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]

    warc_fixity.copy(spark, f"{root}/first", f"{root}/second", decay)
    return warc_fixity.fixity(spark, f"{root}/first", f"{root}/second").withColumnRenamed("key", "page_id")


def op10_shard_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight runs, are compacted by tiers and read back through the newest manifest."""
    docs = table(spark, sf_dir, "documents").withColumn("arrival", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8)).cast("int"))
    store = shard_store.ShardStore(spark, Scratch(spark, "shards").root)
    store.append_arrivals(docs, "arrival")
    store.compact()
    store.vacuum()
    kept = store.read(schema=docs.schema)
    return kept.select("doc_id", "arrival", "lang", "source", F.length("text").cast("long").alias("n_text"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 12) AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM per),
leveled AS (
  SELECT *, row_number() OVER o AS pos,
         ((SELECT sum(source_size) FROM per) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / weight, rank)),
share AS (SELECT arg_min(level, pos) AS share FROM leveled WHERE cap >= weight * level),
goals AS (
  SELECT source, source_size, CASE WHEN share IS NULL THEN cap ELSE least(cap, weight * share) END AS target
  FROM leveled, share),
passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM goals),
hashed AS (SELECT source, h, sum(size)::BIGINT AS n FROM sized GROUP BY ALL),
run AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM hashed)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (s.size * p.passes + CASE WHEN r.upto <= rest THEN s.size WHEN r.upto - r.n >= rest OR r.n = 0 THEN 0
        ELSE s.size * (rest - (r.upto - r.n)) // r.n END)::BIGINT AS taken
FROM sized s
JOIN (SELECT *, round(target)::BIGINT - passes * source_size AS rest FROM passes) p ON s.source IS NOT DISTINCT FROM p.source
JOIN run r ON r.source IS NOT DISTINCT FROM s.source AND r.h = s.h
"""


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?"''()[]{}|#$%&*<>', ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?"''()[]{}|#$%&*<>', ''), '[^\x20\x09-\x0D]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b WHERE len(w) >= 5)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
hit AS (
  SELECT doc_id, item_id FROM ds JOIN bs USING (s) JOIN bn USING (item_id)
  GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n),
good AS (
  SELECT hit.doc_id, hit.item_id FROM hit JOIN b USING (item_id) JOIN d USING (doc_id)
  WHERE len(list_intersect(list_distinct(b.w[-5:]), d.w)) >= 0.5 * len(list_distinct(b.w[-5:]))
  UNION ALL
  SELECT doc_id, item_id FROM d JOIN b ON len(b.w) BETWEEN 1 AND 4 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM good GROUP BY 1)
SELECT documents.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN per USING (doc_id)
"""

_SAFE_URL = functools.reduce(lambda sql, c: f"replace({sql}, chr({c}), '%{c:02X}')", [*range(1, 33), 127], "url")  # DuckDB's strings of Parquet hold no NUL here
OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(concat_ws(chr(10), coalesce(page_id::VARCHAR, ''), coalesce(url, ''), coalesce(html, ''))) AS m, chr(13) || chr(10) AS e FROM pages),
u AS (SELECT *, 'urn:uuid:' || concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) AS urn FROM p),
r AS (
  SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <' || urn || '>' || e || 'WARC-Date: 2000-01-01T00:00:00Z' || e
    || 'WARC-Target-URI: ' || CASE WHEN url = '' THEN urn ELSE {_SAFE_URL} END || coalesce(e || 'X-Record-Key: ' || page_id::VARCHAR, '') || e
    || 'Content-Type: text/html; charset=utf-8' || e || 'Content-Length: ' || strlen(html) || e || e || html || e || e AS record
  FROM u)
SELECT page_id, strlen(record)::BIGINT AS n_bytes, sha256(record) AS digest, coalesce(page_id % 97 = 5, false) AS damaged FROM r
"""

OP10_SQL = """
SELECT doc_id, (coalesce(doc_id, 0) % 8)::INT AS arrival, lang, source, length(text)::BIGINT AS n_text, md5(text) AS text_md5 FROM documents
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op7_benchmark_leaks": OP7_SQL, "op8_warc_fixity": OP8_SQL, "op9_mix_sources": OP9_SQL, "op10_shard_store": OP10_SQL}
