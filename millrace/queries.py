"""One query for each operator over the test tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import ordered as O
from .functions import text as X
from .operators import aggregates as A
from .operators import folds, generic
from .operators import graph as G
from .operators import joins as J
from .operators import routing as R
from .operators import sets as S
from .operators import timeops as T
from .plans import placement as P
from .plans import workflow as W
from .sources import event_log, files, inputs
from .storage import shared_folder, streamed
from .streaming import stateful, streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


EPOCH_SQL = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
CENTS_SQL = "CAST(round(value * 100) AS BIGINT)"
TOKENS_SQL = """list_filter(string_split(regexp_replace(regexp_replace(lower(text), '[?!''"$:@(),.;]', '', 'g'), '[-/]', ' ', 'g'), ' '), lambda x: length(x) > 0)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props", F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("epoch"), F.round(F.col("value") * 100).cast("long").alias("cents"))


EVENTS_SQL = f"WITH e AS (SELECT *, {EPOCH_SQL} AS epoch, {CENTS_SQL} AS cents FROM events) "


# Word count, the smallest whole query.


@query(f"SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest({TOKENS_SQL}) AS w FROM documents) GROUP BY w ORDER BY n DESC, word DESC LIMIT 100")
def wordcount(spark, sf):
    tokens = R.flat_map(table(spark, sf, "documents"), X.tokenize_words(F.col("text")), "word")
    return A.top_items(tokens, "word", 100)


# Sources.


@query(EVENTS_SQL + "SELECT event_id, coalesce(lag(cents) OVER (ORDER BY event_id), 0)::BIGINT AS epoch FROM e")
def epoch_lag(spark, sf):
    return T.stamp_epochs(events(spark, sf).drop("epoch"), F.col("cents"), "event_id").select("event_id", "epoch")


@query(EVENTS_SQL + "SELECT event_id, coalesce(lag(event_id + 1, 4) OVER (ORDER BY event_id), 0)::BIGINT AS epoch FROM e")
def source_distributed(spark, sf):
    return inputs.input_from_source_distributed(events(spark, sf).drop("epoch"), F.col("event_id") + 1, "event_id", 4).select("event_id", "epoch")


@query("SELECT * FROM (VALUES (1, 0), (2, 2), (3, 3), (4, 4), (5, 5)) t(value, epoch)")
def source_closure(spark, sf):
    left = iter(range(1, 6))

    def closure():
        x = next(left, None)
        return ((x,), x + 1) if x is not None else (None, None)

    return inputs.new_input(spark, closure, "value int").select("value", F.col("epoch").cast("int").alias("epoch"))


@query("SELECT o_orderkey, o_orderkey * 2 AS loaded FROM orders")
def source_buffered(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    return inputs.input_buffered(keys, lambda f: f.assign(loaded=f["o_orderkey"] * 2), "o_orderkey long, loaded long", peers=4, order="o_orderkey")


@query("SELECT r_name AS name, 0::BIGINT AS epoch FROM region")
def source_to_stream(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "region").select("r_name").collect()]  # five
    return inputs.to_stream(spark, rows, "name string")


@query("SELECT r_name AS name FROM region WHERE false")
def source_empty(spark, sf):
    return inputs.empty(spark, "name string")


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) * 25000000)::BIGINT AS arrival_ns FROM events")
def source_rate(spark, sf):
    return T.arrivals(table(spark, sf, "events").select("event_id"), "event_id", 40.0).select("event_id", "arrival_ns")


@query("SELECT uid::BIGINT AS uid, format('COCO_train2014_{:012d}.jpg', o_custkey) AS image_path, format('{:012d}.flac', o_orderkey) AS speech_path FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS uid FROM orders) WHERE uid < 50")
def read_dataset_topn(spark, sf):
    questions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("image_id"))
    images, speech = files.read_questions(questions, 50, "train")
    return J.join(images, speech, "uid")


@query(EVENTS_SQL + "SELECT epoch, array_to_string(list(event_id ORDER BY event_id), ',') AS rows FROM e GROUP BY epoch")
def extract_sorted(spark, sf):
    return event_log.extract(events(spark, sf), F.col("event_id")).select("epoch", F.array_join("rows", ",").alias("rows"))


# Projections and routing.


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round((1 - l_discount) * 100) AS BIGINT) AS revenue FROM lineitem")
def map_project(spark, sf):
    price, rest = F.round(F.col("l_extendedprice") * 100).cast("long"), F.round((1 - F.col("l_discount")) * 100).cast("long")
    return R.map_rows(table(spark, sf, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), revenue=price * rest)


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation")
def map_in_place(spark, sf):
    return R.map_in_place(table(spark, sf, "nation"), n_name=F.upper("n_name"))


@query(f"SELECT doc_id, w AS word, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS w FROM documents) GROUP BY doc_id, w")
def flat_map_tokens(spark, sf):
    return R.flat_map(table(spark, sf, "documents"), X.tokenize_words(F.col("text")), "word", ["doc_id"]).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query(EVENTS_SQL + "SELECT event_id, epoch, ((row_number() OVER (PARTITION BY epoch ORDER BY event_id) - 1) // 64)::BIGINT AS batch FROM e")
def batch_map_ids(spark, sf):
    return R.batch_ids(events(spark, sf), "epoch", "event_id").select("event_id", "epoch", "batch")


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem")
def batch_map(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return R.batch_map(rows, lambda f: f.assign(twice=f["l_quantity"] * 2).drop(columns="l_quantity"), "l_orderkey long, l_linenumber int, twice double", size=1024)


@query("SELECT o_orderkey, o_orderpriority || '/' || o_orderstatus AS tag FROM orders")
def buffered_map(spark, sf):
    return R.buffered_map(table(spark, sf, "orders"), o_orderkey=F.col("o_orderkey"), tag=F.concat_ws("/", "o_orderpriority", "o_orderstatus"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND l_discount < 0.05")
def filter_pred(spark, sf):
    return R.filter_rows(table(spark, sf, "lineitem"), (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)).select("l_orderkey", "l_linenumber")


@query(EVENTS_SQL + "SELECT event_type, count(*)::BIGINT AS n, max(epoch)::BIGINT AS last FROM e GROUP BY 1")
def inspect_counts(spark, sf):
    seen, _ = R.inspect(events(spark, sf), "inspect_counts", by="epoch")
    return seen.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"))


@query("SELECT coalesce(value > 50, false) AS side, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def branch_split(spark, sf):
    no, yes = R.branch(table(spark, sf, "events").select("event_id", "value"), F.col("value") > 50)
    both = no.withColumn("side", F.lit(False)).unionByName(yes.withColumn("side", F.lit(True)))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(EVENTS_SQL + "SELECT epoch >= 15 AS late, count(*)::BIGINT AS n FROM e GROUP BY 1")
def branch_when_epoch(spark, sf):
    early, late = R.branch_when(events(spark, sf), "epoch", lambda t: t >= 15)
    both = early.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("late").agg(F.count(F.lit(1)).alias("n"))


K_SQL = "TRY_CAST(json_extract_string(props, '$.k') AS INT)"


def _parsed(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf, "events").select("event_id", R.as_result(F.when(k % 2 == 0, k), F.lit("odd")).alias("r"))


@query(f"SELECT event_id, CASE WHEN {K_SQL} % 2 = 0 THEN {K_SQL} END AS good, CASE WHEN {K_SQL} % 2 = 0 THEN NULL ELSE 'odd' END AS bad FROM events")
def ok_err_split(spark, sf):
    good, bad = R.ok_err(_parsed(spark, sf), "r")
    return good.select("event_id", F.col("r").alias("good"), F.lit(None).cast("string").alias("bad")).unionByName(bad.select("event_id", F.lit(None).cast("int").alias("good"), F.col("r").alias("bad")))


@query(f"SELECT event_id, CASE WHEN {K_SQL} % 2 = 0 THEN CASE WHEN {K_SQL} >= 50 THEN ({K_SQL} + 1)::VARCHAR ELSE 'small' END ELSE 'ODD' END AS out FROM events")
def result_and_then(spark, sf):
    r = R.map_ok(F.col("r"), lambda v: v + 1)
    r = R.map_err(R.and_then(r, lambda v: R.as_result(F.when(v > 50, v), F.lit("small"))), lambda e: F.when(e == "odd", F.upper(e)).otherwise(e))
    return _parsed(spark, sf).select("event_id", R.unwrap_or_else(R.map_ok(r, lambda v: v.cast("string")), lambda e: e).alias("out"))


@query("SELECT (o_orderkey % 3)::INT AS part, count(*)::BIGINT AS n, min(o_orderkey)::BIGINT AS least FROM orders GROUP BY 1")
def partition_route(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    parts = R.partition(orders, 3, R.route(F.col("o_orderkey"), 3))
    return S.concatenate([p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)]).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least"))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def exchange_by_key(spark, sf):
    return R.exchange(table(spark, sf, "orders").select("o_custkey"), 8, "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, p AS peer FROM nation, (SELECT unnest(range(3))::INT AS p)")
def broadcast_rows(spark, sf):
    return R.replicate(table(spark, sf, "nation").select("n_name"), 3)


@query("SELECT r_regionkey, r_name FROM region")
def gather_rows(spark, sf):
    return R.gather(table(spark, sf, "region").select("r_regionkey", "r_name"))


# Joins.


@query("SELECT o_custkey, count(*)::BIGINT AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_inner(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    joined = J.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey")
    return joined.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"))


@query(EVENTS_SQL + "SELECT a.epoch, a.user_id, count(*)::BIGINT AS n FROM e a JOIN e b ON a.epoch = b.epoch AND a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY 1, 2")
def timestamp_join(spark, sf):
    e = events(spark, sf)
    left = e.where("event_type = 'click'").select("epoch", "user_id", F.col("event_id").alias("a"))
    right = e.where("event_type = 'view'").select("epoch", "user_id", F.col("event_id").alias("b"))
    return J.timestamp_join(left, right, "user_id").groupBy("epoch", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name, o.first_order FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def concat_single(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_custkey").alias("seq"))
    right = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order")).withColumn("seq", F.col("c_custkey"))
    return J.concat_join(left, right, ["c_custkey"], "seq").select("l.c_custkey", "l.c_name", "r.first_order")


#: A pair forms where the row before, of the other side, is still waiting: rows alternate in pairs within a run of sides.
CONCAT_SQL = """
WITH RECURSIVE s AS (
  SELECT user_id, event_id, (event_type = 'view')::INT AS side, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
  FROM events WHERE event_type IN ('click', 'view')),
w AS (
  SELECT user_id, rn, side AS wait_side, event_id AS wait_id, NULL::BIGINT AS click_id, NULL::BIGINT AS view_id FROM s WHERE rn = 1
  UNION ALL
  SELECT s.user_id, s.rn,
    CASE WHEN w.wait_side IS NOT NULL AND w.wait_side <> s.side THEN NULL ELSE s.side END,
    CASE WHEN w.wait_side IS NOT NULL AND w.wait_side <> s.side THEN NULL ELSE s.event_id END,
    CASE WHEN w.wait_side <> s.side THEN CASE WHEN s.side = 0 THEN s.event_id ELSE w.wait_id END END,
    CASE WHEN w.wait_side <> s.side THEN CASE WHEN s.side = 1 THEN s.event_id ELSE w.wait_id END END
  FROM w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1)
SELECT user_id, click_id, view_id FROM w WHERE click_id IS NOT NULL
"""


@query(CONCAT_SQL)
def concat_overwrite(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    left, right = (e.where(F.col("event_type") == t).select("user_id", "event_id") for t in ("click", "view"))
    return J.concat_join(left, right, ["user_id"], "event_id").select("l.user_id", F.col("l.event_id").alias("click_id"), F.col("r.event_id").alias("view_id"))


@query(EVENTS_SQL + "SELECT a.epoch, a.user_id, a.f AS click, b.f AS view FROM (SELECT epoch, user_id, min(event_id) AS f FROM e WHERE event_type = 'click' GROUP BY 1, 2) a JOIN (SELECT epoch, user_id, min(event_id) AS f FROM e WHERE event_type = 'view' GROUP BY 1, 2) b ON a.epoch = b.epoch AND a.user_id = b.user_id")
def timestamp_concat(spark, sf):
    e = events(spark, sf)
    left, right = (e.where(F.col("event_type") == t).groupBy("epoch", "user_id").agg(F.min("event_id").alias("f")) for t in ("click", "view"))
    return J.timestamp_concat(left, right, ["user_id"], "f").select("l.epoch", "l.user_id", F.col("l.f").alias("click"), F.col("r.f").alias("view"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS rn FROM orders)
SELECT o_custkey, count(*)::BIGINT AS n FROM (SELECT a.o_custkey FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.rn // 2 = b.rn // 2) GROUP BY 1""")
def join_counted(spark, sf):
    """Both sides are evicted after two rows each: pairs form within groups of two (a last group may be short)."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lit(2).alias("expect"))
    return J.counted_join(o, o, ["o_custkey"], "o_orderkey", "expect").groupBy(F.col("l.o_custkey").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def hash_join(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return J.join(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), nation, "s_nationkey").select("s_suppkey", "s_name", "n_name")


@query("SELECT turn_id, CAST(i - 1 AS INT) AS position, c.w[i] AS l, reverse(c.w[i]) AS r FROM (SELECT conv_id * 1000 + turn AS turn_id, string_split(text, ' ') AS w FROM conversations) c, unnest(range(1, len(c.w) + 1)) t(i)")
def zip_positional(spark, sf):
    words = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.split("text", " ").alias("w"))
    other = words.select("turn_id", F.transform("w", F.reverse).alias("v"))
    return J.zip_by_position(words, other, "w", "v", "turn_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_vocab(spark, sf):
    return J.member(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_member FROM documents")
def flag_members(spark, sf):
    return J.flag_member(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").where("toxic = 1"), "doc_id")


@query(f"SELECT d.doc_id, coalesce(l.quality, {X.OUT_OF_VOCABULARY}) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def default_lookup(spark, sf):
    return J.lookup(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "quality", F.lit(X.OUT_OF_VOCABULARY)).select("doc_id", "quality")


FALLBACK_ROWS = [("resnet18", "base", 1.0), ("default", "base", 2.0), ("resnet18", "default", 3.0), ("default", "default", 4.0)]


@query("SELECT * FROM (VALUES ('resnet18', 'base', 1.0::DOUBLE), ('resnet50', 'base', 2.0), ('resnet18', 'large', 3.0), ('resnet50', 'large', 4.0)) t(u_model, v_model, size)")
def variant_fallback(spark, sf):
    known = spark.createDataFrame(FALLBACK_ROWS, "u_model string, v_model string, size double")
    asked = spark.createDataFrame([(u, v) for u in ("resnet18", "resnet50") for v in ("base", "large")], "u_model string, v_model string")
    return J.fallback_lookup(asked, known, "u_model", "v_model", "size")


# Aggregates.


@query("SELECT user_id, chunk, sum(cents)::BIGINT AS total FROM (SELECT user_id, cents, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5)::BIGINT AS chunk FROM (SELECT *, " + CENTS_SQL + " AS cents FROM events)) GROUP BY 1, 2 HAVING count(*) = 5")
def agg_count_bounded(spark, sf):
    return A.aggregate(events(spark, sf), ["user_id"], 5, "event_id", total=F.sum("cents"))


@query("SELECT user_id, chunk, sum(cents)::BIGINT AS total FROM (SELECT user_id, cents, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3)::BIGINT AS chunk FROM (SELECT *, " + CENTS_SQL + " AS cents FROM events)) GROUP BY 1, 2 HAVING count(*) = 3")
def agg_counted_by_data(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", "cents", F.lit(3).alias("expect"))
    got = A.counted_aggregate(e, ["user_id"], "expect", ["event_id"], lambda rows: {"user_id": rows[0]["user_id"], "first": rows[0]["event_id"], "total": sum(r["cents"] for r in rows)}, "user_id long, first long, total long")
    return O.number_rows(got, "first", by=["user_id"], out="rn").select("user_id", (F.col("rn") - 1).cast("long").alias("chunk"), "total")


@query(EVENTS_SQL + "SELECT epoch, event_type, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total FROM e GROUP BY 1, 2")
def agg_epoch(spark, sf):
    return A.timestamp_aggregate(events(spark, sf), ["event_type"], n=F.count(F.lit(1)), total=F.sum("cents"))


FOLD_SQL = (
    "WITH RECURSIVE s AS (SELECT user_id, event_id, abs(" + CENTS_SQL + ") AS cents, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), "
    "w AS (SELECT user_id, rn, event_id, cents AS held FROM s WHERE rn = 1 UNION ALL SELECT s.user_id, s.rn, s.event_id, CASE WHEN w.held >= 20000 THEN 0 ELSE w.held END + s.cents FROM w JOIN s ON s.user_id = w.user_id AND s.rn = w.rn + 1) "
    "SELECT user_id, event_id AS until, held::BIGINT AS total FROM w WHERE held >= 20000"
)


@query(FOLD_SQL)
def fold_until(spark, sf):
    e = events(spark, sf).select("user_id", "event_id", F.abs("cents").alias("cents"))

    def fold(state, row):
        total = state[0] + row["cents"]
        return (total, row["event_id"]), total >= 20000

    return A.incremental_aggregate(e, ["user_id"], ["event_id"], lambda: (0, None), fold, lambda key, s: {"user_id": key[0], "until": s[1], "total": s[0]}, "user_id long, until long, total long")


@query(EVENTS_SQL + "SELECT epoch, user_id, max(cents)::BIGINT AS top, min(event_id)::BIGINT AS first FROM e GROUP BY 1, 2")
def fold_epoch(spark, sf):
    return A.timestamp_incremental_aggregate(events(spark, sf), ["user_id"], top=F.max("cents"), first=F.min("event_id"))


@query(EVENTS_SQL + "SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM e")
def state_machine_running(spark, sf):
    return A.running_totals(events(spark, sf), "cents", "event_id", ["user_id"]).select("event_id", "total")


@query(EVENTS_SQL + "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seen FROM e")
def state_machine_fold(spark, sf):
    e = events(spark, sf).select("user_id", "event_id")
    return A.state_machine(e, ["user_id"], ["event_id"], lambda: 0, lambda s, r: (False, s + 1, [{"user_id": r["user_id"], "event_id": r["event_id"], "seen": s + 1}]), "user_id long, event_id long, seen long")


@query(EVENTS_SQL + "SELECT epoch, sum(cents)::BIGINT AS value FROM e GROUP BY 1")
def accumulate_epoch(spark, sf):
    return A.accumulate(events(spark, sf).select("epoch", "cents", "event_id"), F.lit(0).cast("long"), lambda a, x: a + x, F.col("cents"), order=F.col("event_id"))


@query(EVENTS_SQL + "SELECT epoch, count(*)::BIGINT AS n FROM e GROUP BY 1")
def count_epoch(spark, sf):
    return A.count(events(spark, sf))


@query(EVENTS_SQL + "SELECT DISTINCT epoch, user_id FROM e")
def distinct_epoch(spark, sf):
    return A.distinct(events(spark, sf), "user_id")


@query(EVENTS_SQL + "SELECT event_type, epoch, sum(sum(CASE WHEN value >= 50 THEN 1 ELSE -1 END)) OVER (PARTITION BY event_type ORDER BY epoch)::BIGINT AS total FROM e GROUP BY event_type, epoch")
def word_totals(spark, sf):
    return A.word_totals(events(spark, sf).withColumn("diff", F.when(F.col("value") >= 50, 1).otherwise(-1)), "event_type", "diff")


@query("SELECT (length(bin(x)) - 1)::INT AS high, CASE WHEN length(bin(x)) - 1 >= 5 THEN (x >> (length(bin(x)) - 6)) & 31 ELSE x & 31 END::INT AS low, count(*)::BIGINT AS n FROM (SELECT o_orderkey AS x FROM orders WHERE o_orderkey > 0) GROUP BY 1, 2")
def latency_histogram(spark, sf):
    return A.latency_histogram(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_custkey, string_agg(item || ':' || n, ',' ORDER BY n DESC, p) AS answers FROM (SELECT o_custkey, o_orderpriority AS item, count(*) AS n, min(o_orderkey) AS p FROM orders GROUP BY 1, 2) GROUP BY 1")
def answers_occurrence(spark, sf):
    found = A.most_common(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")
    return found.select("o_custkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["item"], x["count"].cast("string"))), ",").alias("answers"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 3")
def top_answers(spark, sf):
    return A.top_items(table(spark, sf, "orders"), "o_orderpriority", 3)


@query("SELECT event_type, avg(cents) AS mean, stddev_pop(cents) AS std, min(cents)::BIGINT AS min, max(cents)::BIGINT AS max, quantile_cont(cents, 0.1) AS p10, quantile_cont(cents, 0.5) AS p50, quantile_cont(cents, 0.75) AS p75, quantile_cont(cents, 0.9) AS p90, quantile_cont(cents, 0.95) AS p95, quantile_cont(cents, 0.99) AS p99 FROM (SELECT event_type, (" + CENTS_SQL + ") AS cents FROM events) GROUP BY 1")
def profile_percentiles(spark, sf):
    return A.profile(events(spark, sf), "cents", ["event_type"])


@query("SELECT median(kb) AS median, max(kb) AS max, quantile_cont(kb, 0.99) AS p99 FROM (SELECT strlen(html) / 1024.0 AS kb FROM pages)")
def message_size_stats(spark, sf):
    return A.message_sizes(table(spark, sf, "pages").select(F.octet_length("html").alias("size")), "size").select("median", "max", "p99")


@query("SELECT quantile_cont(v / 1e6, 0.5) AS p50, quantile_cont(v / 1e6, 0.999) AS p99_9 FROM (SELECT o_orderkey * 1000 AS v FROM orders)")
def latency_stats(spark, sf):
    return A.latencies(table(spark, sf, "orders").select((F.col("o_orderkey") * 1000).alias("ns")), "ns").select("p50", "p99_9")


@query("""WITH s AS (SELECT o_orderkey * 1000 AS t, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
w AS (SELECT (rn - 21) // 10 AS "window", max(t) AS e FROM s WHERE rn > 20 GROUP BY 1 HAVING count(*) = 10)
SELECT "window"::BIGINT AS "window", 10 * 1e9 / (e - f) AS throughput FROM (SELECT *, lag(e) OVER (ORDER BY "window") AS f FROM w) WHERE f IS NOT NULL AND e > f""")
def throughput_windows(spark, sf):
    return A.throughput_windows(table(spark, sf, "orders").select((F.col("o_orderkey") * 1000).alias("t")), "t")


@query("SELECT event_type, (max(event_id * 1000) - min(event_id * 1000)) / 1e9 AS jct FROM events GROUP BY 1")
def completion_time(spark, sf):
    t = F.col("event_id") * 1000
    return table(spark, sf, "events").groupBy("event_type").agg(A.completion_seconds(t, t).alias("jct"))


@query("SELECT event_type, sum(cents * event_id) / sum(event_id) AS mean, sum(cents)::BIGINT AS total, arg_max(cents, event_id)::BIGINT AS last FROM (SELECT *, " + CENTS_SQL + " AS cents FROM events) GROUP BY 1")
def weighted_meters(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(A.weighted_mean(F.col("cents"), F.col("event_id")).alias("mean"), F.sum("cents").alias("total"), A.last_value(F.col("cents"), F.col("event_id")).alias("last"))


MILLI_SQL = "list_transform(embedding, lambda v: CAST(round(v::DOUBLE * 1000) AS BIGINT))"


@query(f"""WITH x AS (SELECT vec_id, label, {MILLI_SQL} AS e FROM embeddings),
c AS (SELECT label AS class, list(s ORDER BY i) AS c, max(n) AS n FROM (SELECT label, i, sum(e[i])::BIGINT AS s, count(*) AS n FROM x, unnest(range(1, len(e) + 1)) t(i) GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT vec_id, label, class, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * c[i])) / n DESC, class) AS k FROM x, c)
SELECT avg(CASE WHEN k <= 1 THEN 100.0 ELSE 0 END) AS acc1, avg(CASE WHEN k <= 5 THEN 100.0 ELSE 0 END) AS acc5 FROM r WHERE class = label""")
def accuracy_at_k(spark, sf):
    """Every embedding scored against the mean embedding of each label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long")).alias("e"))
    sums = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    classes = sums.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("c"), F.max("n").alias("n")).orderBy("label").collect()  # a row a label
    scores = F.array(*(F.aggregate(F.zip_with("e", F.array(*(F.lit(p["s"]) for p in r.c)), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x) / r.n for r in classes))
    ranked = e.select(F.transform(N.top_k(scores, 5), lambda k: F.element_at(F.array(*(F.lit(r.label) for r in classes)), k + 1)).alias("top"), F.col("label").alias("target"))
    return ranked.agg(A.accuracy_at(1, F.col("top"), F.col("target")).alias("acc1"), A.accuracy_at(5, F.col("top"), F.col("target")).alias("acc5"))


#: The edit distance row by row: each row from the one before, then insertions from left to right.
WER_SQL = """
WITH p AS (SELECT list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS a, list_filter(string_split_regex(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '\\s+'), lambda w: w <> '') AS b FROM conversations),
q AS (SELECT a, list_concat([range(0, len(b) + 1)], list_transform(a, lambda x: list_transform(b, lambda y: (x <> y)::BIGINT))) AS t FROM p WHERE b IS NOT NULL),
e AS (SELECT len(a) AS words, list_reduce(t, lambda r, n: list_reduce(list_concat([[r[1] + 1]], list_transform(range(1, len(n) + 1), lambda j: [least(r[j + 1] + 1, r[j] + n[j])])), lambda s, m: list_append(s, least(m[1], s[len(s)] + 1))))[-1] AS edits FROM q)
SELECT sum(edits)::BIGINT AS edits, sum(words)::BIGINT AS words, sum(edits) / sum(words) AS wer FROM e
"""


@query(WER_SQL)
def word_error_rate(spark, sf):
    """Every turn of a conversation against the next one."""
    turns = table(spark, sf, "conversations").select(F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b"))
    return A.word_error_rate(turns.where("b is not null"), "a", "b")


# Windows, order, top k.


@query("SELECT event_type, event_id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn FROM events) WHERE rn <= 3")
def lowest_per_variant(spark, sf):
    low = A.lowest_per_group(table(spark, sf, "events"), ["event_type"], ["value", "event_id"], 3)
    return low.select("event_type", "event_id", F.row_number().over(Window.partitionBy("event_type").orderBy("value", "event_id")).alias("rn"))


@query("SELECT vec_id, list_position(e, list_max(e)) - 1 AS best, array_to_string(list_transform(list_sort(list_transform(range(0, len(e)), lambda i: {'s': -e[i + 1], 'i': i}))[1:5], lambda p: p.i), ',') AS top FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000000) AS BIGINT)) AS e FROM embeddings)")
def top_five(spark, sf):
    scores = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long"))
    e = table(spark, sf, "embeddings").select("vec_id", scores.alias("s"))
    return e.select("vec_id", N.argmax(F.col("s")).cast("int").alias("best"), F.array_join(N.top_k(F.col("s"), 5), ",").alias("top"))


@query("SELECT c_custkey, c_acctbal / (c_custkey + 1) AS unit_cost FROM customer ORDER BY 2, c_acctbal LIMIT 20")
def cheapest_units(spark, sf):
    return A.cheapest_units(table(spark, sf, "customer"), F.col("c_acctbal"), F.col("c_custkey") + 1, 20).select("c_custkey", "unit_cost")


# Sets.


@query("SELECT 'o' AS kind, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'l', count(*), sum(l_orderkey) FROM lineitem")
def union_all(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("o").alias("kind"), F.col("o_orderkey").alias("k"))
    b = table(spark, sf, "lineitem").select(F.lit("l").alias("kind"), F.col("l_orderkey").alias("k"))
    return S.union(a, b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query("SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier")
def concatenate_multi(spark, sf):
    return S.concatenate([table(spark, sf, t).select(F.col(c).alias("name")) for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"))])


@query("SELECT doc_id, source, NULL::BIGINT AS conv_id FROM documents UNION ALL SELECT NULL, NULL, conv_id FROM conversations WHERE turn = 0")
def union_widened(spark, sf):
    return S.widened(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "conversations").where("turn = 0").select("conv_id"))


# Text.


@query("SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text, '([-.,!?:;\"''()/$&%@#*\\[\\]{}<>|=+ \\n]|[^-.,!?:;\"''()/$&%@#*\\[\\]{}<>|=+ \\n]+)'), lambda x: x NOT IN ('', ' ', chr(10))), '~') AS tokens FROM conversations")
def tokenize_keeping(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.tokenize_keeping(F.col("text")), "~").alias("tokens"))


@query(f"SELECT conv_id, turn, array_to_string({TOKENS_SQL}, ' ') AS answer FROM conversations")
def normalize_answers(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("answer"))


def _question_tokens(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), X.tokenize_words(F.col("text")).alias("t"))
    return R.flat_map(q, F.col("t"), "word", ["q"], position="pos")


VOCAB_SQL = f"""WITH q AS (SELECT conv_id * 1000 + turn AS q, {TOKENS_SQL} AS t FROM conversations WHERE role = 'user'),
tok AS (SELECT q, (i - 1)::INT AS pos, t[i] AS word FROM q, unnest(range(1, len(t) + 1)) r(i)),
v AS (SELECT word, n, row_number() OVER (ORDER BY fq, fp)::BIGINT AS wid FROM (SELECT word, count(*)::BIGINT AS n, min(q) AS fq, arg_min(pos, (q, pos)) AS fp FROM tok GROUP BY 1) WHERE n > 2)
"""


@query(VOCAB_SQL + "SELECT word, n, wid FROM v")
def vocab_build(spark, sf):
    return X.vocabulary(_question_tokens(spark, sf), "q", "pos", "word", above=2)


@query(VOCAB_SQL + "SELECT q, string_agg(coalesce(wid, (SELECT coalesce(max(wid), 0) + 1 FROM v))::VARCHAR, ',' ORDER BY pos) AS wids, string_agg(CASE WHEN wid IS NULL THEN 'UNK' ELSE tok.word END, ' ' ORDER BY pos) AS words FROM tok LEFT JOIN v ON tok.word = v.word GROUP BY q")
def encode_questions(spark, sf):
    tokens = _question_tokens(spark, sf)
    found = X.encode(tokens, X.vocabulary(tokens, "q", "pos", "word", above=2), "q", "pos", "word")
    return found.select("q", F.array_join("wids", ",").alias("wids"), F.array_join("words", " ").alias("words"))


@query(VOCAB_SQL + "SELECT count(*)::BIGINT AS n, count(*) FILTER (wid IS NULL)::BIGINT AS unknown FROM tok LEFT JOIN v ON tok.word = v.word")
def unk_rate(spark, sf):
    tokens = _question_tokens(spark, sf)
    vocab = X.vocabulary(tokens, "q", "pos", "word", above=2).select("word", "wid")
    return tokens.join(vocab, "word", "left").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("wid").isNull(), 1)).alias("unknown"))


@query(VOCAB_SQL + """, s AS (SELECT q, list(coalesce(wid, 0) ORDER BY pos)[1:6] AS ids FROM tok LEFT JOIN v ON tok.word = v.word GROUP BY q)
SELECT q, array_to_string(list_concat(ids, list_transform(range(0, 6 - len(ids)), lambda x: 0::BIGINT)), ',') AS padded, array_to_string(list_concat(list_transform(range(0, 6 - len(ids)), lambda x: 0::BIGINT), ids), ',') AS padded_left FROM s""")
def pad_questions(spark, sf):
    tokens = _question_tokens(spark, sf)
    vocab = X.vocabulary(tokens, "q", "pos", "word", above=2).select("word", "wid")
    known = tokens.join(vocab, "word", "left").groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("wid", F.lit(0).cast("long")).alias("i")))), lambda x: x["i"]).alias("ids"))
    return known.select("q", F.array_join(X.pad(F.col("ids"), 6), ",").alias("padded"), F.array_join(X.pad(F.col("ids"), 6, left=True), ",").alias("padded_left"))


@query("SELECT o_orderkey, format('COCO_{}_{:012d}.jpg', CASE WHEN o_orderkey % 2 = 0 THEN 'train2014' ELSE 'val2014' END, o_orderkey) AS name FROM orders")
def image_names(spark, sf):
    split = F.when(F.col("o_orderkey") % 2 == 0, F.lit("train")).otherwise("val")
    return table(spark, sf, "orders").select("o_orderkey", X.image_name(split, F.col("o_orderkey")).alias("name"))


@query("SELECT * FROM (VALUES ('yes', true), ('t', true), ('n', false), ('1', true), ('maybe', NULL), (NULL, NULL)) t(s, b)")
def bool_words(spark, sf):
    return spark.createDataFrame([("yes",), ("t",), ("n",), ("1",), ("maybe",), (None,)], "s string").select("s", X.str2bool(F.col("s")).alias("b"))


@query("SELECT o_custkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def nested_flatten(spark, sf):
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("qas"))
    return X.nested_pairs(nested.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), "o_custkey", "qas", ["l_linenumber", "l_partkey"])


@query("SELECT vec_id, round(list_max(s), 6) AS top, round(list_sum(s), 6) AS total FROM (SELECT vec_id, list_transform(x, lambda v: exp(v) / list_sum(list_transform(x, lambda w: exp(w)))) AS s FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings))")
def softmax_scores(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", N.softmax(F.transform("embedding", lambda v: v.cast("double"))).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 6).alias("top"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT p_partkey, round(1000.0 / p_size, 9) AS rate, round(p_retailprice * 3600 / 1024 / 1024, 9) AS gb FROM part")
def rates_and_volumes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(N.throughput(F.col("p_size").cast("double")), 9).alias("rate"), F.round(N.gb_per_hour(F.col("p_retailprice")), 9).alias("gb"))


@query("SELECT x, CASE WHEN x < 0 OR x > 40 THEN NULL ELSE 2 * x END AS y FROM (SELECT unnest(range(-5, 46))::DOUBLE AS x)")
def interpolate_profile(spark, sf):
    points = spark.createDataFrame([(float(x), 2.0 * x) for x in range(0, 50, 10)], "x double, y double")
    return N.interpolate(points, spark.range(-5, 46).select(F.col("id").cast("double").alias("x")), "x", "y")


@query("SELECT x::BIGINT AS x, x >= 2 AND len(list_filter(range(2, x), lambda d: x % d = 0)) = 0 AS prime FROM (SELECT unnest(range(0, 400)) AS x)")
def trial_primes(spark, sf):
    return spark.range(400).select(F.col("id").alias("x"), N.is_prime(F.col("id")).alias("prime"))


# Time.


@query(EVENTS_SQL + "SELECT (ceil(epoch / 7.0) * 7)::BIGINT AS epoch, count(*)::BIGINT AS n FROM e GROUP BY 1")
def delay_tumbling(spark, sf):
    return A.count(T.delay(events(spark, sf), T.tumbling(F.col("epoch"), 7)))


@query(EVENTS_SQL + "SELECT event_id, t.tick::BIGINT AS tick FROM e, LATERAL (SELECT min(tick) AS tick FROM (VALUES (3), (5), (8), (20)) c(tick) WHERE tick >= epoch) t WHERE t.tick IS NOT NULL")
def reclock_ticks(spark, sf):
    ticks = spark.createDataFrame([(3,), (5,), (8,), (20,)], "tick long")
    return T.reclock(events(spark, sf).select("event_id", "epoch"), ticks, width=4).select("event_id", "tick")


@query(EVENTS_SQL + "SELECT epoch, count(*)::BIGINT AS n FROM e WHERE epoch < (SELECT least(max(epoch) FILTER (event_type = 'click'), max(epoch) FILTER (event_type = 'view')) FROM e) GROUP BY 1")
def notify_complete(spark, sf):
    e = events(spark, sf)
    closed, _ = T.complete_before(e, T.frontier(e.where("event_type = 'click'"), e.where("event_type = 'view'")))
    return A.count(closed)


# Iteration.


@query("WITH RECURSIVE c AS (SELECT x AS value, x, 0 AS steps FROM (SELECT unnest(range(1, 200))::BIGINT AS x) UNION ALL SELECT value, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, steps + 1 FROM c WHERE x > 1) SELECT value, max(steps)::INT AS steps FROM c GROUP BY 1")
def collatz_loop(spark, sf):
    return G.collatz(spark.range(1, 200).withColumnRenamed("id", "value"))


def _edges(spark, sf):
    customers = table(spark, sf, "customer").select((F.col("c_custkey") + 1000000).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), (F.col("n_regionkey").cast("long") + 500).alias("dst"))
    return S.union(customers, nations)


EDGES_SQL = "e AS (SELECT c_custkey + 1000000 AS src, c_nationkey::BIGINT AS dst FROM customer UNION ALL SELECT n_nationkey, n_regionkey + 500 FROM nation), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query("WITH RECURSIVE " + EDGES_SQL + ", w AS (SELECT 500::BIGINT AS node, 0 AS level UNION SELECT b.dst, w.level + 1 FROM w JOIN b ON b.src = w.node WHERE w.level < 3), f AS (SELECT node, min(level) AS level FROM w GROUP BY 1) SELECT f.node, f.level::INT AS level, CASE WHEN f.level = 0 THEN f.node ELSE (SELECT min(p.node) FROM f p JOIN b ON b.src = p.node WHERE b.dst = f.node AND p.level = f.level - 1) END AS parent FROM f")
def bfs_levels(spark, sf):
    e = _edges(spark, sf)
    return G.bfs(e.union(e.select("dst", "src")), F.lit(500).cast("long"), levels=3)


@query("WITH " + EDGES_SQL + ", n AS (SELECT n_nationkey AS k, n_regionkey + 500 AS r FROM nation), a AS (SELECT src AS node, coalesce(n.r, e.dst) AS r FROM e LEFT JOIN n ON n.k = e.dst AND e.src >= 1000000 UNION SELECT dst, coalesce(n.r, e.dst) FROM e LEFT JOIN n ON n.k = e.dst AND e.src >= 1000000) SELECT node, min(node) OVER (PARTITION BY r) AS component FROM a")
def connected_components(spark, sf):
    return G.connected_components(_edges(spark, sf))


@query("WITH " + EDGES_SQL + ", n AS (SELECT n_nationkey AS k, n_regionkey + 500 AS r FROM nation), a AS (SELECT src AS node, coalesce(n.r, e.dst) AS r FROM e LEFT JOIN n ON n.k = e.dst AND e.src >= 1000000 UNION SELECT dst, coalesce(n.r, e.dst) FROM e LEFT JOIN n ON n.k = e.dst AND e.src >= 1000000) SELECT node, root FROM (SELECT node, min(node) OVER (PARTITION BY r) AS root FROM a) WHERE node <> root")
def union_find(spark, sf):
    return G.spanning_roots(_edges(spark, sf))


@query("""WITH RECURSIVE """ + EDGES_SQL + """, d AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS deg FROM b),
n AS (SELECT DISTINCT src AS node FROM b),
r AS (SELECT 0 AS i, node, 1000::BIGINT AS rank FROM n
 UNION ALL SELECT i + 1, node, rank FROM (SELECT r.i, d.dst AS node, (1000 + sum((r.rank * 5 // 6) // d.deg + CASE WHEN d.k < (r.rank * 5 // 6) % d.deg THEN 1 ELSE 0 END))::BIGINT AS rank FROM r JOIN d ON d.src = r.node WHERE r.i < 10 GROUP BY r.i, d.dst))
SELECT node, rank FROM r WHERE i = 10""")
def pagerank_int(spark, sf):
    e = _edges(spark, sf)
    return G.pagerank(e.union(e.select("dst", "src")).distinct(), rounds=10)


@query("""WITH RECURSIVE """ + EDGES_SQL + """, d AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS deg FROM b UNION ALL SELECT DISTINCT src, src, -1, 1 FROM b),
r AS (SELECT DISTINCT 0 AS i, src AS node, 1000::BIGINT AS rank FROM b
 UNION ALL SELECT i + 1, node, CASE WHEN abs(total - own) >= 6 THEN total ELSE own END::BIGINT FROM (
  SELECT r.i, d.dst AS node, max(CASE WHEN d.k < 0 THEN r.rank END) AS own, 1000 + sum(CASE WHEN d.k < 0 THEN 0 ELSE (r.rank * 5 // 6) // d.deg + CASE WHEN d.k < (r.rank * 5 // 6) % d.deg THEN 1 ELSE 0 END END) AS total
  FROM r JOIN d ON d.src = r.node WHERE r.i < 10 GROUP BY r.i, d.dst))
SELECT node, rank FROM r WHERE i = 10""")
def pagerank_by_changes(spark, sf):
    """Ranks that move only by six or more."""
    e = _edges(spark, sf)
    return G.pagerank_incremental(e.union(e.select("dst", "src")).distinct(), rounds=10)


@query("SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS neighbours FROM nation GROUP BY 1")
def adjacency_lists(spark, sf):
    return G.adjacency(table(spark, sf, "nation"), "n_regionkey", "n_nationkey").select("n_regionkey", F.array_join("neighbours", ",").alias("neighbours"))


# Operators of one's own.


@query("SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem GROUP BY 1")
def unary_custom(spark, sf):
    def run(frames):
        for f in frames:
            yield f.assign(q=f["l_quantity"].astype("int64")).groupby("l_returnflag", as_index=False)["q"].sum()

    return generic.unary(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), run, "l_returnflag string, q long").groupBy("l_returnflag").agg(F.sum("q").alias("quantity"))


@query("SELECT n_regionkey::BIGINT AS key, count(DISTINCT r_regionkey)::BIGINT AS r, count(DISTINCT n_nationkey)::BIGINT AS l FROM nation LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def binary_custom(spark, sf):
    import pandas as pd

    left = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("key"))
    right = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("key"))
    return generic.binary(left, right, ["key"], lambda a, b: pd.DataFrame({"key": [int((a if len(a) else b)["key"].iloc[0])], "l": [len(a)], "r": [len(b)]}), "key long, l long, r long")


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, count(*) FILTER (price < before)::BIGINT AS falls FROM (SELECT o_orderpriority, o_totalprice AS price, lag(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before FROM orders) GROUP BY 1")
def ordered_fold(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")

    def step(state, row):
        n, falls, last = state
        return (n + 1, falls + (last is not None and row["o_totalprice"] < last), row["o_totalprice"]), []

    return folds.fold_ordered(rows, ["o_orderpriority"], ["o_orderkey"], lambda: (0, 0, None), step, "o_orderpriority string, n long, falls long", finish=lambda key, s: [{"o_orderpriority": key[0], "n": s[0], "falls": s[1]}])


# Streams: the same operators over the event table as an unbounded input.


def _event_stream(spark, sf):
    rows = table(spark, sf, "events")
    stream = inputs.file_source(spark, f"{sf}/events.parquet", rows.schema)
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))


@query("SELECT user_id, sum(cents)::BIGINT AS total, min(event_id) AS first FROM (SELECT user_id, event_id, cents, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS chunk FROM (SELECT *, " + CENTS_SQL + " AS cents FROM events)) GROUP BY user_id, chunk HAVING count(*) = 5")
def stream_agg_count_bounded(spark, sf):
    rows = _event_stream(spark, sf).select("user_id", "event_id", "cents")
    agg = lambda key, f: {"user_id": key[0], "total": int(f["cents"].sum()), "first": int(f["event_id"].min())}
    return streamed(stateful.aggregate_stream(rows, ["user_id"], 5, ["event_id"], agg, "user_id long, total long, first long"), "stream-agg")


@query(FOLD_SQL)
def stream_fold_until(spark, sf):
    rows = _event_stream(spark, sf).select("user_id", "event_id", F.abs("cents").alias("cents"))

    def step(state, row):
        total = int(state[0] + row["cents"])
        return (None, [{"user_id": int(row["user_id"]), "until": int(row["event_id"]), "total": total}]) if total >= 20000 else ((total,), [])

    return streamed(stateful.fold_stream(rows, ["user_id"], ["event_id"], "held long", lambda: (0,), step, "user_id long, until long, total long"), "stream-fold")


@query(EVENTS_SQL + "SELECT epoch, event_type, count(*)::BIGINT AS n, sum(cents)::BIGINT AS total FROM e WHERE epoch < (SELECT max(epoch) FROM e) GROUP BY 1, 2")
def stream_agg_epoch(spark, sf):
    """The last epoch stays open: nothing later has passed it."""
    found = streams.timestamp_aggregate_stream(_event_stream(spark, sf), "ts", "1 day", "0 seconds", ["event_type"], n=F.count(F.lit(1)), total=F.sum("cents"))
    day = F.datediff("epoch", F.lit("2024-01-01").cast("date")).cast("long")
    return streamed(found, "stream-epochs").select(day.alias("epoch"), "event_type", "n", "total")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.ts = b.ts AND a.user_id = b.user_id")
def stream_timestamp_join(spark, sf):
    left = _event_stream(spark, sf).select("ts", "user_id", F.col("event_id").alias("a"))
    right = _event_stream(spark, sf).select("ts", "user_id", F.col("event_id").alias("b"))
    return streamed(streams.timestamp_join_stream(left, right, "ts", "1 hour", ["user_id"]).select("a", "b"), "stream-join")


@query("SELECT DISTINCT date_trunc('hour', ts)::VARCHAR AS hour, user_id FROM events")
def stream_distinct(spark, sf):
    rows = _event_stream(spark, sf).select(F.date_trunc("hour", "ts").alias("hour"), "user_id")
    found = streamed(streams.distinct_stream(rows, "hour", "40 days", "user_id"), "stream-distinct")
    return found.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "user_id")


@query(EVENTS_SQL + "SELECT event_type = 'click' AS streamed, epoch, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM e GROUP BY 1, 2")
def capture_replay(spark, sf):
    """Clicks are captured from a stream, all else in two batches; both logs are replayed and extracted by epoch."""
    folder = shared_folder(spark, "capture")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("epoch")
    clicks = _event_stream(spark, sf).where("event_type = 'click'").select("event_id", day, F.lit(True).alias("streamed"))
    event_log.capture_stream(clicks, f"{folder}/clicks", f"{folder}/state").awaitTermination()
    other = events(spark, sf).where("event_type <> 'click'").select("event_id", "epoch", F.lit(False).alias("streamed"))
    for part in R.branch(other, F.col("epoch") >= 15):
        event_log.capture(part, f"{folder}/other")
    logs = event_log.replay(spark, f"{folder}/clicks", f"{folder}/other")
    found = [event_log.extract(logs.where(F.col("streamed") == s), F.col("event_id")).withColumn("streamed", F.lit(s)) for s in (True, False)]
    return S.concatenate(found).select("streamed", "epoch", F.array_join("rows", ",").alias("ids"))


@query("SELECT event_id, user_id FROM events")
def replay_stream(spark, sf):
    """Two logs replayed as one stream, a file a micro-batch."""
    folder, rows = shared_folder(spark, "replay"), table(spark, sf, "events").select("event_id", "user_id")
    for n, part in enumerate(R.partition(rows, 2, R.route(F.col("event_id"), 2))):
        event_log.capture(part, f"{folder}/{n}")
    return streamed(event_log.replay_stream(spark, rows.schema, f"{folder}/0", f"{folder}/1"), "replayed")


@query("SELECT event_id, value FROM events WHERE event_type = 'click'")
def capture_into_table(spark, sf):
    """The small result of a stream in a table in memory."""
    name = f"captured_{uuid.uuid4().hex[:12]}"
    event_log.capture_into(_event_stream(spark, sf).where("event_type = 'click'").select("event_id", (F.col("cents") / 100).alias("value")), name).awaitTermination()
    return spark.table(name)


@query("SELECT range::BIGINT AS value, (range * range)::BIGINT AS square, (range // 64)::BIGINT AS batch FROM range(0, 1000)")
def stream_pull_source(spark, sf):
    """A thousand rows, pulled 64 at a time; each micro-batch is marked by its number."""
    folder, seen = shared_folder(spark, "pulled"), []

    def keep(rows: DataFrame, n: int) -> None:
        rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        seen.append(n)

    source = inputs.pull_source(spark, lambda at, most: [(i, i * i) for i in range(at, min(at + most, 1000))], "value long, square long", 64)
    running = source.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").start()
    try:
        streams.step_until_done(running)
    finally:
        running.stop()
    return spark.read.parquet(*(f"{folder}/rows/batch={n}" for n in sorted(set(seen))))


# Placement and workflows.

# A worked plan. Latencies in ms, prices, requests a second, KB a message.
PLAN_SPEED = {("asr", "gpu-1"): 40 / 1.0758, ("asr", "cpu-3"): 3.3373}
PLAN = [("image", "cpu-1", 7.0), ("image", "cpu-2", 10.0), ("image", "cpu-5", 23.0), ("asr", "gpu-1", 37.0), ("asr", "cpu-3", 3.0), ("answer", "cpu-6", 40.0)]
PRICES = [("cpu-1", 0.096, 0), ("cpu-2", 0.192, 0), ("cpu-3", 0.384, 0), ("cpu-4", 0.384, 0), ("cpu-5", 0.768, 0), ("cpu-6", 2.305, 1), ("gpu-1", 2.497, 1), ("gpu-2", 2.497, 1), ("gpu-3", 2.497, 1)]
SIZES = [("read_image", "image", 794.0348300933838), ("read_speech", "asr", 97.07174682617188), ("image", "answer", 2.00390625), ("asr", "answer", 0.1)]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


PLAN_SQL = f"""WITH a(node, worker, rate) AS (VALUES {_values(PLAN)}), w(worker, cost, tier) AS (VALUES {_values(PRICES)}), s(u, v, size) AS (VALUES {_values(SIZES)}),
sh AS (SELECT a.*, w.tier, a.rate / sum(a.rate) OVER (PARTITION BY node) AS share FROM a JOIN w USING (worker)),
f AS (SELECT s.u, s.v, x.worker AS uw, y.worker AS vw, coalesce(x.tier, 0) AS ut, y.tier AS vt, y.rate * s.size * coalesce(x.share, 1) AS kb FROM s JOIN sh y ON y.node = s.v LEFT JOIN sh x ON x.node = s.u)
"""


def _plan(spark):
    tiers = spark.createDataFrame(PRICES, "worker string, cost double, tier int")
    sizes = spark.createDataFrame(SIZES, "u string, v string, size double")
    assigned = spark.createDataFrame(PLAN, "node string, worker string, rate double")
    return assigned, tiers, P.edge_traffic(sizes.select("u", "v"), assigned, tiers.select("worker", "tier"), sizes)


@query(PLAN_SQL + "SELECT round(sum(CASE WHEN ut < vt THEN 0.1 * kb * 3600 / 1024 / 1024 ELSE 0 END), 9) AS communication_cost FROM f")
def comm_cost(spark, sf):
    _, tiers, traffic = _plan(spark)
    low, high = ([w for w, _, tier in PRICES if tier == t] for t in (0, 1))
    links = spark.createDataFrame([(a, b, 1.0) for a in low for b in high], "a string, b string, cost double")
    source_links = spark.createDataFrame([(u, b, 1.0) for u in ("read_image", "read_speech") for b in high], "source string, worker string, cost double")
    # Backward traffic (from gpu-1 to none here) would be infinitely dear; the transcript goes up from cpu-3 only.
    return P.communication_cost_query(traffic, links, source_links, scale=0.1).select(F.round("communication_cost", 9).alias("communication_cost"))


@query(PLAN_SQL + "SELECT round(sum(CASE WHEN ut < vt THEN 1 WHEN ut > vt THEN 10 ELSE 0 END * kb * 3600 / 1024 / 1024), 9) AS traffic_volume FROM f")
def traffic_volume(spark, sf):
    return P.traffic_volume_query(_plan(spark)[2]).select(F.round("traffic_volume", 9).alias("traffic_volume"))


@query(PLAN_SQL + "SELECT round(sum(cost), 9) AS compute_cost FROM w WHERE worker IN (SELECT worker FROM a)")
def compute_cost(spark, sf):
    assigned, tiers, _ = _plan(spark)
    return P.compute_cost_query(assigned, tiers).select(F.round("compute_cost", 9).alias("compute_cost"))


@query(f"WITH w(worker, cost, tier) AS (VALUES {_values(PRICES)}), o AS (SELECT cost, (1 << (row_number() OVER (ORDER BY worker) - 1)::INT)::BIGINT AS bit FROM w), m AS (SELECT unnest(range(1, 512))::BIGINT AS mask) SELECT mask, round(sum(cost * 4), 6) AS speed, round(sum(cost), 6) AS cost FROM m JOIN o ON (mask & bit) <> 0 GROUP BY mask HAVING sum(cost * 4) >= 40")
def placement_bruteforce(spark, sf):
    workers = spark.createDataFrame([(n, 4 * c, c) for n, (_, c, _) in enumerate(sorted(PRICES))], "place int, speed double, cost double")
    return P.subsets_query(workers, "place", 40.0).select("mask", F.round("speed", 6).alias("speed"), F.round("cost", 6).alias("cost"))


@query("SELECT * FROM (VALUES ('s1', '', 'a'), ('s2', 'a', 'b,c'), ('s3', 'b,c', '')) t(stage, inputs, outputs)")
def stage_io(spark, sf):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "u string, v string")
    stages = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s2"), ("d", "s3")], "node string, stage string")
    return P.stage_io(edges, stages).select("stage", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"))


@query("SELECT CASE WHEN o_orderkey % 100 < 17 THEN 0 WHEN o_orderkey % 100 < 39 THEN 1 ELSE 2 END AS relay, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def weighted_balance(spark, sf):
    weights = P.balance_weights([7.4, 10.0, 27.25])
    return table(spark, sf, "orders").groupBy(P.balanced(F.col("o_orderkey"), weights).alias("relay")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id AS uid, ((((list_sum(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT))) + length(lower(text))) % 10) + 10) % 10)::BIGINT AS answer
FROM embeddings JOIN conversations ON conv_id = vec_id""")
def vqa_workflow(spark, sf):
    features = table(spark, sf, "embeddings").select(F.col("vec_id").alias("uid"), F.transform("embedding", lambda x: x.cast("double")).alias("feature"))
    questions = table(spark, sf, "conversations").select(F.col("conv_id").alias("uid"), "text")
    return W.question_answering(features, questions).answers.frame


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def two_stage_flow(spark, sf):
    flow = W.FlowBuilder()
    a = flow.input("Orders", table(spark, sf, "orders")).filter("Large", F.col("o_totalprice") > 100000).map("Key", o_orderkey=F.col("o_orderkey"))
    b = flow.input("Lines", table(spark, sf, "lineitem")).filter("Large", F.col("l_quantity") > 45).map("Key", o_orderkey=F.col("l_orderkey"))
    return a.union("Both", b).frame


from . import queries_io, queries_plans  # noqa: E402, F401  they register theirs
