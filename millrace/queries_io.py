"""Queries of sources, sinks, decoders, functions, times and custom operators that the main module leaves out."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from .functions import numeric as N
from .functions import text as X
from .model import envelope
from .operators import aggregates as A
from .operators import generic
from .operators import graph as G
from .operators import joins as J
from .operators import sets as S
from .operators import timeops as T
from .plans import workflow as W
from .queries import CENTS_SQL, EVENTS_SQL, _event_stream, events, query, table
from .sources import files, inputs
from .storage import shared_folder, streamed
from .streaming import metrics, streams

# Push inputs.


def _sent(spark, sf, order, at_once):
    """The 25 nations, sent to a handle at the epoch of their region, and read as a stream."""
    nations = sorted(((r.n_nationkey, r.n_name, r.n_regionkey) for r in table(spark, sf, "nation").collect()), key=order)
    handle = inputs.Handle(spark, f"{shared_folder(spark, 'handle')}/rows", "n_nationkey int, n_name string")
    for key, name, region in nations:
        if at_once:
            handle.send_at(region, key, name)
        else:
            handle.advance_to(region)
            handle.send(key, name)
    handle.close()
    return streamed(handle.stream(), "pushed")


NATIONS_SQL = "SELECT n_nationkey, n_name, n_regionkey::BIGINT AS epoch FROM nation"


@query(NATIONS_SQL)
def push_handle(spark, sf):
    return _sent(spark, sf, lambda r: (r[2], r[0]), False)


@query(NATIONS_SQL)
def unordered_input(spark, sf):
    """All epochs are open at once; rows come in the order of their names."""
    return _sent(spark, sf, lambda r: r[1], True)


@query("SELECT r_regionkey, r_name, 0::BIGINT AS epoch FROM region UNION ALL SELECT r_regionkey + 10, lower(r_name), 1 FROM region")
def send_batches(spark, sf):
    regions = [(r.r_regionkey, r.r_name) for r in table(spark, sf, "region").collect()]  # five
    handle = inputs.Handle(spark, f"{shared_folder(spark, 'handle')}/rows", "r_regionkey int, r_name string")
    handle.send_batch(regions)
    handle.advance_to(1)
    handle.send_batch([(k + 10, n.lower()) for k, n in regions])
    handle.close()
    return streamed(handle.stream(files_per_trigger=2), "pushed")


# Files in and out.

#: For each placement table: its columns from the test tables.
PLACEMENT_SQL = {
    "workers_specs": ("supplier", "s_name, s_acctbal"),
    "workers_numbers": ("nation", "n_name, n_regionkey"),
    "workers_workers_link": ("orders", "o_orderstatus, o_orderpriority, o_totalprice"),
    "logical_graph": ("part", "p_name, p_brand"),
    "throughput_normalization_ratios": ("part", "p_brand, p_type, p_retailprice"),
    "execution_profile": ("customer", "c_mktsegment, c_name, c_mktsegment, c_acctbal"),
    "message_sizes": ("lineitem", "l_returnflag, l_linestatus, l_returnflag, l_linestatus, l_extendedprice"),
    "sources_workers_link": ("supplier", "s_name, s_name, s_acctbal"),
    "input_injection_rates": ("region", "r_name, r_regionkey * 2.5"),
}


def _placement_sql() -> str:
    out = []
    for name, (source, columns) in PLACEMENT_SQL.items():
        first, *_, last = columns.split(", ")
        cents = "0" if name == "logical_graph" else f"sum(CAST(round({last} * 100) AS BIGINT))"
        out.append(f"SELECT '{name}' AS name, count(*)::BIGINT AS n, {cents}::BIGINT AS cents, min({first}) AS first FROM {source}")
    return " UNION ALL ".join(out)


@query(_placement_sql())
def placement_tables(spark, sf):
    """Every headerless table of the placement inputs, written and read back."""
    folder, out = shared_folder(spark, "placement"), []
    for name, (source, columns) in PLACEMENT_SQL.items():
        table(spark, sf, source).selectExpr(*(f"{c} AS c{i}" for i, c in enumerate(columns.split(", ")))).write.csv(f"{folder}/{name}.csv")
        rows = files.placement_table(spark, folder, name)
        last = F.lit(0) if name == "logical_graph" else F.sum(F.round(F.col(rows.columns[-1]) * 100).cast("long"))
        out.append(rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), last.cast("long").alias("cents"), F.min(rows.columns[0]).alias("first")))
    return S.concatenate(out)


@query("SELECT n_name || '_' || i AS worker, n_name AS worker_type FROM nation, (SELECT unnest(range(0, 5)) AS i) WHERE i < n_regionkey")
def numbered_workers(spark, sf):
    return files.numbered_workers(table(spark, sf, "nation").select(F.col("n_name").alias("worker_type"), F.col("n_regionkey").alias("number")))


def _own_folder(name: str) -> Path:
    """A folder on the driver, for the few lines of settings and plans that the driver itself writes and reads."""
    return Path(tempfile.mkdtemp(prefix=f"millrace-{name}-"))


@query("SELECT 'VQA' AS sink, 56.5::DOUBLE AS threshold, count(*)::BIGINT AS regions FROM region")
def json_settings(spark, sf):
    """A JSON document over several lines, and the accuracy asked for."""
    regions = [r.r_name for r in table(spark, sf, "region").collect()]  # five
    text = json.dumps({"sink": "VQA", "threshold": 56.5, "regions": regions}, indent=4)
    own, shared = _own_folder("settings") / "need.json", f"{shared_folder(spark, 'settings')}/need"
    own.write_text(text)
    sink, threshold = files.accuracy_requirement(str(own))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(shared)
    read = files.read_json(spark, shared)
    return read.select("sink", F.col("threshold").cast("double").alias("threshold"), F.size("regions").cast("long").alias("regions")).where((F.col("sink") == sink) & (F.col("threshold") == threshold))


@query("SELECT format, field, value FROM (SELECT unnest(['json', 'yaml']) AS format), (SELECT 'cost' AS field, '6.242' AS value UNION ALL SELECT 'workers', string_agg(r_name, ',' ORDER BY r_name) FROM region)")
def plan_sink(spark, sf):
    """A plan as JSON and as YAML, read back."""
    names = sorted(r.r_name for r in table(spark, sf, "region").collect())  # five
    folder, rows = _own_folder("plan"), []
    for name in ("plan.json", "plan.yaml"):
        files.write_plan({"workers": names, "cost": 6.242}, str(folder / name))
    found = json.loads((folder / "plan.json").read_text())
    rows += [("json", "cost", str(found["cost"])), ("json", "workers", ",".join(found["workers"]))]
    lines = (folder / "plan.yaml").read_text().splitlines()
    rows += [("yaml", "cost", lines[0].split(": ")[1]), ("yaml", "workers", ",".join(json.loads(line.strip()[2:]) for line in lines[2:]))]
    return spark.createDataFrame(rows, "format string, field string, value string")


@query("SELECT o_orderstatus AS pipeline, (o_orderkey % 3)::INT AS worker, count(*)::BIGINT AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1, 2")
def metrics_sink(spark, sf):
    """One JSON object a line, in a folder for each pipeline and worker."""
    path = f"{shared_folder(spark, 'metrics')}/rows"
    files.write_metrics(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("pipeline"), (F.col("o_orderkey") % 3).alias("worker"), "o_custkey"), path)
    return spark.read.schema("o_custkey long, pipeline string, worker int").json(path).groupBy("pipeline", "worker").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


@query("SELECT o_custkey || '~' || string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) || '~' || count(*) AS line FROM orders GROUP BY o_custkey")
def answers_csv(spark, sf):
    """Fields by a tilde, the elements of arrays by a bar."""
    path = f"{shared_folder(spark, 'answers')}/rows"
    grouped = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("orders"), F.count(F.lit(1)).alias("n"))
    files.write_answers_csv(grouped, path, ["orders"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT 'v' || vec_id AS name, list_sum(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)))::BIGINT AS total FROM embeddings WHERE label = 3")
def feature_store(spark, sf):
    """Features written by name and read back for the names of one label."""
    path, e = f"{shared_folder(spark, 'features')}/rows", table(spark, sf, "embeddings").withColumn("name", F.concat(F.lit("v"), "vec_id"))
    files.write_features(e.withColumnRenamed("embedding", "features"), path)
    found = files.read_features(spark, path, e.where("label = 3"))
    return found.select("name", F.aggregate("features", F.lit(0).cast("long"), lambda a, x: a + F.round(x.cast("double") * 1000).cast("long")).alias("total"))


@query("SELECT o_orderkey, format('COCO_val2014_{:012d}.jpg', o_custkey) AS name, e.label::INT AS label FROM orders JOIN embeddings e ON e.vec_id = o_custkey")
def image_by_name(spark, sf):
    """Questions find their image's features by the image's name."""
    path = f"{shared_folder(spark, 'features')}/rows"
    e = table(spark, sf, "embeddings").select(X.image_name(F.lit("val"), F.col("vec_id")).alias("name"), F.array(F.col("label").cast("float")).alias("features"))
    files.write_features(e, path)
    asked = table(spark, sf, "orders").select("o_orderkey", X.image_name(F.lit("val"), F.col("o_custkey")).alias("name"))
    return files.read_features(spark, path, asked.select("name").distinct()).join(asked, "name").select("o_orderkey", "name", F.col("features")[0].cast("int").alias("label"))


# Decoders: the bytes are made from keys, so that SQL can say what must come out.


def _hex_sql(*values: str) -> str:
    return "lower(" + " || ".join(f"lpad(to_hex(({v}) % 256), 2, '0')" for v in values) + ")"


def _byte(c):
    return F.lpad(F.lower(F.hex(F.pmod(c, F.lit(256)).cast("long"))), 2, "0")


@query("SELECT p_partkey, '1,2,3' AS shape, " + _hex_sql(*(f"p_partkey * {k}" for k in (3, 2, 1, 6, 5, 4))) + " AS pixels FROM part")
def decode_images(spark, sf):
    """Pixmaps of two pixels; the channels come back in reverse."""
    body = F.unhex(F.concat(*(_byte(F.col("p_partkey") * k) for k in range(1, 7))))
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(b"P6\n2 1\n255\n"), body).alias("content"))
    return parts.select("p_partkey", files.decode_image("content").alias("i")).select("p_partkey", F.array_join("i.shape", ",").alias("shape"), F.lower(F.hex("i.data")).alias("pixels"))


@query("SELECT p_partkey, 16000 AS sampling_rate, (p_partkey % 128) / 32768.0::DOUBLE AS first, (p_partkey * 3 % 128) * 256 / 32768.0::DOUBLE AS second FROM part")
def decode_speech(spark, sf):
    """Waves of two samples."""
    number = lambda n, size: n.to_bytes(size, "little")
    head = b"RIFF" + number(40, 4) + b"WAVEfmt " + number(16, 4) + number(1, 2) + number(1, 2) + number(16000, 4) + number(32000, 4) + number(2, 2) + number(16, 2) + b"data" + number(4, 4)
    low, high = F.pmod("p_partkey", F.lit(128)), F.pmod(F.col("p_partkey") * 3, F.lit(128))
    parts = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(head), F.unhex(F.concat(_byte(low), F.lit("0000"), _byte(high)))).alias("content"))
    wave = parts.select("p_partkey", files.decode_speech("content").alias("s"))
    return wave.select("p_partkey", "s.sampling_rate", F.col("s.waveform")[0].cast("double").alias("first"), F.col("s.waveform")[1].cast("double").alias("second"))


@query("SELECT vec_id, " + ", ".join(f"list_sum(list_transform(embedding[{16 * k + 1}:{16 * k + 16}], lambda x: CAST(round(x::DOUBLE * 1024) AS BIGINT)))::DOUBLE / 16 AS c{k}" for k in range(4)) + " FROM embeddings")
def spatial_mean_pool(spark, sf):
    """Embeddings, in whole 1024ths, as four channels of 4 x 4."""
    raw = F.transform("embedding", lambda x: F.round(x.cast("double") * 1024).cast("float"))
    pooled = table(spark, sf, "embeddings").select("vec_id", N.mean_pool(raw, F.array(F.lit(4), F.lit(4), F.lit(4))).alias("p"))
    return pooled.select("vec_id", *((F.col("p")[k].cast("double") + 0.0).alias(f"c{k}") for k in range(4)))


@query("SELECT p_partkey, " + _hex_sql(*(f"p_partkey + {k}" for k in (2, 1, 0, 5, 4, 3))) + " AS data FROM part")
def channel_swap(spark, sf):
    data = F.unhex(F.concat(*(_byte(F.col("p_partkey") + k) for k in range(6))))
    return table(spark, sf, "part").select("p_partkey", F.lower(F.hex(N.swap_channels(data, F.array(F.lit(1), F.lit(2), F.lit(3))))).alias("data"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 16), lambda i: CASE WHEN i < 3 THEN (p_partkey * (i + 1)) % 256 ELSE 0 END), ',') AS feature FROM part")
def model_variant(spark, sf):
    """A registered variant applied in batches; the stand-in sums every 16th pixel."""
    data = F.unhex(F.concat(*(_byte(F.col("p_partkey") * k) for k in (1, 2, 3))))
    found = W.model_map(table(spark, sf, "part").select("p_partkey", data.alias("data")), "image", "resnet18", "data", "feature", "array<double>", batch=7)
    return found.select("p_partkey", F.array_join(F.transform("feature", lambda x: x.cast("long")), ",").alias("feature"))


# Functions.

PRIORITY_SQL = "SELECT o_custkey, o_orderpriority AS answer, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2"


def _answers(spark, sf):
    counted = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("answer")).agg(F.count(F.lit(1)).alias("count"))
    return counted.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("answer", "count"))).alias("answers"))


@query(f"WITH p AS ({PRIORITY_SQL}) SELECT o_custkey, coalesce(string_agg(CASE WHEN answer LIKE '1%' THEN answer || ':0:' || n WHEN answer LIKE '3%' THEN answer || ':1:' || n END, ',' ORDER BY answer), '') AS known FROM p GROUP BY 1")
def known_answers(spark, sf):
    """Of each customer's answers, those in the vocabulary, with their ids."""
    names = sorted(r[0] for r in table(spark, sf, "orders").select("o_orderpriority").distinct().collect())  # five
    ids = F.create_map(*(x for n, name in enumerate(n for n in names if n[0] in "13") for x in (F.lit(name), F.lit(n))))
    kept = _answers(spark, sf).select("o_custkey", X.known_answers(F.col("answers"), ids).alias("k"))
    return kept.select("o_custkey", F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["answer"], x["aid"].cast("string"), x["count"].cast("string"))), ",").alias("known"))


@query(f"WITH p AS ({PRIORITY_SQL}) SELECT o_custkey, '0,0,0,0,0,0' AS none, " + ", ".join(f"round(coalesce(sum(n) FILTER (answer[1] = '{k}'), 0) / sum(n), 9) AS h{k}" for k in range(1, 6)) + " FROM p GROUP BY 1")
def n_hot_answers(spark, sf):
    """The shares of each answer, by the number that its name begins with; of no answers, all are 0."""
    hot = X.n_hot(F.transform("answers", lambda x: F.substring(x["answer"], 1, 1).cast("int")), F.transform("answers", lambda x: x["count"]), 6)
    none = X.n_hot(F.array().cast("array<int>"), F.array().cast("array<bigint>"), 6)
    found = _answers(spark, sf).select("o_custkey", hot.alias("h"), F.array_join(F.transform(none, lambda x: x.cast("long")), ",").alias("none"))
    return found.select("o_custkey", "none", *(F.round(F.col("h")[k], 9).alias(f"h{k}") for k in range(1, 6)))


@query("SELECT o_custkey, max(o_orderkey)::BIGINT AS drawn FROM orders GROUP BY 1")
def sampled_item(spark, sf):
    """Only the largest key has a positive count, so it is what is drawn."""
    keys = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    counts = F.transform("keys", lambda k: F.when(k == F.array_max("keys"), 3).otherwise(0))
    return keys.select("o_custkey", X.sampled(F.col("keys"), counts, 7).alias("drawn"))


@query("SELECT n_nationkey, 'a=' || n_regionkey || ',b=' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ',c=x' ELSE '' END AS merged FROM nation")
def merged_maps(spark, sf):
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("n_name"))
    region = F.col("n_regionkey").cast("string")
    over = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), region, F.lit("c"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), region))
    entries = F.transform(F.sort_array(F.map_entries(X.merged(base, over))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(entries, ",").alias("merged"))


@query("""SELECT r_name, '{"a": {"x": 1, "y": ' || r_regionkey || '}, "b": 2}' AS settings FROM region""")
def deep_settings(spark, sf):
    rows = [(r.r_name, json.dumps(X.deep_update({"a": {"x": 1, "y": 0}, "b": {"z": 1}}, {"a": {"y": r.r_regionkey}, "b": 2}))) for r in table(spark, sf, "region").collect()]  # five
    return spark.createDataFrame(rows, "r_name string, settings string")


# Telemetry.


@query("SELECT o_orderkey, l_linenumber, least(o_orderkey, l_partkey)::BIGINT AS start_ns, greatest(o_custkey, l_suppkey)::BIGINT AS latency_ns FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_telemetry(spark, sf):
    """A joined row has the earlier start and the longer latency of its sides."""
    left = envelope(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), latency_ns=F.col("o_custkey")).alias("l")
    right = envelope(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.col("l_partkey"), latency_ns=F.col("l_suppkey")).alias("r")
    joined = left.join(right, F.col("l.o_orderkey") == F.col("r.l_orderkey"))
    return joined.select("o_orderkey", "l_linenumber", *(c.alias(n) for n, c in J.joined_telemetry().items()))


@query("SELECT user_id, chunk, min(event_id)::BIGINT AS start_ns, (max(event_id * 3) - min(event_id))::BIGINT AS latency_ns FROM (SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4)::BIGINT AS chunk FROM events) GROUP BY 1, 2 HAVING count(*) = 4")
def aggregate_telemetry(spark, sf):
    """A group of four rows has the earliest start, and the time from it to when the group is whole."""
    rows = envelope(events(spark, sf).select("user_id", "event_id"), F.col("event_id"))
    return A.aggregate(rows, ["user_id"], 4, "event_id", **A.aggregated_telemetry(F.col("event_id") * 3))


# Sets, times and scopes.


@query("SELECT c_custkey AS id, 'c' AS kind FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def concat_streams(spark, sf):
    return S.concat(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("kind")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("s").alias("kind")))


@query("SELECT event_id, (event_id // 10)::BIGINT AS epoch FROM events")
def forward_capability(spark, sf):
    """Epochs that never fall pass; an earlier one would be an error."""
    return T.forward_only(table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 10).cast("long").alias("epoch")), "event_id")


@query("SELECT o_orderkey, (o_custkey % 5)::BIGINT AS epoch, (o_orderkey % 3 + 1)::BIGINT AS inner_time FROM orders WHERE o_custkey % 5 <= 2 AND o_orderkey % 3 + 1 <= 2")
def nested_scope(spark, sf):
    """Rows enter a scope at an inner time, go round it once, and are held against the time (2, 2)."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("epoch"))
    inside = G.loop_epochs(G.enter(rows, F.col("o_orderkey") % 3, inner="inner_time"), epoch="inner_time")
    return inside.where(G.not_after(F.col("epoch"), F.col("inner_time"), F.lit(2), F.lit(2)))


@query("SELECT o_orderkey, (o_custkey % 5)::BIGINT AS epoch FROM orders")
def leave_scope(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("epoch"))
    return G.leave(G.loop_epochs(G.enter(rows), 3, epoch="inner"))


@query("SELECT * FROM (VALUES ('2000-01-01T00:00:00.000Z', false), ('2999-01-01T00:00:00.000Z', true)) t(time, less)")
def probe_less_than(spark, sf):
    """A probe of a stream that has read all: nothing before the watermark can come, what lies after it can."""
    found = streams.timestamp_aggregate_stream(_event_stream(spark, sf), "ts", "1 day", "0 seconds", ["event_type"], n=F.count(F.lit(1)))
    folder = shared_folder(spark, "probe")
    running = found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").start()
    try:
        streams.step_until_done(running)
        rows = [(t, streams.less_than(running, t)) for t in ("2000-01-01T00:00:00.000Z", "2999-01-01T00:00:00.000Z")]
    finally:
        running.stop()
    return spark.createDataFrame(rows, "time string, less boolean")


@query("SELECT event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1)::BIGINT AS sequence FROM events WHERE event_type = 'click'")
def sequenced_rows(spark, sf):
    """What several workers say at one time, in one order: by worker and place."""
    rows = table(spark, sf, "events").where("event_type = 'click'").select("event_id", "user_id", F.lit(1).alias("time"))
    return generic.sequenced(rows, "time", "user_id", "event_id").select("event_id", F.col("sequence").cast("long").alias("sequence"))


@query("SELECT n_nationkey, (n_nationkey * 2 + 1)::INT AS value FROM nation")
def barrier_phases(spark, sf):
    """Two phases, the second once all workers have ended the first."""
    rows = table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").alias("value")).repartition(2)
    return generic.in_step(rows, [lambda f: f.assign(value=f["value"] * 2), lambda f: f.assign(value=f["value"] + 1)], "n_nationkey int, value int")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n, (SELECT count(*) FROM lineitem)::BIGINT AS n_lines FROM orders GROUP BY 1")
def sink_counts(spark, sf):
    """A sink that counts on the executors what it is given."""
    seen = spark.sparkContext.accumulator(0)
    generic.sink(table(spark, sf, "lineitem").select("l_orderkey"), lambda f: seen.add(len(f)))
    return A.count(table(spark, sf, "orders"), epoch="o_orderstatus").withColumn("n_lines", F.lit(seen.value).cast("long"))


@query("SELECT 0 AS output, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 1, count(*), sum(o_orderkey) FROM orders WHERE o_orderkey % 7 = 0")
def several_outputs(spark, sf):
    """A custom operator with two outputs; a row may go to both."""
    run = lambda f: [(0, f[f["o_totalprice"] > 100000]), (1, f[f["o_orderkey"] % 7 == 0])]
    outputs = generic.tagged(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), run, "o_orderkey long, o_totalprice double", 2)
    return S.concatenate([o.agg(F.lit(k).alias("output"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")) for k, o in enumerate(outputs)])


@query("SELECT n_regionkey::BIGINT AS key, count(*)::BIGINT AS total, 'nation' AS side FROM nation GROUP BY 1 UNION ALL SELECT r_regionkey, length(r_name), 'region' FROM region")
def several_inputs(spark, sf):
    """A custom operator with two inputs and two outputs at once."""

    def run(key, parts):
        nations, regions = parts
        if len(nations):
            yield 0, pd.DataFrame({"key": [key[0]], "total": [len(nations)], "side": ["nation"]})
        if len(regions):
            yield 1, pd.DataFrame({"key": [key[0]], "total": [len(regions["name"].iloc[0])], "side": ["region"]})

    left = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    right = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    return S.concatenate(generic.combined([left, right], ["key"], run, "key long, total long, side string", 2))


@query("SELECT epoch, sum(cents)::BIGINT AS total FROM (SELECT " + CENTS_SQL + " AS cents, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch FROM events) GROUP BY 1")
def notified_epochs(spark, sf):
    """An operator that is called once an epoch is complete."""
    rows = events(spark, sf).select("epoch", "cents")
    return generic.unary_notify(rows, "epoch", lambda f: pd.DataFrame({"epoch": [f["epoch"].iloc[0]], "total": [f["cents"].sum()]}), "epoch long, total long")


@query(EVENTS_SQL + "SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS metered FROM e")
def stream_metrics(spark, sf):
    """What a listener gathers of a stream agrees with what the stream wrote."""
    found = metrics.attach(spark)
    try:
        written = streamed(_event_stream(spark, sf).select("event_id"), "metered").count()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(found)
    return found.frame(spark).agg(F.sum("rows").alias("metered")).withColumn("n", F.lit(written).cast("long"))


@query("SELECT o_orderkey, run::INT AS run, o_orderkey * 2 + 1 AS value FROM orders, (SELECT unnest(range(3)) AS run)")
def replicated_baseline(spark, sf):
    """The comparison baseline: both stages in one pass, three times."""
    stages = [lambda f: f.withColumn("value", F.col("o_orderkey") * 2), lambda f: f.withColumn("value", F.col("value") + 1)]
    runs = W.replicated_run(table(spark, sf, "orders").select("o_orderkey"), stages, 3)
    return S.concatenate([f.withColumn("run", F.lit(n)) for n, f in enumerate(runs)])


@query("SELECT o_orderkey, o_orderkey * 2 + 1 AS value FROM orders")
def single_thread_baseline(spark, sf):
    """The same stages in one task; both kinds of run are measured."""
    stages = [lambda f: f.withColumn("value", F.col("o_orderkey") * 2), lambda f: f.withColumn("value", F.col("value") + 1)]
    rows = table(spark, sf, "orders").select("o_orderkey")
    runs = W.replicated_run(rows, stages, 1, single=True)
    if any(seconds <= 0 or rate <= 0 for seconds, rate in W.measured(runs, rows.count())):
        raise ValueError("a run took no time")
    return runs[0]


@query("SELECT n_regionkey * 10 AS day, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def late_rows(spark, sf):
    """Rows that come once the watermark has passed their epoch are dropped: each region's rows come ten days after the one before, then the first region's come again."""
    handle = inputs.Handle(spark, f"{shared_folder(spark, 'late')}/rows", "name string, day int")
    nations = sorted(((r.n_regionkey, r.n_name) for r in table(spark, sf, "nation").collect()))  # 25
    for region, name in nations:
        handle.advance_to(region)
        handle.send(name, region * 10)
    for n, (name, day) in enumerate([*((name, 0) for region, name in nations if region == 0), ("end", 100), ("end", 200)]):
        handle.advance_to(10 + n)
        handle.send(name, day)
    handle.close()
    timed = handle.stream().withColumn("ts", (F.lit(1704067200) + F.col("day") * 86400).cast("timestamp"))
    found = streams.timestamp_aggregate_stream(timed, "ts", "1 day", "0 seconds", ["day"], n=F.count(F.lit(1)))
    return streamed(found, "late").where("day < 100").select("day", "n")
