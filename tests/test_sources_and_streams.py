import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregates as A
from millrace.plans import workflow as W
from millrace.sources import event_log, files, inputs
from millrace.streaming import stateful, streams


def test_closure_input(spark):
    calls = iter([(("a",), None), (("b",), 3), (None, 5), (("c",), None), (None, None)])
    assert [(r.v, r.epoch) for r in inputs.new_input(spark, lambda: next(calls), "v string").collect()] == [("a", 0), ("b", 0), ("c", 5)]
    back = iter([(("a",), 3), (("b",), 1)])
    with pytest.raises(ValueError):
        inputs.new_input(spark, lambda: next(back), "v string")


def test_distributed_epochs(spark):
    df = spark.range(8).withColumnRenamed("id", "x")
    got = inputs.input_from_source_distributed(df, F.col("x") + 1, "x", 3).orderBy("x").collect()
    assert [r.epoch for r in got] == [0, 0, 0, 1, 2, 3, 4, 5]


def test_push_handle_streams_closed_epochs(spark, tmp_path):
    h = inputs.Handle(spark, str(tmp_path / "log"), "v int")
    h.send(1)
    h.send_at(2, 7)
    h.advance_to(1)
    h.send_batch([(2,), (3,)])
    with pytest.raises(ValueError):
        h.send_at(0, 9)
    query = event_log.capture_into(h.stream(), "pushed")
    query.awaitTermination()
    assert [r.v for r in spark.table("pushed").collect()] == [1]
    h.close()
    query = event_log.capture_into(h.stream(), "pushed_all")
    query.awaitTermination()
    assert sorted((r.epoch, r.v) for r in spark.table("pushed_all").collect()) == [(0, 1), (1, 2), (1, 3), (2, 7)]


def test_pull_source(spark, tmp_path):
    query = inputs.iterator_source(spark, 25, 10).writeStream.format("memory").queryName("pulled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        for _ in range(50):
            if spark.table("pulled").count() == 25:
                break
            query.processAllAvailable()
        assert sorted(r.value for r in spark.table("pulled").collect()) == list(range(25))
    finally:
        query.stop()


def test_capture_replay_extract(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (0, 9), (1, 2)], "epoch long, v int")
    event_log.capture(df, str(tmp_path / "a"))
    streamed = event_log.capture_stream(inputs.file_source(spark, str(tmp_path / "a"), df.schema), str(tmp_path / "b"), str(tmp_path / "c"))
    streamed.awaitTermination()
    assert [(r.epoch, r.rows) for r in event_log.extract(event_log.replay(spark, str(tmp_path / "a"), str(tmp_path / "b")), F.col("v")).collect()] == [(0, [9, 9]), (1, [2, 2, 5, 5])]


def write_parts(spark, rows, schema, path, parts=4):
    rows = [r for k in range(parts) for r in rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]]
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)


def memory(df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_count_bounded_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, rng.randrange(100)) for i in range(300)]
    schema, path = "k int, o long, v long", str(tmp_path / "in")
    write_parts(spark, rows, schema, path)
    stream = stateful.aggregate_stream(inputs.file_source(spark, path, spark.read.parquet(path).schema, 4), ["k"], 5, ["o"], lambda key, f: {"k": key[0], "total": int(f["v"].sum())}, "k int, total long")
    want = A.aggregate(spark.createDataFrame(rows, schema), ["k"], 5, "o", total=F.sum("v")).collect()
    assert sorted((r.k, r.total) for r in memory(stream, "bounded", tmp_path)) == sorted((r.k, r.total) for r in want)


def test_fold_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.randrange(1, 30)) for i in range(200)]
    schema, path = "k int, o long, v long", str(tmp_path / "in")
    write_parts(spark, rows, schema, path)

    def step(state, row):
        total = state[0] + row["v"]
        return (None, [{"k": int(row["k"]), "total": int(total)}]) if total >= 50 else ((int(total),), [])

    stream = stateful.fold_stream(inputs.file_source(spark, path, spark.read.parquet(path).schema, 4), ["k"], ["o"], "s long", lambda: (0,), step, "k int, total long")
    batch = A.incremental_aggregate(spark.createDataFrame(rows, schema), ["k"], ["o"], lambda: 0, lambda s, r: (s + r["v"], s + r["v"] >= 50), lambda key, s: {"k": key[0], "total": s}, "k int, total long")
    assert sorted(map(tuple, memory(stream, "folded", tmp_path))) == sorted(map(tuple, batch.collect()))


def test_epoch_stream_closes_epochs(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts, id % 2 AS k FROM range(72)")
    df.orderBy("ts").coalesce(1).write.parquet(path)
    got = memory(streams.timestamp_aggregate_stream(inputs.file_source(spark, path, df.schema), "ts", "1 day", "0 seconds", ["k"], n=F.count(F.lit(1))), "closed", tmp_path)
    assert sorted((str(r.epoch)[:10], r.k, r.n) for r in got) == [(f"2024-01-0{d}", k, 12) for d in (1, 2) for k in (0, 1)]


def test_joins_and_distinct_in_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id / 2 as int)) AS ts, id % 2 AS k, id AS v FROM range(20)")
    df.write.parquet(path)
    source = lambda: inputs.file_source(spark, path, df.schema)
    joined = streams.timestamp_join_stream(source(), source().withColumnRenamed("v", "w"), "ts", "1 hour", ["k"])
    assert sorted((r.v, r.w) for r in memory(joined, "joined", tmp_path)) == [(i, i) for i in range(20)]
    assert len(memory(streams.distinct_stream(source(), "ts", "1 hour"), "distinct", tmp_path)) == 10
    seen = []
    query = streams.for_each_epoch(source(), lambda rows, n: seen.append(rows.count()), str(tmp_path / "each"))
    query.awaitTermination()
    assert sum(seen) == 20 and streams.completed(query)["rows"] == 20 and streams.less_than(query, "2030") is True


def test_media(spark, tmp_path):
    import io
    import wave

    (tmp_path / "a.ppm").write_bytes(b"P6\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(np.array([[16384, 0], [-16384, -16384]], "<i2").tobytes())
    (tmp_path / "c.wav").write_bytes(raw.getvalue())
    image = files.load_binary(spark, str(tmp_path), "*.ppm").select(files.decode_image("content").alias("i")).first().i
    assert image.shape == [1, 2, 3] and bytes(image.data) == bytes([3, 2, 1, 6, 5, 4])
    speech = files.load_binary(spark, str(tmp_path), "*.wav").select(files.decode_speech("content").alias("s")).first().s
    assert speech.sampling_rate == 16000 and speech.waveform == [0.25, -0.5]


def test_stores_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, features array<float>")
    files.write_features(df, str(tmp_path / "f"))
    assert [r.name for r in files.read_features(spark, str(tmp_path / "f"), df.where("name = 'b'")).collect()] == ["b"]
    files.write_answers_csv(spark.createDataFrame([("q", ["x", "y"])], "q string, a array<string>"), str(tmp_path / "csv"), ["a"])
    assert spark.read.text(str(tmp_path / "csv")).first()[0] == "q~x|y"
    files.write_metrics(spark.createDataFrame([("p", 0, 1.5)], "pipeline string, worker int, v double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().v == 1.5
    images, speech = files.read_questions(spark.createDataFrame([(9, 4), (3, 5)], "question_id long, image_id long"), 1, "val")
    assert images.first().image_path == "COCO_val2014_000000000005.jpg" and speech.first().speech_path == "000000000003.flac"


def test_flow_names_edges_and_stages(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    flow = W.FlowBuilder()
    s = flow.input("In", a)
    left, right = s.map("Map", k=F.col("k"), v=F.upper("v")), s.filter("Map", F.col("k") > 1)
    out = left.join("Join", right.map("Rename", k=F.col("k"), w=F.col("v")), "k")
    assert [tuple(r) for r in out.frame.collect()] == [(2, "Y", "y")]
    assert list(flow.nodes) == ["In", "Map", "Map_1", "Rename", "Join"] and ("In", "Map_1") in flow.edges
    flow.pipelines = {"one": W.Pipeline(["In", "Map", "Map_1"], options={"batch_size": 3}), "two": W.Pipeline(["Rename", "Join"])}
    assert flow.stages_frame(spark).count() == 5 and flow.option("Map", "batch_size") == 3
    flow.pipelines["two"].operators.pop()
    with pytest.raises(ValueError):
        flow.stages_frame(spark)


def test_model_backends(spark):
    df = spark.createDataFrame([(1, bytearray(range(64))), (2, None)], "uid long, data binary")
    got = W.model_map(df, "image", "resnet18", "data", "feature", "array<float>").collect()
    assert len(got[0].feature) == 16 and got[0].feature[0] == 0 + 16 + 32 + 48
    waves = spark.createDataFrame([(1, [0.5, 0.25]), (2, None)], "uid long, wave array<float>")
    texts = [r.text for r in W.model_map(waves, "speech", "wav2vec2-base-960h", "wave", "text", "string").collect()]
    assert len(texts[0].split()) == 3 and texts[1] is None
    runs = W.replicated_run(df, [lambda d: W.model_map(d, "image", "resnet50", "data", "f", "array<float>")], times=2)
    assert len(runs) == 2 and isinstance(runs[0].toPandas(), pd.DataFrame)


def test_metrics_listener(spark, tmp_path):
    import time

    from millrace.streaming import metrics

    seen = metrics.attach(spark)
    path = str(tmp_path / "in")
    spark.range(12).write.parquet(path)
    memory(inputs.file_source(spark, path, "id long"), "metered", tmp_path)
    for _ in range(50):
        if sum(r[2] for r in seen.records) >= 12:
            break
        time.sleep(0.1)
    spark.streams.removeListener(seen)
    assert sum(r.rows for r in seen.frame(spark).collect()) == 12 and '"query": "metered"' in metrics.to_json(seen)


def test_runs_are_measured(spark):
    from millrace.plans import workflow as W

    rows = spark.range(1000)
    runs = W.replicated_run(rows, [lambda f: f.selectExpr("id + 1 AS id")], 2) + W.replicated_run(rows, [lambda f: f.selectExpr("id + 1 AS id")], 1, single=True)
    found = W.measured(runs, 1000)
    assert len(found) == 3 and all(abs(rate * seconds - 1000) < 1e-6 for seconds, rate in found)
    assert runs[2].rdd.getNumPartitions() == 1 and runs[2].agg({"id": "sum"}).first()[0] == 500500
