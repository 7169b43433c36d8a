"""Streams equal their batch forms; replays and retries keep state."""

import json

from pyspark.sql import functions as F

from wayfold.streaming import changes, windows


def test_messages(spark):
    good = {"event_id": "e", "article_id": "a", "op": "delete"}
    rows = [json.dumps(good), json.dumps(good | {"event_scope": "x", "version_ms": 3}), "{broken", json.dumps(good | {"article_id": " "}), json.dumps({"article_id": "a"}), json.dumps(good | {"op": "noop"}), None, ""]
    got = changes.parse_messages(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert [r.valid for r in got] == [True, True, False, False, False, False, False, False]
    assert got[0].event_scope == "article_sync" and got[1].event_scope == "x"


def test_change_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    src.mkdir()
    log = [("a", "upsert", 1, "t1"), ("b", "upsert", 1, "t2"), ("a", "upsert", 3, "t3"), ("a", "upsert", 2, "late"), ("b", "delete", 2, ""), ("c", "bad", 1, "")]
    for i, (k, op, v, t) in enumerate(log):
        (src / f"{i}.txt").write_text(json.dumps({"event_id": f"e{i}", "article_id": k, "op": op, "version_ms": v, "title": t}))
    stream = changes.parse_messages(spark.readStream.format("text").option("maxFilesPerTrigger", 2).load(str(src)))
    q = stream.writeStream.foreachBatch(changes.merge_into(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.article_id, r.title) for r in changes.current(spark, out).collect()] == [("a", "t3")]


def test_tumbling_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    agg = windows.tumbling(stream, "ts", ["event_type"], 3600, "value", "60 days")
    q = agg.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cut = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert cut(spark.table("tumbled")) == cut(windows.tumbling(e, "ts", ["event_type"], 3600, "value"))


def test_retries_end_as_dead_letters(spark, tmp_path):
    src = tmp_path / "f"
    src.mkdir()
    for i in range(6):
        (src / f"{i}.json").write_text(json.dumps({"message_id": "m", "attempt": 0, "failed_at": f"2025-01-01T00:00:0{i}Z"}))
    stream = spark.readStream.schema("message_id string, attempt int, failed_at timestamp").option("maxFilesPerTrigger", 1).json(str(src))
    q = changes.retry_states(stream).writeStream.outputMode("update").format("memory").queryName("retried").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.attempt, r.verdict) for r in spark.table("retried").collect()) == [(1, "retry"), (1, "retry"), (2, "retry"), (3, "retry"), (4, "retry"), (5, "dead")]


def test_job_states():
    j = windows.JobCoalescer()
    assert [j.enqueue(["a"]), j.enqueue(["a"]), j.enqueue(["a"])] == ["queued", "deduped", "deduped"]
    assert j.start() == ["a"] and j.enqueue(["a"]) == "deduped" and not j.dirty
    j.enqueue(["b", "c", "d"])
    assert j.dirty and j.finish() == "queued" and j.start() == ["b", "c", "d"] and j.finish() == "idle"
    assert windows.JobCoalescer().enqueue(["x"], room=False) == "dropped_queue_full"


def test_retries_come_back_when_due(spark, tmp_path):
    import datetime
    import time

    src = tmp_path / "r"
    src.mkdir()
    at = lambda s: (datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    rows = [{"message_id": "a", "payload": "p1", "attempt": 1, "due": at(1)}, {"message_id": "a", "payload": "p2", "attempt": 2, "due": at(2)}, {"message_id": "b", "payload": "q", "attempt": 1, "due": at(3600)}]
    (src / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("message_id string, payload string, attempt int, due timestamp").json(str(src))
    q = changes.redeliver(stream).writeStream.outputMode("append").format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("again").count():
            time.sleep(1)
        assert [(r.message_id, r.payload, r.attempt) for r in spark.table("again").collect()] == [("a", "p2", 2)]
    finally:
        q.stop()
