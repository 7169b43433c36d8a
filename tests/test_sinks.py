"""Forms of results."""

import json

from pyspark.sql import functions as F

from wayfold.operators import vectors
from wayfold.streaming import sinks


def test_forms(spark):
    df = spark.createDataFrame([(1, 'a"b\n', 2.5)], "id int, name string, v double")
    m = sinks.messages(df, "id").collect()[0]
    assert m.key == "1" and json.loads(m.value) == {"id": 1, "name": 'a"b\n', "v": 2.5}
    assert sinks.server_sent(df, F.lit("step"), [F.col("id")]).collect()[0].text.startswith('event: step\ndata: {"id":1')
    assert sinks.exposition(df, "ctr", ["name"], "v").collect()[0].line == 'ctr{name="a\\"b\\n"} 2.5'


def test_histogram(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("x", 9.0), ("x", None)], "k string, v double")
    assert [(r.le, r.n) for r in sinks.cumulative_buckets(df, "v", [2, 5], ["k"]).collect()] == [("2", 1), ("5", 2), ("+Inf", 3)]


def test_backfill_and_versions(spark):
    hits = spark.createDataFrame([("a", 1, "old"), ("b", 2, "kept")], "id string, rank int, content string")
    rel = spark.createDataFrame([("a", "new"), ("b", ""), ("c", "x")], "id string, content string")
    assert {(r.id, r.rank, r.content) for r in vectors.backfill(hits, rel, "id", "content").collect()} == {("a", 1, "new"), ("b", 2, "kept")}
    chunks = spark.createDataFrame([("u", 1, "x"), ("u", 2, "y"), ("u", 2, "z"), ("v", 1, "w")], "k string, ver int, t string")
    assert {r.t for r in vectors.latest_version(chunks, ["k"], "ver").collect()} == {"y", "z", "w"}
