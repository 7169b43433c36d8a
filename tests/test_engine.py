"""The entry points on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.engine import Engine, default_tools, format_window, parse_window
from wayfold.functions import strings as fx
from wayfold.operators import merge


@pytest.fixture(scope="module")
def engine(spark, data):
    t = {n: spark.read.parquet(f"{data}/{n}.parquet") for n in ("user_pool_items", "user_rec_history")}
    docs = spark.createDataFrame([("a1", "大阪美食攻略", "## 吃\n章鱼烧很好吃", "大阪,美食"), ("a2", "京都古寺", "## 看\n清水寺的红叶", "京都"), ("a3", "大阪夜景", "## 逛\n道顿堀的夜市", "大阪")], "article_id string, title string, markdown string, tags string").withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))
    e = Engine(spark, t)
    return Engine(spark, e.ingest(docs))


def test_search(engine, spark):
    q = spark.createDataFrame([(1, "大阪 美食 章鱼烧"), (2, "京都清水寺"), (3, "")], "query_id bigint, query string")
    top = {r.query_id: r.article_id for r in engine.content_search(q).where("rank = 1").collect()}
    assert top[1] == "a1" and top[2] == "a2"
    assert [r.article_id for r in engine.title_search("大阪").collect()] == ["a3", "a1"]
    assert engine.keyword_search("夜市").collect()[0].article_id == "a3" and engine.keyword_search(" ").count() == 0


def test_ingest_again_changes_nothing(engine, spark):
    docs = spark.createDataFrame([("a1", "大阪美食攻略", "## 吃\n章鱼烧很好吃", "大阪,美食")], "article_id string, title string, markdown string, tags string").withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))
    again = engine.ingest(docs)
    rows = lambda t: sorted((r.chunk_id, r.content) for r in t["article_chunks"].collect())
    assert rows(again) == rows(engine.tables)
    gone = engine.delete(docs.select("article_id"))
    assert gone["articles"].count() == 2 and gone["recall_fine"].where("article_id = 'a1'").count() == 0


def test_recommend(engine, spark):
    users = spark.createDataFrame([("u900000001",), ("nobody",)], "user_id string")
    got = engine.recommend(users, 5).collect()
    assert {r.source for r in got if r.user_id == "nobody"} == {"fallback"} and len([r for r in got if r.user_id == "nobody"]) == 3
    own = [r for r in got if r.user_id == "u900000001"]
    assert own and sorted(r.rank for r in own) == list(range(1, len(own) + 1))
    bad = {r.article_id for r in engine.tables["user_rec_history"].where("user_id = 'u900000001' and preference < 1").collect()}
    assert not bad & {r.article_id for r in own}


def test_tools(engine):
    t = default_tools(engine)
    assert t.names() == sorted(t.names()) and {s["name"] for s in t.schema()} == set(t.names())
    assert t.invoke("pool_get_size", '{"user_id": "nobody", "pool_type": "x", "period_bucket": ""}').collect()[0].n == 0
    with pytest.raises(KeyError):
        t.invoke("pool_get_size", '{"oops": 1}')
    assert [c[1] for c in t.calls] == ["ok", "error"]
    with pytest.raises(ValueError):
        t.register("title_search", None, "", {})


def test_evaluation_window(engine, spark):
    ev = spark.createDataFrame([(1, "r1", "u", "home", "a1", 1, "impression", "2025-01-02"), (2, "r1", "u", "home", "a1", 1, "click", "2025-01-02"), (3, "r0", "u", "home", "a2", 1, "click", "2024-01-01")], "id long, rec_request_id string, user_id string, surface string, article_id string, rank int, event_type string, t string").withColumn("event_ts", F.col("t").cast("timestamp"))
    rq = spark.createDataFrame([("r1", "home", "2025-01-02")], "rec_request_id string, surface string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    e = Engine(spark, engine.tables | {"reco_event_logs": ev, "reco_request_logs": rq})
    m = {r.metric: r.value for r in e.evaluation_summary("home", "7d", "2025-01-03 00:00:00").collect()}
    assert m["ctr"] == m["hit_rate"] == m["precision"] == m["ranking_quality"] == 1.0 and abs(m["coverage"] - 1 / 3) < 1e-6
    assert parse_window(" 7D ") == 604_800 and parse_window("x") == 86_400 and format_window(604_800) == "7d" and format_window(86_400) == "24h"


def test_runs(engine, spark):
    steps = spark.createDataFrame([("r", 1, "问", False), ("r", 2, "一", True), ("r", 3, "二", True)], "run_id string, seq int, text string, delta boolean")
    log = spark.createDataFrame([("r", "point", "p", 1, "a"), ("r", "point", "p", 2, "b")], "run_id string, kind string, item string, seq int, payload string")
    runs = spark.createDataFrame([(f"r{i}", i) for i in range(5)], "run_id string, updated_at int")
    e = Engine(spark, {"steps": steps, "run_events": log, "runs": runs})
    assert [r.message for r in e.run_messages("r").orderBy("first_seq").collect()] == ["问", "一二"]
    assert [r.payload for r in e.run_snapshot("r").collect()] == ["b"]
    assert [r.run_id for r in e.runs("4", 2).orderBy("pos").collect()] == ["r3", "r2"]


def test_small_merges(spark):
    nodes = spark.createDataFrame([(1, {"a": "x", "b": "y"}), (2, None)], "id int, props map<string,string>")
    got = {r.id: r.props for r in merge.patch(nodes, spark.createDataFrame([(1, {"b": "z", "c": "w"})], nodes.schema), "id").collect()}
    assert got == {1: {"a": "x", "b": "z", "c": "w"}, 2: None}
    runs = merge.append_steps(spark.createDataFrame([("r", "new"), ("s", "new")], "run string, status string"), spark.createDataFrame([("r", 1, "a"), ("r", 2, "b")], "run string, seq int, status string"), "run", "seq", "status")
    assert {(r.run, r.status, r.n_steps) for r in runs.collect()} == {("r", "b", 2), ("s", "new", 0)}
    items = spark.createDataFrame([("d", "p", 0), ("d", "q", 2), ("d", "r", 1)], "day string, poi string, o int")
    found = merge.first_valid_lookup(items, spark.createDataFrame([("p", 0, 1.0), ("q", 0, 0.0), ("q", 1, 5.0)], "poi string, pos int, lng double"), "day", "poi", "o", F.col("lng") != 0)
    assert {(r.poi, r.visit_order) for r in found.collect()} == {("q", 1), ("p", 2)}
    specs = spark.createDataFrame([("d", 1), ("d", 2)], "day string, spec int")
    offers = spark.createDataFrame([("d", 1, "x", 9.0), ("d", 2, "x", 9.0), ("d", 2, "y", 1.0)], "day string, spec int, item string, score double")
    assert {(r.spec, r.item) for r in merge.greedy_choice(specs, offers, "day", "spec", "item", "score").collect()} == {(1, "x"), (2, "y")}


def test_places(spark):
    r = spark.range(1).select(fx.polyline_points(F.lit('[{"polyline":"1,2;1,2;3,4"},{"polyline":"3,4;5,6"}]')).alias("p"), fx.static_map_url("http://m", "k", F.lit(1.5), F.lit(2.0)).alias("u"), fx.static_map_url("http://m", "k", F.lit(0.0), F.lit(0.0)).alias("v")).collect()[0]
    assert [(x.lng, x.lat) for x in r.p] == [(1, 2), (3, 4), (5, 6)] and r.u.startswith("http://m?location=1.5,2.0") and r.v is None


def test_author_search_health_and_memory_tools(spark):
    from wayfold.engine import Engine, default_tools

    ts = "2025-01-0{} 00:00:00".format
    cast = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    articles = cast(spark.createDataFrame([("a1", "湖心岛 夜游", "u1", 0.5, ts(1)), ("a2", "天文台", "u1", 0.6, ts(2)), ("a3", "渡口", "u2", None, ts(3))], "article_id string, title string, author_id string, score float, created_at string"), "created_at")
    users = spark.createDataFrame([("u1", "旅行家"), ("u2", "小旅行"), ("u3", "旅行")], "author_id string, author_name string")
    history = cast(spark.createDataFrame([("h", "u1", "a1", True, 1.0, ts(1)), ("h2", "u1", "a2", True, 1.0, ts(2))], "history_id string, user_id string, article_id string, clicked boolean, preference float, ts string"), "ts")
    memory = cast(spark.createDataFrame([("u1", "long", "", "old", ts(1))], "user_id string, memory_type string, period_bucket string, content string, updated_at string"), "updated_at")
    chunks = cast(spark.createDataFrame([("u1", "long", None, 0, "喜欢湖心岛", ts(1)), ("u1", "long", None, 1, "喜欢天文台", ts(2)), ("u1", "long", None, 2, "夜市小吃", ts(2))], "user_id string, memory_type string, period_bucket string, chunk_index int, content string, updated_at string"), "updated_at")
    e = Engine(spark, {"articles": articles, "users": users, "user_rec_history": history, "user_memory": memory, "user_memory_chunks": chunks, "article_chunks": articles, "user_pool_items": history})
    assert [tuple(r) for r in e.author_search(" 旅行 ").collect()] == [("u1", "旅行家", 1, 2, "a2", "天文台"), ("u2", "小旅行", 2, 1, "a3", "渡口")]
    assert {r.name: r.n_rows for r in e.health().collect()}["articles"] == 3
    t = default_tools(e)
    key = '"user_id": "u1", "memory_type": "long", "period_bucket": ""'
    assert t.invoke("user_memory_get", "{" + key + "}").collect()[0].content == "old"
    assert [r.content for r in t.invoke("user_memory_upsert", "{" + key + ', "content": "new", "updated_at": "2025-02-01 00:00:00"}').collect()] == ["new"]
    assert t.invoke("user_history_add", '{"user_id": "u1", "article_id": "a3", "clicked": true, "preference": 2, "ts": "2025-02-01 00:00:00"}').count() == 3
    assert t.invoke("user_history_similar", '{"user_id": "u1", "query": "湖心岛 夜游", "n": 1}').collect()[0].article_id == "a1"
    hits = t.invoke("user_memory_hybrid_search", "{" + key + ', "query": "天文台", "top_k": 2}').orderBy("rank").collect()
    assert hits[0].content == "喜欢天文台" and {h.content for h in hits} <= {"喜欢天文台", "夜市小吃"}


def test_graph_tools(spark):
    from wayfold.engine import graph_tools

    node = "id string, label string, name string, status string, seq int, value double, props map<string,string>"
    rows = [("t", "trip", "T", "open", None, None, {"k": "v"}), ("a", "day", "A", "done", 1, 5.0, {}), ("b", "day", "B", "open", 2, 7.0, {}), ("r1", "review", "", "passed", None, None, {}), ("r2", "review", "", "failed", None, None, {})]
    edge = "src string, dst string, rel string, props map<string,string>"
    edges = [("t", "b", "HAS_DAY", None), ("t", "a", "HAS_DAY", None), ("a", "r1", "REVIEWED_BY", None), ("b", "r2", "REVIEWED_BY", None), ("a", "b", "ROUTES_TO", {"m": "1"})]
    t = graph_tools(spark.createDataFrame(rows, node), spark.createDataFrame(edges, edge))
    run = lambda tool, **k: t.invoke(tool, json.dumps(k)).collect()
    assert [r.id for r in run("children", parent="t")] == ["a", "b"] and [r.id for r in run("unplanned_children", parent="t")] == ["b"]
    assert [r.id for r in run("find_nodes", label="trip", key="k", value="v")] == ["t"] and run("get_node", id="a")[0].name == "A"
    assert (run("children_summary", parent="t")[0].n_children, run("children_summary", parent="t")[0].done) == (2, 1)
    assert [(r.n, r.total) for r in run("budget_summary", node="t")] == [(2, 12.0)] and {r.id for r in run("descendants", root="t", depth=3)} == {"a", "b"}
    assert [r.id for r in run("constraint_violations", root="t")] == ["b"] and (run("layer_review", parent="t")[0].failed, run("layer_review", parent="t")[0].passed) == (1, False)
    s = run("subgraph", node="a")[0]
    assert ([x.child for x in s.children], [x.dst for x in s.routes], [x.passed for x in s.reviews]) == ([], ["b"], [True])
    assert [tuple(r) for r in run("create_insight", id="i", target="t", name="n", status="new")] == [("i", "t", "INSIGHT_BELONGS_TO")] and run("create_review", id="x", target="gone", name="", status="") == []
    assert {(r.src, r.dst): r.props for r in run("merge_route", src="a", dst="b", props='{"m": "2"}')} == {("a", "b"): {"m": "2"}}
    assert {(r.src, r.dst) for r in run("link", src="b", dst="t", rel="NEAR")} == {("b", "t")}
    assert {r.id: r.props for r in run("patch_node", id="t", props='{"k": "w"}')}["t"] == {"k": "w"}
    assert {r.id: r.status for r in run("soft_delete", id="b", at="now", reason="x")}["b"] == "rejected"
    assert [r.id for r in run("add_children", parent="t", count=2)] == ["t-1", "t-2"] and [(r.src, r.dst) for r in run("sequence_children", parent="t")] == [("a", "b")]
