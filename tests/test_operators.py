"""Exact cases and invariants of the core operators."""

import json
import math
import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from wayfold.functions import strings as fx
from wayfold.functions.text import WHITE_SPACE
from wayfold.operators import evaluation as ev, features, fusion, graph, guide, markdown, merge, search, vectors
from wayfold.operators.multivalue import split_values, tokenize
from wayfold.operators.ranking import distributed_islands, distributed_rank
from wayfold.sources import services, tables


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


# ---- ranks


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_distributed_islands(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([True, True, True, False, None]), "x") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, s int, l boolean, place string").drop("place").repartition(5)
    got = distributed_islands(df, "g", [F.col("s").asc()], F.col("l"), parts).collect()
    want, island, before = {}, 0, None
    for place, (g, s, l, _) in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])), 1):  # noqa: E741
        if not (before and before[0] == g and before[1] and l):
            island += 1
        before = (g, l)
        want[s] = (place, island)
    assert {x.s: (x.place, x.island) for x in got} == want
    assert distributed_islands(df.limit(0), "g", [F.col("s").asc()], F.col("l"), parts).count() == 0


def test_distributed_rank(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randrange(50), i, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, id int, `__rank` string")
    got = {x.id: x["rank"] for x in distributed_rank(df, ["g"], [F.col("v").desc(), F.col("id").asc()], num_partitions=7).collect()}
    for k in ("a", "b", None):
        for i, x in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2])), 1):
            assert got[x[2]] == i
    assert distributed_rank(df.limit(0), ["g"], [F.col("id").asc()]).count() == 0


# ---- problem 3


@pytest.mark.parametrize(
    "text, values",
    [
        (None, []), ("", []), (" \t　", []), (",，、;；|｜/／#", []), ("[]", []),
        ("美妆 , 旅行；穿搭", ["美妆", "旅行", "穿搭"]), ("#study with me# #学生党#", ["study with me", "学生党"]), ("#a#b#c", ["a", "b", "c"]),
        ('["the \\"real\\" one", "x"]', ['the "real" one', "x"]), ('"the ""real"" one",旅行', ['the "real" one', "旅行"]), ("“亲子,家庭”、效率", ["亲子,家庭", "效率"]),
        ("「a「b,c」d」/e", ["a「b,c」d", "e"]), ("C++;Q&A;B1-B2;T恤·穿搭;3.5小时", ["C++", "Q&A", "B1-B2", "T恤·穿搭", "3.5小时"]), ('花期,"5,000步",路线', ["花期", "5,000步", "路线"]),
        ("a,a,a", ["a", "a", "a"]), ('"unclosed, b', ["unclosed", "b"]), ('5"屏, b', ['5"屏', "b"]), ("食谱（春、夏）、b", ["食谱（春、夏）", "b"]), ("don't, it's", ["don't", "it's"]),
        ("‘a,b’;c", ["a,b", "c"]), ("x\ty\nz", ["x", "y", "z"]), ('["\\u4e2d"]', ["中"]), ('["美食/甜点"]', ["美食/甜点"]),
    ],
)
def test_tokenize(text, values):
    assert tokenize(text) == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cc"]), min_size=1, max_size=8), max_size=6))
def test_quoted_values_come_back(values):
    values = [v for v in values if v.strip(WHITE_SPACE)]
    kept = [v.strip(WHITE_SPACE) for v in values]
    assert tokenize("[" + ", ".join(json.dumps(v, ensure_ascii=False) for v in values) + "]") == kept
    assert tokenize(";".join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)) == kept


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_tokenize_never_fails(text):
    assert all(v.strip() or v for v in tokenize(text))


def test_split_values(spark):
    rows = [("a", "x,y", None, "clash"), ("a", "x,y", None, "clash"), (None, "", "“p,q”", "z"), ("b", "长" * 50_000 + ",短", "'", None)]
    df = spark.createDataFrame(rows, "article_id string, tags string, type_tags string, value string").withColumn("pos", F.lit(9)).withColumn("field", F.lit(""))
    got = sorted(((r.article_id, r.field, r.pos, len(r.value)) for r in split_values(df, "article_id", ["tags", "type_tags"]).collect()), key=repr)
    assert got == sorted([("a", "tags", 1, 1), ("a", "tags", 2, 1)] * 2 + [(None, "type_tags", 1, 3), ("b", "tags", 1, 50_000), ("b", "tags", 2, 1), ("b", "type_tags", 1, 1)], key=repr)
    assert split_values(df.limit(0), "article_id", ["tags"]).count() == 0


# ---- problem 6

HISTORY = "history_id string, user_id string, article_id string, clicked boolean, preference float, ts timestamp, event_type string, last int"


def test_features(spark):
    import datetime as dt

    r = random.Random(2)
    t0 = dt.datetime(2025, 12, 1)
    rows = [(None, r.choice(["u", " u ", "v", "", None, "　"]), f"a{r.randrange(9)}", r.choice([True, False, None]), r.choice([None, 0.0, 0.04, 1.0, 1.02, 9.98, 10.0, 11.0, -1.0, float("nan")]), t0 + dt.timedelta(hours=r.randrange(600)), "clash", 1) for _ in range(800)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, HISTORY)
    types = spark.createDataFrame([(f"c{int(c)}_{p}", c, p) for c in (True, False) for p in (0, 10, 100)], "event_type string, clicked boolean, pref_tenths int")
    seen = {}
    for _, u, a, c, p, t, *_ in rows:
        u = (u or "").strip(WHITE_SPACE)
        if u:
            p = math.inf if p is not None and math.isnan(p) else p
            k = (c is not None, c or False, p is not None, p or 0)
            seen[(u, a, t)] = min(seen.get((u, a, t), k), k)
    got = {(x.user_id, x.event_type): x for x in features.feature_rows(df, types, block=2).collect()}
    total = {u: sum(1 for k in seen if k[0] == u) for u in ("u", "v")}
    assert all(sum(x.n_events for (w, _), x in got.items() if w == u) <= total[u] for u in total) and got
    for (u, t), x in got.items():  # an event's type is that of its smallest flag and preference
        mine = [k[2] for k, v in seen.items() if k[0] == u and v[0] and v[2] and v[3] < 99 and f"c{int(v[1])}_{round(v[3] * 10)}" == t]
        assert x.n_events == len(mine) and x.days_since_last == (dt.datetime(2026, 1, 1) - max(mine)).days
    wide = {x.user_id: x for x in features.feature_table(df, types, block=4).collect()}
    assert wide.keys() == {"u", "v"} and all(len(x.n_events) == 6 for x in wide.values())
    assert sum(sum(x.n_events) for x in wide.values()) == sum(x.n_events for x in got.values())
    assert features.feature_rows(df.limit(0), types).count() == 0 and features.feature_table(df.limit(0), types).count() == 0
    assert features.feature_rows(df, types.limit(0)).count() == 0


# ---- evaluation


def test_ndcg_is_one_for_an_ideal_order(spark):
    log = spark.createDataFrame([("r", 1, "like"), ("r", 2, "click"), ("s", 1, "favorite")], "rec_request_id string, rank int, event_type string")
    assert ev.ndcg_at(log).collect()[0].ndcg == 1.0
    assert ev.ndcg_at(log.limit(0)).collect()[0].ndcg == 0.0


def test_ratios_stay_in_range(spark):
    r = one(spark, *[ev.ratio(F.lit(a), F.lit(b)).alias(f"x{i}") for i, (a, b) in enumerate([(1, 0), (3, 2), (-1, 2), (None, 2), (1, None), (1, 4)])])
    assert list(r) == [0.0, 1.0, 0.0, 0.0, 0.0, 0.25]


# ---- fusion and pools


def test_multi_query_merge(spark):
    coarse = spark.createDataFrame([("a", 0.6, 0, 0), ("b", 0.5, 0, 1), ("a", 0.9, 1, 0), ("c", 0.55, 1, 1)], "id string, score double, query_idx int, pos int")
    got = fusion.merge_queries(coarse, "id", "score", ["query_idx", "pos"]).orderBy(F.desc("score")).collect()
    assert [(r.id, r.score, r.support) for r in got] == [("a", 0.9, 2), ("c", 0.55, 1), ("b", 0.5, 1)]


def test_latest_unique_queries(spark):
    df = spark.createDataFrame([("u", q, i) for i, q in enumerate(["美妆", "旅行", "日语", "旅行", "考研", "穿搭"])], "u string, q string, pos int")
    assert [r.q for r in fusion.latest_unique(df, "u", "q", "pos", 3).orderBy("pos").collect()] == ["旅行", "考研", "穿搭"]


def test_rank_score(spark):
    r = one(spark, *[fusion.rank_score(F.lit(a), F.lit(b)).alias(f"x{i}") for i, (a, b) in enumerate([(1, 1), (1, 3), (2, 3), (3, 3), (0, 3), (1, 0)])])
    assert list(r) == [1.0, 1.0, 0.5, 0.0, 0.0, 0.0]


def test_keyword_signals(spark):
    r = one(spark, fx.keyword_signal_score(fx.signals(F.lit("美妆 护肤 妆容 变美 精华 防晒")), F.lit("美妆,护肤,妆容,变美,精华,防晒")).alias("a"), fx.keyword_signal_score(fx.signals(F.lit("想看美妆护肤内容 美妆 护肤")), F.lit("美妆,护肤,妆容")).alias("b"), fx.keyword_coverage(F.lit(8)).alias("c"), fx.keyword_coverage(F.lit(3)).alias("d"))
    assert r.a == 1.0 and r.b >= 0.4 and r.c == 1.0 and abs(r.d - 0.6) < 1e-9


def test_filter_expression():
    assert search.filter_expression("article_id", ["article-1", "article-2"], ["article-9", "article-10"]) == '(article_id in ["article-1","article-2"]) and (article_id not in ["article-9","article-10"])'
    assert search.filter_expression("article_id", [], ["article-9"]) == '(article_id not in ["article-9"])'


# ---- merges


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1, 10), (2, "b", 5, 10)], "k int, v string, ver int, created int")
    new = spark.createDataFrame([(1, "c", 2, 99), (2, "late", 4, 99), (3, "d", 1, 99)], old.schema)
    once = merge.upsert(old, new, ["k"], "ver", ("created",))
    assert sorted(map(tuple, once.collect())) == [(1, "c", 2, 10), (2, "b", 5, 10), (3, "d", 1, 99)]
    assert sorted(map(tuple, merge.upsert(once, new, ["k"], "ver", ("created",)).collect())) == sorted(map(tuple, once.collect()))


def test_changes_in_any_order(spark):
    base = spark.createDataFrame([(1, "a", 1)], "k int, v string, ver int")
    log = [(1, "b", 2, "upsert"), (2, "x", 1, "upsert"), (2, "x", 3, "delete"), (1, "late", 1, "upsert"), (2, "y", 2, "upsert")]
    for order in (log, log[::-1]):
        got = merge.apply_changes(base, spark.createDataFrame(order, "k int, v string, ver int, op string"), "k", ["ver"])
        assert [tuple(r) for r in got.collect()] == [(1, "b", 2)]


def test_coalesced_deltas(spark):
    df = spark.createDataFrame([("r", 1, "问", False), ("r", 2, "第一段", True), ("r", 3, "第二段", True)], "run string, seq int, t string, d boolean")
    got = merge.coalesce_runs(df, "run", "seq", F.col("t"), F.col("d")).orderBy("first_seq").collect()
    assert [r.message for r in got] == ["问", "第一段第二段"]


# ---- text


def test_uuid5(spark):
    r = one(spark, fx.uuid5_url("chunk", F.lit("文|1")).alias("a"))
    assert r.a == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:文|1"))


def test_text_functions(spark):
    r = one(
        spark, fx.cn_number(F.lit("1.2万")).alias("a"), fx.cn_number(F.lit("1,234")).alias("b"), fx.cn_number(F.lit("很多")).alias("c"), fx.html_text(F.lit("<b>a&amp;b</b>\n c")).alias("d"), fx.host_kind(F.lit("http://192.168.0.1/x")).alias("e"),
        fx.host_kind(F.lit("http://localhost:80")).alias("f"), fx.host_kind(F.lit("not a url")).alias("g"), fx.lng_lat(F.lit("116.4,39.9")).alias("h"), fx.lng_lat(F.lit("0,0")).alias("i"), fx.json_block(F.lit('x {"a": {"b": 1}} y')).alias("j"), fx.clamp_text(F.lit("a" * 50), 30).alias("k"),
        fx.url_normalize(F.lit("https://a.b/c?x#y")).alias("l"), fx.json_array_clean(F.lit("oops")).alias("m"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (12000, 1234, None, "a&b c", "private", "loopback", None)
    assert r.h.lng == 116.4 and r.i is None and r.j == '{"a": {"b": 1}}' and len(r.k) == 33 and r.l == "https://a.b/c" and r.m == []


def test_packed_paragraphs():
    chunks = fx.pack_paragraphs("一" * 100 + "\n" + "二" * 100 + "\n\n" + "三" * 900, 320, 40)
    assert chunks[0] == "一" * 100 + "\n" + "二" * 100 and all(len(c) <= 360 for c in chunks)
    assert chunks[1].startswith("二" * 40) and fx.pack_paragraphs(None, 320, 40) == []


def test_markdown():
    assert markdown.parse("## 小标题\n正文内容\n", "题") == {"title": "题", "sections": [{"h2": "小标题", "blocks": [{"type": "text", "text": "正文内容"}]}]}
    m = markdown.parse("# Markdown 标题\n## 小标题\n正文 ![x](https://a/b.png) 尾", "题")
    assert m["title"] == "Markdown 标题" and [b["type"] for b in m["sections"][0]["blocks"]] == ["text", "image"]


# ---- graph


def test_roll_up_counts_paths(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    v = spark.createDataFrame([("d", 5.0)], "id string, value double")
    assert {r.id: (r.n, r.total) for r in graph.roll_up(e, v).collect()} == {"a": (2, 10.0), "b": (1, 5.0), "c": (1, 5.0)}
    assert {(r.root, r.id): r.depth for r in graph.descendants(e, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2}


def test_gate_fails_without_review(spark):
    e = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "z")], "src string, dst string")
    r = spark.createDataFrame([("x", True), ("z", True)], "id string, passed boolean")
    assert {x.src: x.passed for x in graph.gate(e, r).collect()} == {"p": False, "q": True}


# ---- guide


def test_guide_query_plan(spark):
    t = spark.createDataFrame([("大阪旅游攻略",), (" ",)], "t string")
    got = guide.query_plan(t, "t", 3).orderBy("pos").collect()
    assert [r["query"] for r in got] == ["大阪旅游攻略", "大阪旅游攻略 攻略", "大阪旅游攻略 自由行"]


# ---- vectors and services


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1200)] + 0.5 * rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [])], "id long, vec array<float>")
    q = df.where("id % 50 = 0 and id < 5000")
    exact = {(r.query_id, r.id) for r in vectors.top_k(q, df, 10, 16).collect()}
    found = {(r.query_id, r.id) for r in vectors.InvertedFile.fit(df, 16, lists=12).search(q, df, 10, probes=4).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_index_recall_on_embeddings(spark):
    from wayfold.plans import vectors as pv

    d = "/root/testdata/sf0.01"
    exact = {(r.query_id, r.id) for r in pv.vector_topk(spark, d).collect()}
    found = {(r.query_id, r.id) for r in pv.vector_topk_indexed(spark, d).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_cosine_edges(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    r = one(spark, vectors.cosine(a, a).alias("x"), vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))).alias("y"), vectors.cosine(a, F.array(F.lit(1.0))).alias("z"), vectors.cosine(a, F.lit(None).cast("array<double>")).alias("w"))
    assert list(r) == [1.0, 0.0, 0.0, 0.0]


def test_ingest_and_services(spark, tmp_path):
    docs = spark.createDataFrame([("a1", "t", "# 题\n## 节\n" + "内容。" * 300, "x,y"), ("", "t", "dropped", ""), ("a2", None, " ", "")], "article_id string, title string, markdown string, tags string").withColumn("created_at", F.lit("2025-01-01").cast("timestamp"))
    out = tables.ingest(docs)
    chunks = out["article_chunks"].collect()
    assert len(chunks) > 1 and {c.article_id for c in chunks} == {"a1"} and len({c.chunk_id for c in chunks}) == len(chunks)
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-4 for r in out["recall_fine"].collect())
    index = tmp_path / "index.jsonl"
    index.write_text("\n".join(json.dumps({"title": f"大阪 {i}", "url": f"u{i}", "summary": ""}) for i in range(30)))
    got = services.search(spark, ["大阪", "无"], str(index), count=99).collect()
    assert len(got) == 10 and got[0].pos == 1
    q = spark.createDataFrame([("北京站",), (" ",)], "address string")
    ans = services.map_requests(q, "geocode", lambda r: json.dumps({"status": "1", "info": "OK", "asked": r}), per_second=1000).select("address", services.envelope(F.col("answer")).alias("e")).collect()
    assert {r.address: r.e.ok for r in ans} == {"北京站": True, " ": None}
    waits = []
    limit = services.RateLimiter(2, sleep=waits.append, clock=lambda: 0.0)
    for _ in range(3):
        limit.wait()
    assert waits == [0.5, 1.0]
    assert one(spark, services.lexical_rerank(F.lit("ab"), F.lit("xa")).alias("s")).s == 0.5


def test_unclosed_signs_take_linear_time():
    import time

    t = time.perf_counter()
    for text in ("(" * 100_000, "“" * 100_000, "(“" * 50_000 + ")", '"' * 100_001):
        tokenize(text)
    assert time.perf_counter() - t < 5
    assert tokenize("a(b,c),“d“e”,f”,(g,h") == ["a(b,c)", "d“e”,f", "(g", "h"]


def test_image_groups(spark):
    from wayfold.functions import content as cx

    rows = [("a", [("image", "u1"), ("IMAGE ", " u2 "), ("image", " "), ("text", "x"), ("image", "u3")]), ("b", [("text", None)]), ("c", []), ("d", None)]
    df = spark.createDataFrame(rows, "id string, b array<struct<type:string,text:string>>").select("id", cx.image_groups(F.col("b")).alias("g"))
    assert {r.id: r.g for r in df.collect()} == {"a": [["u1", "u2"], ["u3"]], "b": [], "c": [], "d": []}
    got = df.select("id", F.explode("g").alias("g")).select(cx.image_chunk(F.col("g")).alias("c")).collect()
    assert [(r.c.content_type, r.c.content) for r in got] == [("multi_images", '["u1","u2"]'), ("image", "u3")]


def test_guide_status_of_rejects_and_weak_ones(spark):
    rows = [("成都广告软文", "u", "UP主", "成都旅游广告内容"), ("成都攻略", "u", "黑名单UP", "成都旅游攻略内容"), ("成都旅游完整路线攻略", "u", "UP主A", "成都路线、住宿、交通和美食的完整经验总结，适合第一次去成都自由行。"), ("无关内容", "u", "UP主B", "这是一条和主题关系很弱的内容。")]
    c = spark.createDataFrame(rows, "title string, url string, author_name string, summary string").withColumns({"source_intent": F.lit("overview"), "publish_time": F.lit(0).cast("bigint")})
    c = c.withColumns({k: F.lit(100_000).cast("bigint") for k in ("view_count", "like_count", "favorite_count", "danmaku_count")})
    text = guide.full_text(F.col("title"), F.col("summary"))
    out = guide.reject_reason(F.col("title"), F.col("url"), F.col("author_name"), text, ["黑名单"], ["广告"]).isNotNull()
    s = guide.status(out, guide.video_score(c, ["成都"], [], [], "2025-06-01 00:00:00"), guide.count_contained(text, ["成都"]), F.col("summary"), F.col("view_count"), accept=60, review=20, least_summary=10, least_popularity=10)
    assert [r.s for r in c.select(s.alias("s")).collect()] == ["rejected", "rejected", "accepted", "review"]


def test_freshness_with_an_age_limit(spark):
    df = spark.createDataFrame([(d,) for d in (10, 100, 350, 500, 2000)], "days long").select(guide.freshness(F.unix_timestamp(F.lit("2025-06-01 00:00:00").cast("timestamp")) - F.col("days") * 86_400, "2025-06-01 00:00:00", 300).alias("x"), guide.freshness(F.unix_timestamp(F.lit("2025-06-01 00:00:00").cast("timestamp")) - F.col("days") * 86_400, "2025-06-01 00:00:00").alias("y"))
    assert [tuple(r) for r in df.collect()] == [(15.0, 15.0), (9.0, 9.0), (1.0, 9.0), (1.0, 5.0), (1.0, 2.0)]


def test_graph_writes(spark):
    nodes = spark.createDataFrame([("t", "trip"), ("p", "poi")], "id string, label string")
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    new = spark.createDataFrame([("i1", "insight", "t"), ("i2", "insight", "gone"), ("i3", "insight", None)], "id string, label string, trip string")
    n, e = graph.create(nodes, edges, new, "trip", "BELONGS")
    assert {r.id for r in n.collect()} == {"t", "p", "i1"} and [tuple(r) for r in e.collect()] == [("i1", "t", "BELONGS")]
    old = spark.createDataFrame([("t", "p", "R", "x"), ("p", "t", "R", "y")], "src string, dst string, rel string, props string")
    add = spark.createDataFrame([("t", "p", "R", "b", 2), ("t", "p", "R", "a", 1), ("t", "q", "R", "c", 3)], "src string, dst string, rel string, props string, at int")
    assert {tuple(r) for r in graph.merge_edges(old, add, nodes, "at").collect()} == {("t", "p", "R", "b"), ("p", "t", "R", "y")}
    sub = graph.subgraph(nodes.select("id"), {"x": spark.createDataFrame([("t", 2), ("t", 1), ("t", 2)], "id string, v int"), "y": spark.createDataFrame([("p", "a")], "id string, w string")})
    assert {r.id: ([x.v for x in r.x], [y.w for y in r.y]) for r in sub.collect()} == {"t": ([1, 2], []), "p": ([], ["a"])}
    gone = graph.soft_delete(spark.createDataFrame([("a", "open", {"k": "1", "visibility": "on"}), ("b", "open", None)], "id string, status string, props map<string,string>"), spark.createDataFrame([("a",), ("b",), ("z",)], "id string"), "now", "why")
    assert {r.id: (r.status, r.props["visibility"], r.props.get("k")) for r in gone.collect()} == {"a": ("rejected", "dimmed", "1"), "b": ("rejected", "dimmed", None)}


def test_greedy_choice_by_brute_force(spark):
    r = random.Random(3)
    rows = [(g, s, r.randrange(6), float(r.randrange(4))) for g in range(8) for s in range(5) for _ in range(3)]
    df = spark.createDataFrame(rows, "g long, s long, item long, score double")
    want = set()
    for g in range(8):
        taken = set()
        for s in range(5):
            for _, i in sorted((-x[3], x[2]) for x in rows if x[:2] == (g, s)):
                if i not in taken:
                    taken.add(i)
                    want.add((g, s, i))
                    break
    assert {tuple(x) for x in merge.greedy_choice(df.select("g", "s").distinct(), df, "g", "s", "item", "score").collect()} == want
