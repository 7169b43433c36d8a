"""Several operators together, with counts known beforehand."""

import json

from pyspark.sql import functions as F

from wayfold.operators import fusion, graph, guide, merge, search
from wayfold.functions import strings as fx


def test_guide_pipeline(spark):
    """Five items, two of them under one address apart from the query: 4 distinct, 3 selected."""
    rows = [
        (1, "大阪旅游攻略：路线与预算", "https://x.example/question/1/answer/1?from=a", "甲", "大阪 路线 " * 20, 900, 30, "q1", "overview"),
        (2, "大阪旅游攻略：路线与预算", "https://x.example/question/1/answer/1#b", "甲", "大阪 路线 " * 20, 800, 30, "q2", "itinerary"),
        (3, "大阪住哪里更方便，酒店整理", "https://x.example/p/3", "乙", "大阪 酒店 " * 20, 500, 10, "q1", "hotel_area"),
        (4, "大阪美食地图，吃遍道顿堀", "https://x.example/p/4", "丙", "大阪 美食 " * 20, 50, 1, "q3", "food"),
        (5, "京都红叶", "https://x.example/p/5", "丁", "短", 0, 0, "q3", "other"),
    ]
    c = spark.createDataFrame(rows, "candidate_id long, title string, url string, author_name string, summary string, vote_up_count long, comment_count long, source_query string, source_intent string")
    c = c.withColumn("k", F.sha1(fx.url_normalize(F.col("url")))).withColumn("edit_time", F.lit(0).cast("bigint")).withColumn("is_article", F.lit(True)).withColumn("search_scope", F.lit("site"))
    once = guide.dedup(c, "k", F.col("vote_up_count"), "candidate_id")
    assert sorted((r.candidate_id, tuple(r.sources)) for r in once.collect()) == [(1, ("q1", "q2")), (3, ("q1",)), (4, ("q3",)), (5, ("q3",))]
    kept = c.join(once.select("candidate_id"), "candidate_id")
    scored = kept.withColumn("score", guide.score(kept, ["大阪"], ["预算"], [], "2025-06-01 00:00:00")).where("score >= 45")
    chosen = fusion.capped_then_fill(scored, "source_intent", [F.desc("score"), F.col("candidate_id").asc()], 2, 3)
    assert sorted(r.candidate_id for r in chosen.collect()) == [1, 3, 4]
    reasons = c.select(guide.reject_reason(F.col("title"), F.col("url"), F.col("author_name"), guide.full_text(F.col("title"), F.col("summary")), ["乙"], ["红叶"]).alias("r")).collect()
    assert [r.r for r in reasons] == [None, None, "blocked author", None, "negative keyword"]


def test_decisions_by_hash_then_address(spark):
    pool = spark.createDataFrame([(1, "h1", "https://a/1?x"), (2, None, "https://a/2")], "candidate_id long, url_hash string, url string")
    dec = spark.createDataFrame([(10, "h1", "https://other"), (11, None, "https://a/2#y"), (12, "h9", "https://a/1"), (13, None, None)], "decision_id long, url_hash string, url string")
    assert {r.decision_id: r.candidate_id for r in guide.match_decisions(dec, pool).collect()} == {10: 1, 11: 2, 12: 1, 13: None}


def test_snapshot_fold_equals_replay(spark):
    log = [("r", "point", "p1", 1, "exact"), ("r", "route", "x", 2, "open"), ("r", "point", "p1", 3, "dimmed"), ("r", "route", "x", 5, "selected"), ("s", "point", "p1", 4, "exact")]
    state = {}
    for run, kind, item, _, payload in sorted(log, key=lambda x: x[3]):
        state[(run, kind, item)] = payload
    df = spark.createDataFrame(log[::-1], "run string, kind string, item string, seq int, payload string")
    assert {(r.run, r.kind, r.item): r.payload for r in merge.snapshot_fold(df, "run", "kind", "item", "seq", ["payload"]).collect()} == state


def test_keyset_pages_cover_everything(spark):
    df = spark.range(47).select(F.col("id"), F.floor(F.col("id") / 13).alias("at"))  # more rows of one key than a page holds
    seen, cursor = [], None
    for _ in range(9):
        page = search.keyset_page(df, "at", "id", cursor, 10).orderBy("pos").collect()
        seen += [r.id for r in page]
        if not page[-1].has_more:
            break
        cursor = (page[-1]["at"], page[-1].id)
    assert seen == list(range(46, -1, -1))


def test_dates_are_clipped(spark):
    df = spark.createDataFrame([("a", "2024-01-30", "2024-03-02"), ("b", "2024-05-01", "2024-05-01"), ("c", "2024-05-02", "2024-05-01"), ("d", None, "2024-01-01")], "k string, lo string, hi string")
    got = [(r.k, r.no, str(r.lo), str(r.hi)) for r in graph.date_split(df, "k", "lo", "hi", "month").orderBy("k", "no").collect()]
    assert got == [("a", 1, "2024-01-30", "2024-01-31"), ("a", 2, "2024-02-01", "2024-02-29"), ("a", 3, "2024-03-01", "2024-03-02"), ("b", 1, "2024-05-01", "2024-05-01")]
    weeks = graph.date_split(df, "k", "lo", "hi", "week").where("k = 'a'").collect()
    assert len(weeks) == 5 and str(weeks[-1].hi) == "2024-03-02"


def test_streaks(spark):
    df = spark.createDataFrame([("u", d) for d in ("2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03", "2024-01-05", "2024-01-06")], "u string, d string")
    assert [(str(r.lo), r.n) for r in graph.islands(df, "u", F.to_date("d"), 3).collect()] == [("2024-01-01", 3)]


def test_first_keyword_prefers_the_longest(spark):
    df = spark.createDataFrame([(1, "去湖心岛看湖"), (2, "无"), (3, None)], "id int, t string")
    assert [(r.id, r.word, r.pos) for r in graph.first_keyword(df, "id", "t", ["湖", "湖心岛"]).collect()] == [(1, "湖心岛", 2)]


def test_message_round_trip(spark):
    from wayfold.streaming.changes import parse_messages

    m = {"event_scope": "s", "event_id": "e", "article_id": "a", "op": "upsert", "version_ms": 7, "secondary_tags": ["x", "y"], "markdown": "# t"}
    r = parse_messages(spark.createDataFrame([(json.dumps(m, ensure_ascii=False),)], "value string")).collect()[0]
    assert r.valid and r.secondary_tags == ["x", "y"] and r.version_ms == 7
