"""Guide-material queries over the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import guide as op, merge
from wayfold.operators.ranking import distributed_rank
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
AS_OF = "2025-06-01 00:00:00"
_T = "lower(coalesce(title, '') || ' ' || coalesce(summary, ''))"


def cands(spark, d):
    return load(spark, d, "zhihu_guide_candidates")


_INTENT = "CASE WHEN source_intent IS NOT NULL AND source_intent NOT IN ('', 'other') THEN source_intent " + " ".join("WHEN " + " OR ".join(f"contains({_T}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in op.INTENT_WORDS) + " ELSE 'other' END"
_AGE = f"((epoch(TIMESTAMP '{AS_OF}') - edit_time) / 86400.0)"
_FRESH = f"CASE WHEN coalesce(edit_time, 0) <= 0 THEN 3.0 WHEN {_AGE} <= 30 THEN 15.0 WHEN {_AGE} <= 90 THEN 12.0 WHEN {_AGE} <= 365 THEN 9.0 WHEN {_AGE} <= 1095 THEN 5.0 ELSE 2.0 END"
_SCORE = f"""round((least(30.0, (contains({_T}, '攻略')::INT + contains({_T}, '第一次')::INT) * 12.0) + least(8.0, (contains({_T}, '预算')::INT + contains({_T}, '门票')::INT) * 2.0) + CASE WHEN ({_INTENT}) <> 'other' THEN 20.0 ELSE 6.0 END
  + least(20.0, log10(greatest(coalesce(vote_up_count, 0), 0) + 1) * 8 + log10(greatest(coalesce(comment_count, 0), 0) + 1) * 3) + ({_FRESH}) + CASE WHEN is_article THEN 8.0 ELSE 3.0 END + CASE WHEN search_scope = 'global_search' THEN 6.0 ELSE 0.0 END
  + CASE WHEN contains(coalesce(author_name, ''), '行记') THEN 5.0 ELSE 0.0 END + CASE WHEN length(coalesce(title, '')) BETWEEN 8 AND 60 THEN 2.5 ELSE 0 END + CASE WHEN length(coalesce(summary, '')) BETWEEN 40 AND 300 THEN 2.5 ELSE 0 END)::DOUBLE, 1)"""


@R.query(f"SELECT candidate_id, CASE WHEN coalesce(title, '') = '' THEN 'no title' WHEN coalesce(url, '') = '' THEN 'no url' WHEN contains(coalesce(author_name, ''), 'Lab') THEN 'blocked author' WHEN contains({_T}, '押金') THEN 'negative keyword' END AS reason FROM zhihu_guide_candidates")
def guide_reject_reasons(spark, d):
    """F10."""
    c = cands(spark, d)
    return c.select("candidate_id", op.reject_reason(F.col("title"), F.col("url"), F.col("author_name"), op.full_text(F.col("title"), F.col("summary")), ["Lab"], ["押金"]).alias("reason"))


@R.query(f"SELECT candidate_id, {_INTENT} AS intent FROM zhihu_guide_candidates")
def intent_classify(spark, d):
    """X20, X26."""
    return cands(spark, d).select("candidate_id", op.classify(F.col("source_intent"), op.full_text(F.col("title"), F.col("summary"))).alias("intent"))


@R.query(f"SELECT candidate_id, ({_FRESH})::DOUBLE AS freshness FROM zhihu_guide_candidates")
def freshness_bucket(spark, d):
    """X18."""
    return cands(spark, d).select("candidate_id", op.freshness(F.col("edit_time"), AS_OF).alias("freshness"))


@R.query(f"SELECT candidate_id, {_SCORE} AS score FROM zhihu_guide_candidates")
def guide_score(spark, d):
    """X16, X19."""
    c = cands(spark, d)
    return c.select("candidate_id", op.score(c, ["攻略", "第一次"], ["预算", "门票"], ["行记"], AS_OF).alias("score"))


_MUST = f"(contains({_T}, '攻略')::INT + contains({_T}, '第一次')::INT)"
_REJECT = f"(coalesce(title, '') = '' OR coalesce(url, '') = '' OR contains(coalesce(author_name, ''), 'Lab') OR contains({_T}, '押金'))"


@R.query(f"""SELECT candidate_id, CASE WHEN {_REJECT} OR s < 40 THEN 'rejected' WHEN length(coalesce(summary, '')) < 40 OR coalesce(vote_up_count, 0) < 5 OR {_MUST} = 0 OR NOT coalesce(is_article, FALSE) OR s < 60 THEN 'review' ELSE 'accepted' END AS status FROM (SELECT *, {_SCORE} AS s FROM zhihu_guide_candidates)""")
def guide_status(spark, d):
    """Accepted, for review or rejected, by score and by what is weak."""
    c = cands(spark, d)
    text, must = op.full_text(F.col("title"), F.col("summary")), ["攻略", "第一次"]
    out = op.reject_reason(F.col("title"), F.col("url"), F.col("author_name"), text, ["Lab"], ["押金"]).isNotNull()
    s = op.score(c, must, ["预算", "门票"], ["行记"], AS_OF)
    return c.select("candidate_id", op.status(out, s, op.count_contained(text, must), F.col("summary"), F.col("vote_up_count"), F.col("is_article"), accept=60, review=40, least_summary=40, least_popularity=5).alias("status"))


_VIDEO_INTENT = "CASE WHEN source_intent IS NOT NULL AND source_intent NOT IN ('', 'other') THEN source_intent " + " ".join("WHEN " + " OR ".join(f"contains({_T}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in op.VIDEO_INTENTS) + " ELSE 'other' END"
_VIDEO_FRESH = f"CASE WHEN coalesce(edit_time, 0) <= 0 THEN 3.0 WHEN {_AGE} > 400 THEN 1.0 WHEN {_AGE} <= 30 THEN 15.0 WHEN {_AGE} <= 90 THEN 12.0 WHEN {_AGE} <= 365 THEN 9.0 WHEN {_AGE} <= 1095 THEN 5.0 ELSE 2.0 END"
_LOG = lambda x: f"log10(greatest(coalesce({x}, 0), 0) + 1)"
_VIDEO = f"""round((least(30.0, {_MUST} * 12.0) + least(10.0, (contains({_T}, '预算')::INT + contains({_T}, '门票')::INT) * 2.0) + CASE WHEN ({_VIDEO_INTENT}) <> 'other' THEN 22.0 ELSE 6.0 END
  + least(22.0, {_LOG('vote_up_count * 20')} * 6 + {_LOG('vote_up_count')} * 5 + {_LOG('comment_count')} * 4 + {_LOG('comment_count * 2')} * 2) + ({_VIDEO_FRESH}) + CASE WHEN length(coalesce(title, '')) BETWEEN 6 AND 80 THEN 3 ELSE 0 END
  + CASE WHEN length(coalesce(summary, '')) BETWEEN 20 AND 500 THEN 3 ELSE 0 END + CASE WHEN contains(coalesce(author_name, ''), '行记') THEN 5.0 ELSE 0.0 END)::DOUBLE, 1)"""


@R.query(f"""SELECT candidate_id, s AS score, CASE WHEN {_REJECT} OR s < 45 THEN 'rejected' WHEN length(coalesce(summary, '')) < 20 OR coalesce(vote_up_count * 20, 0) < 100 OR {_MUST} = 0 OR s < 70 THEN 'review' ELSE 'accepted' END AS status FROM (SELECT *, {_VIDEO} AS s FROM zhihu_guide_candidates)""")
def guide_score_video(spark, d):
    """Score and status of videos; the candidates' votes and comments stand for the counts of videos."""
    c = cands(spark, d).withColumns({"view_count": F.col("vote_up_count") * 20, "like_count": F.col("vote_up_count"), "favorite_count": F.col("comment_count"), "danmaku_count": F.col("comment_count") * 2, "publish_time": F.col("edit_time")})
    text, must = op.full_text(F.col("title"), F.col("summary")), ["攻略", "第一次"]
    out = op.reject_reason(F.col("title"), F.col("url"), F.col("author_name"), text, ["Lab"], ["押金"]).isNotNull()
    scored = c.withColumn("v", op.video_score(c, must, ["预算", "门票"], ["行记"], AS_OF, 400))
    return scored.select("candidate_id", F.col("v").alias("score"), op.status(out, F.col("v"), op.count_contained(text, must), F.col("summary"), F.col("view_count"), accept=70, review=45, least_summary=20, least_popularity=100).alias("status"))


@R.query("SELECT run_id, count(*) AS raw, count(DISTINCT url_hash) AS distinct_urls, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (search_scope = 'global_search') AS global_scope FROM zhihu_guide_candidates GROUP BY 1")
def guide_stats(spark, d):
    """A17."""
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    s = F.col("status")
    return cands(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("url_hash").alias("distinct_urls"), n(s == "accepted", "accepted"), n(s == "review", "review"), n(s == "rejected", "rejected"), n(F.col("search_scope") == "global_search", "global_scope"))


@R.query("""WITH c AS (SELECT *, lower(trim(url_hash, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288))) AS k FROM zhihu_guide_candidates WHERE trim(url_hash, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) <> ''), s AS (SELECT k, source_query, min(candidate_id) AS o FROM c GROUP BY 1, 2)
  SELECT k, arg_max(candidate_id, (coalesce(vote_up_count, 0), -candidate_id)) AS candidate_id, (SELECT list(source_query ORDER BY o) FROM s WHERE s.k = c.k) AS sources FROM c GROUP BY k""")
def guide_dedup(spark, d):
    """A18."""
    from wayfold.functions.text import nonblank

    c = cands(spark, d).withColumn("k", F.lower(nonblank(F.col("url_hash"))))
    return op.dedup(c, "k", F.coalesce("vote_up_count", F.lit(0)), "candidate_id").select("k", "candidate_id", "sources")


@R.query("SELECT run_id, candidate_id, row_number() OVER (PARTITION BY run_id ORDER BY CASE status WHEN 'accepted' THEN 0 WHEN 'review' THEN 1 WHEN 'rejected' THEN 2 ELSE 3 END, score DESC NULLS LAST, candidate_id)::INT AS place FROM zhihu_guide_candidates")
def guide_rank(spark, d):
    """The candidates of every run by status, then score."""
    c = cands(spark, d)
    status = F.when(F.col("status") == "accepted", 0).when(F.col("status") == "review", 1).when(F.col("status") == "rejected", 2).otherwise(3)
    c = c.select("run_id", "candidate_id", "score", status.alias("s"))
    return distributed_rank(c, ["run_id"], [F.col("s").asc(), F.desc_nulls_last("score"), F.col("candidate_id").asc()], "place").select("run_id", "candidate_id", F.col("place").cast("int").alias("place"))


@R.query("""WITH p AS (SELECT candidate_id, url_hash, regexp_replace(trim(url), '[?#].*$', '') AS u FROM zhihu_guide_candidates), d AS (SELECT candidate_id AS decision_id, CASE WHEN candidate_id % 2 = 0 THEN url_hash END AS h, regexp_replace(trim(url), '[?#].*$', '') AS u FROM zhihu_guide_candidates),
  ph AS (SELECT url_hash, min(candidate_id) AS c FROM p WHERE url_hash IS NOT NULL GROUP BY 1), pu AS (SELECT u, min(candidate_id) AS c FROM p GROUP BY 1)
  SELECT decision_id, coalesce(ph.c, pu.c) AS candidate_id FROM d LEFT JOIN ph ON ph.url_hash = d.h LEFT JOIN pu ON pu.u = d.u""")
def decision_match(spark, d):
    """Decisions found by hash, else by address."""
    c = cands(spark, d)
    dec = c.select(F.col("candidate_id").alias("decision_id"), F.when(F.col("candidate_id") % 2 == 0, F.col("url_hash")).alias("url_hash"), F.concat("url", F.lit("?from=x")).alias("url"))
    return op.match_decisions(dec, c.select("candidate_id", "url_hash", "url"))


@R.query("""WITH h AS (SELECT candidate_id, candidate_id AS pos FROM zhihu_guide_candidates WHERE search_scope = 'global_search' AND status = 'accepted' ORDER BY pos LIMIT 10),
  a AS (SELECT candidate_id FROM zhihu_guide_candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM h) AND status <> 'rejected' ORDER BY score DESC NULLS LAST, candidate_id LIMIT 15)
  SELECT candidate_id, 'human' AS by FROM h UNION ALL SELECT candidate_id, 'auto' FROM (SELECT candidate_id FROM a LIMIT 15)""")
def decision_fill(spark, d):
    """Human choices first (here the accepted of the wider search), at most ten, filled up by score."""
    c = cands(spark, d)
    human = c.where("search_scope = 'global_search' and status = 'accepted'").orderBy("candidate_id").limit(10).select("candidate_id")
    auto = c.where("status <> 'rejected'").join(human, "candidate_id", "left_anti").orderBy(F.desc_nulls_last("score"), "candidate_id").limit(15).select("candidate_id")
    return human.withColumn("by", F.lit("human")).union(auto.withColumn("by", F.lit("auto")))


_PLAN = ", ".join(f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(op.QUERY_TEMPLATES))


@R.query(f"WITH t AS (SELECT DISTINCT trim(substr(run_id, 17)) AS topic FROM zhihu_guide_candidates WHERE trim(substr(run_id, 17)) <> '') SELECT topic, pos, trim(topic || s) AS query, intent FROM t, (VALUES {_PLAN}) v(pos, s, intent)")
def query_plan(spark, d):
    """Queries of each topic from templates."""
    topics = cands(spark, d).select(F.trim(F.expr("substring(run_id, 17)")).alias("t")).where("t <> ''").distinct()
    return op.query_plan(topics, "t", len(op.QUERY_TEMPLATES))


_VIDEO_PLAN = ", ".join(f"({i}, '{s}', '{k}')" for i, (s, k) in enumerate(op.VIDEO_TEMPLATES))


@R.query(f"WITH t AS (SELECT DISTINCT trim(substr(run_id, 17)) AS topic FROM zhihu_guide_candidates WHERE trim(substr(run_id, 17)) <> '') SELECT topic, pos, trim(topic || s) AS query, intent FROM t, (VALUES {_VIDEO_PLAN}) v(pos, s, intent)")
def query_plan_video(spark, d):
    """Queries for videos of each topic from templates."""
    topics = cands(spark, d).select(F.trim(F.expr("substring(run_id, 17)")).alias("t")).where("t <> ''").distinct()
    return op.query_plan(topics, "t", len(op.VIDEO_TEMPLATES), op.VIDEO_TEMPLATES)


@R.query("SELECT run_id, list(DISTINCT source_intent ORDER BY source_intent)[1:24] AS topics FROM zhihu_guide_candidates WHERE source_intent IS NOT NULL GROUP BY 1")
def guide_topics(spark, d):
    """Distinct topics of a run, at most 24 (the feature's cap)."""
    return cands(spark, d).groupBy("run_id").agg(F.slice(F.sort_array(F.collect_set("source_intent")), 1, 24).alias("topics"))


@R.query("SELECT candidate_id, list_concat(coalesce(reasons, []), CASE WHEN status = 'rejected' THEN ['rejected'] ELSE [] END)[1:5] AS evidence FROM zhihu_guide_candidates")
def review_evidence(spark, d):
    """X46, X50."""
    none = F.array().cast("array<string>")
    return cands(spark, d).select("candidate_id", F.slice(F.concat(F.coalesce("reasons", none), F.when(F.col("status") == "rejected", F.array(F.lit("rejected"))).otherwise(none)), 1, 5).alias("evidence"))


@R.query("""WITH x AS (SELECT run_id, '- ' || coalesce(title, '(untitled)') || ' (' || coalesce(status, '-') || ')' AS l, row_number() OVER (PARTITION BY run_id ORDER BY candidate_id) AS n FROM zhihu_guide_candidates WHERE status = 'accepted')
  SELECT run_id, ((n - 1) // 50)::INT AS part, string_agg(l, chr(10) ORDER BY n) AS report FROM x GROUP BY 1, 2""")
def guide_report(spark, d):
    """A run's Markdown list, in parts of fifty lines."""
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("(untitled)")), F.lit(" ("), F.coalesce("status", F.lit("-")), F.lit(")"))
    c = cands(spark, d).where("status = 'accepted'").select("run_id", "candidate_id", "title", "status")
    return merge.joined_lines(c, "run_id", [F.col("candidate_id").asc()], line, 50).withColumnRenamed("text", "report")


QUERIES, SQL = R.queries, R.sql
