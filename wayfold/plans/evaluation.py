"""Evaluation queries: the event table read as a recommendation log, documents as articles."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayfold.operators import evaluation as ev
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
AS_OF = "2024-01-31 00:00:00"
DAY = 86_400
#: How the types of the event table are read.
KINDS = {"view": "impression", "click": "click", "purchase": "read_complete", "signup": "favorite", "error": "dislike"}


def event_log(spark, d):
    kind = F.col("event_type")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    e = load(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("article_id"), kind.alias("event_type"), F.col("ts").alias("event_ts"), "value")
    e = e.withColumn("rec_request_id", F.concat_ws("-", "user_id", F.date_format("event_ts", "yyyy-MM-dd")))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("rec_request_id").orderBy("event_ts", "event_id")))


def request_log(spark, d):
    return event_log(spark, d).groupBy("rec_request_id").agg(F.min("event_ts").alias("created_at"))


def article_dim(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("source").alias("type_tags"), F.col("lang").alias("tags"))


EV = """
  ev0 AS (SELECT event_id, user_id::VARCHAR AS user_id, json_extract_string(props, '$.k') AS article_id, value, ts AS event_ts,
          CASE event_type WHEN 'view' THEN 'impression' WHEN 'purchase' THEN 'read_complete' WHEN 'signup' THEN 'favorite' WHEN 'error' THEN 'dislike' ELSE event_type END AS event_type,
          user_id || '-' || strftime(ts, '%Y-%m-%d') AS rec_request_id FROM events),
  ev AS (SELECT *, row_number() OVER (PARTITION BY rec_request_id ORDER BY event_ts, event_id) AS rank FROM ev0),
  rq AS (SELECT rec_request_id, min(event_ts) AS created_at FROM ev GROUP BY 1),
  art AS (SELECT doc_id::VARCHAR AS article_id, source AS type_tags, lang AS tags FROM documents)"""
POS = "event_type IN ('click', 'like', 'favorite', 'read_complete')"


def _counts(where="TRUE"):
    return f"""SELECT (SELECT count(*) FROM rq) AS requests, count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
      count(*) FILTER (event_type IN ('like', 'favorite', 'read_complete')) AS conversions, count(DISTINCT rec_request_id) FILTER ({POS}) AS positive_requests,
      count(DISTINCT rec_request_id || ':' || article_id) FILTER ({POS}) AS positive_items, count(DISTINCT article_id) FILTER (event_type = 'impression') AS unique_articles FROM ev WHERE {where}"""


def _q(n, d):
    return f"CASE WHEN {d} > 0 THEN least(greatest({n} / ({d})::DOUBLE, 0), 1) ELSE 0 END"


_COVER = "SELECT count(DISTINCT article_id) FILTER (event_type = 'impression') AS recommended, (SELECT count(*) FROM art) AS total FROM ev"
_DIVERSE = """SELECT avg(CASE WHEN items > 0 THEN topics / items::DOUBLE ELSE 0 END) AS diversity FROM
  (SELECT rec_request_id, count(DISTINCT ev.article_id) AS items, count(DISTINCT nullif(coalesce(type_tags, tags, ''), '')) AS topics FROM ev LEFT JOIN art USING (article_id) WHERE event_type = 'impression' GROUP BY 1)"""
_PERSON = """
  pr AS (SELECT user_id, article_id FROM ev WHERE event_type = 'impression' AND user_id <> '' ORDER BY user_id, event_ts DESC, event_id DESC LIMIT 2000),
  pu AS (SELECT user_id, list(DISTINCT article_id) AS l FROM pr GROUP BY 1 ORDER BY 1 LIMIT 50),
  pp AS (SELECT coalesce(avg(1 - len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))::DOUBLE), 0) AS personalization FROM pu a JOIN pu b ON a.user_id < b.user_id)"""
_NDCG = f"""
  nw AS (SELECT rec_request_id, rank, sum(CASE WHEN event_type = 'click' THEN 1.0 ELSE 2.0 END)::DOUBLE AS w FROM ev WHERE {POS} AND rank BETWEEN 1 AND 10 GROUP BY 1, 2),
  ni AS (SELECT *, row_number() OVER (PARTITION BY rec_request_id ORDER BY w DESC, rank) AS i FROM nw),
  nd AS (SELECT coalesce(avg(d), 0) AS ndcg FROM (SELECT sum(w / log2(rank + 1)) / sum(w / log2(i + 1)) AS d FROM ni GROUP BY rec_request_id))"""


@R.query(f"WITH {EV} {_counts()}")
def event_counts(spark, d):
    """A2: conditional counts over the log."""
    return ev.event_counts(event_log(spark, d), request_log(spark, d))


@R.query(f"WITH {EV}, c AS ({_counts()}) SELECT round({_q('clicks', 'impressions')}, 6) AS ctr, round({_q('conversions', 'clicks')}, 6) AS cvr FROM c")
def ctr_cvr(spark, d):
    """A3: zero-safe clamped ratios."""
    c = event_counts(spark, d)
    return c.select(F.round(ev.ratio(F.col("clicks"), F.col("impressions")), 6).alias("ctr"), F.round(ev.ratio(F.col("conversions"), F.col("clicks")), 6).alias("cvr"))


@R.query(f"WITH {EV}, c AS ({_COVER}) SELECT recommended, total, round({_q('recommended', 'total')}, 6) AS coverage FROM c")
def coverage(spark, d):
    """A4."""
    return ev.coverage(event_log(spark, d), article_dim(spark, d)).withColumn("coverage", F.round("coverage", 6))


@R.query(f"WITH {EV} SELECT round(diversity, 6) AS diversity FROM ({_DIVERSE})")
def diversity(spark, d):
    """A5, J3."""
    return ev.diversity(event_log(spark, d), article_dim(spark, d)).select(F.round("diversity", 6).alias("diversity"))


@R.query(f"WITH {EV}, {_PERSON} SELECT round(personalization, 6) AS personalization FROM pp")
def personalization(spark, d):
    """A6, J11."""
    return ev.personalization(event_log(spark, d)).select(F.round("personalization", 6).alias("personalization"))


@R.query(f"WITH {EV}, {_NDCG} SELECT round(ndcg, 6) AS ndcg FROM nd")
def ndcg_at_10(spark, d):
    """A7."""
    return ev.ndcg_at(event_log(spark, d)).select(F.round("ndcg", 6).alias("ndcg"))


@R.query(f"""WITH {EV}, {_PERSON}, {_NDCG}, c AS ({_counts()}), cv AS ({_COVER}), dv AS ({_DIVERSE})
  SELECT 'hit_rate' AS metric, round({_q('positive_requests', 'requests')}, 6) AS value FROM c UNION ALL
  SELECT 'recall', round({_q('positive_items', 'greatest(unique_articles, 1)')}, 6) FROM c UNION ALL
  SELECT 'precision', round({_q('positive_items', 'impressions')}, 6) FROM c UNION ALL
  SELECT 'ranking_quality', round(ndcg, 6) FROM nd UNION ALL SELECT 'diversity', round(diversity, 6) FROM dv UNION ALL
  SELECT 'coverage', round({_q('recommended', 'total')}, 6) FROM cv UNION ALL SELECT 'personalization', round(personalization, 6) FROM pp UNION ALL
  SELECT 'ctr', round({_q('clicks', 'impressions')}, 6) FROM c UNION ALL SELECT 'cvr', round({_q('conversions', 'clicks')}, 6) FROM c""")
def reco_summary(spark, d):
    """The flagship query."""
    return ev.summary(event_log(spark, d), None, article_dim(spark, d))


@R.query(f"WITH {EV} SELECT event_id, event_type, article_id FROM ev WHERE event_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def time_window_filter(spark, d):
    """a lower time bound relative to a given time."""
    return ev.since(event_log(spark, d), AS_OF, 7 * DAY).select("event_id", "event_type", "article_id")


@R.query(f"""WITH {EV} SELECT w.name AS win, count(*) FILTER (event_type = 'impression') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  round({_q("count(*) FILTER (event_type = 'click')", "count(*) FILTER (event_type = 'impression')")}, 6) AS ctr
  FROM (VALUES ('1d', 86400), ('7d', 604800), ('30d', 2592000)) w(name, s) LEFT JOIN ev ON event_ts >= TIMESTAMP '{AS_OF}' - to_seconds(s) GROUP BY 1""")
def windowed_metrics(spark, d):
    """The last 1, 7 and 30 days in one pass over the part of the log since the longest window began."""
    windows = {"1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
    age = F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("event_ts").cast("timestamp")) / 1e6
    log = ev.since(event_log(spark, d), AS_OF, max(windows.values()))
    aggs = [F.count(F.when((F.col("event_type") == t) & (age <= s), 1)).alias(f"{w}_{t}") for w, s in windows.items() for t in ("impression", "click")]
    one = log.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(w).alias("win"), F.col(f"{w}_impression").alias("impressions"), F.col(f"{w}_click").alias("clicks")) for w in windows])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("ctr", F.round(ev.ratio(F.col("clicks"), F.col("impressions")), 6))


@R.query("SELECT event_id, lower(trim(event_type)) AS event_type FROM events WHERE lower(trim(event_type)) IN ('click', 'view') AND trim(coalesce(json_extract_string(props, '$.k'), '')) <> ''")
def event_ingest_filter(spark, d):
    """K5: events of a known type with a nonblank article."""
    e = load(spark, d, "events").withColumn("event_type", F.lower(F.trim("event_type")))
    return e.where(F.col("event_type").isin("click", "view") & (F.trim(F.get_json_object("props", "$.k")) != "")).select("event_id", "event_type")


@R.query("""SELECT CASE WHEN value <= 5 THEN '5' WHEN value <= 10 THEN '10' WHEN value <= 25 THEN '25' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE '+Inf' END AS le, event_type, count(*) AS n
  FROM events GROUP BY 1, 2""")
def histogram_buckets(spark, d):
    """Labelled histogram with fixed upper bounds."""
    bounds = [5, 10, 25, 50, 100]
    le = F.lit("+Inf")
    for b in reversed(bounds):
        le = F.when(F.col("value") <= b, str(b)).otherwise(le)
    return load(spark, d, "events").groupBy(le.alias("le"), "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES, SQL = R.queries, R.sql
