"""Batch forms of the streaming operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.plans.registry import Registry
from wayfold.runtime import load
from wayfold.streaming import changes, windows

R = Registry()


@R.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_usage(spark, d):
    """Sums in tumbling windows."""
    out = windows.tumbling(load(spark, d, "events"), "ts", ["event_type"], 3600, "value")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@R.query("""WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, sum(value) AS used FROM events GROUP BY 1, 2), m AS (SELECT start, event_type AS pick, round(1000 - used, 4) AS remaining FROM s)
  SELECT start, arg_max(pick, (remaining, pick)) AS pick, max(remaining) AS remaining FROM m GROUP BY 1""")
def max_remaining_pick(spark, d):
    """In each window the choice with the most budget left."""
    u = tumbling_usage(spark, d).withColumn("remaining", F.round(1000 - F.col("total"), 4))
    return u.groupBy("start").agg(F.max_by("event_type", F.struct("remaining", "event_type")).alias("pick"), F.max("remaining").alias("remaining"))


@R.query("SELECT user_id, max(ts) AS last, TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 24 HOUR AS evicted FROM events GROUP BY 1")
def ttl_evict(spark, d):
    """Keys not updated for a day."""
    g = load(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return g.withColumn("evicted", F.col("last") < F.expr("timestamp_ntz '2024-01-31 00:00:00' - interval 24 hours"))


@R.query("""WITH f AS (SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')
  SELECT event_id, attempt::INT AS attempt, CASE WHEN attempt <= 5 THEN least(attempt * attempt * 5, 120) END::INT AS delay_s, CASE WHEN attempt <= 5 THEN 'retry' ELSE 'dead' END AS verdict FROM f""")
def retry_schedule(spark, d):
    """When each failure is tried again."""
    from pyspark.sql import Window

    a = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    f = load(spark, d, "events").where("event_type = 'error'").withColumn("attempt", a)
    return f.select("event_id", "attempt", changes.retry_delay(F.col("attempt")).alias("delay_s"), F.when(F.col("attempt") <= changes.MAX_ATTEMPTS, "retry").otherwise("dead").alias("verdict"))


@R.query("""WITH f AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error'), l AS (SELECT user_id, max(attempt) AS attempt, arg_max(ts, attempt) AS ts FROM f GROUP BY 1)
  SELECT user_id, attempt::INT AS attempt FROM l WHERE attempt <= 5 AND ts + to_seconds(least(attempt * attempt * 5, 120)) <= TIMESTAMP '2024-01-28'""")
def retry_due(spark, d):
    """Failures whose delay is over at a given time."""
    from pyspark.sql import Window

    a = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    f = load(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("message_id"), a.alias("attempt"), F.col("ts").cast("timestamp").alias("failed_at"))
    return changes.due_at(f, "2024-01-28 00:00:00").select(F.col("message_id").alias("user_id"), "attempt")


@R.query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  y AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def session_counts(spark, d):
    """Extension: session windows."""
    s = windows.sessions(load(spark, d, "events"), "ts", "user_id", "6 hours")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@R.query()
def job_coalesce(spark, d):
    """Z3: outcomes of enqueued, started and finished jobs of each key."""
    kind = F.when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "finish").otherwise("enqueue")
    log = load(spark, d, "events").select("user_id", "event_id", kind.alias("action"), F.get_json_object("props", "$.k").alias("q"))
    return windows.replay_jobs(log, ["user_id"], "event_id", "action", "q")


@R.query("""SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 'no message' WHEN event_id % 4 = 2 THEN 'no article_id' WHEN event_id % 4 = 3 THEN 'unknown op' END AS problem, event_id % 4 = 0 AS valid FROM events""")
def message_validate(spark, d):
    """Messages decoded, invalid ones with their problem."""
    n = F.col("event_id")
    text = F.to_json(F.struct(n.cast("string").alias("event_id"), F.when(n % 4 != 2, n.cast("string")).alias("article_id"), F.when(n % 4 == 3, "noop").otherwise("upsert").alias("op")))
    e = load(spark, d, "events").select(n.alias("no"), F.when(n % 4 == 1, F.lit("{broken")).otherwise(text).alias("value"))
    return changes.parse_messages(e).select(F.col("no").alias("event_id"), "problem", "valid")


QUERIES, SQL = R.queries, R.sql
