"""Merge queries over the pool items, history, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import merge as op
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()


@R.query("""WITH x AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderdate AS dt, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS fresh FROM orders)
  SELECT k, arg_max(v, (dt, id)) AS v, max(dt) AS updated_at, arg_min(dt, (fresh, dt, id)) AS created_at FROM x GROUP BY k""")
def upsert_latest(spark, d):
    """K1-K4, K7: the newest row of each key, created_at preserved; old rows are those of status F."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    o = o.withColumn("ver", F.struct("updated_at", "id"))
    old, new = o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus")
    return op.upsert(old, new, ["k"], "ver", ("created_at",)).select("k", "v", "updated_at", "created_at")


@R.query("""SELECT coalesce(a.article_id, b.article_id) AS article_id, coalesce(nullif(trim(b.cover), ''), a.cover) AS cover, coalesce(b.score, a.score) AS score
  FROM articles a FULL JOIN (SELECT article_id, CASE WHEN score > 0.7 THEN '' ELSE 'new-' || article_id END AS cover, CASE WHEN score > 0.5 THEN score END AS score FROM articles) b ON a.article_id = b.article_id""")
def upsert_keep_nonblank(spark, d):
    """Blank new values keep the old ones."""
    a = load(spark, d, "articles").select("article_id", "cover", "score")
    new = a.select("article_id", F.when(F.col("score") > 0.7, "").otherwise(F.concat(F.lit("new-"), "article_id")).alias("cover"), F.when(F.col("score") > 0.5, F.col("score")).alias("score"))
    return op.upsert_keep_nonblank(a, new, ["article_id"])


@R.query("""WITH new AS (SELECT article_id, chunk_id || '-v2' AS chunk_id FROM article_chunks WHERE h2 = '小结')
  SELECT article_id, chunk_id FROM article_chunks WHERE article_id NOT IN (SELECT article_id FROM new) UNION ALL SELECT * FROM new""")
def replace_partition(spark, d):
    """K6: an article's chunks are replaced as a whole."""
    c = load(spark, d, "article_chunks").select("article_id", "chunk_id", "h2")
    new = c.where("h2 = '小结'").select("article_id", F.concat("chunk_id", F.lit("-v2")).alias("chunk_id"))
    return op.replace_partition(c.drop("h2"), new, ["article_id"])


@R.query("""WITH gone AS (SELECT article_id FROM articles WHERE score < 0.3)
  SELECT 'articles' AS tbl, count(*) AS n FROM articles WHERE article_id NOT IN (FROM gone) UNION ALL SELECT 'article_chunks', count(*) FROM article_chunks WHERE article_id NOT IN (FROM gone)
  UNION ALL SELECT 'user_pool_items', count(*) FROM user_pool_items WHERE article_id NOT IN (FROM gone) UNION ALL SELECT 'user_rec_history', count(*) FROM user_rec_history WHERE article_id NOT IN (FROM gone)""")
def cascade_delete(spark, d):
    """K8, K9: a delete reaches every dependent table; here their remaining rows are counted."""
    names = ["articles", "article_chunks", "user_pool_items", "user_rec_history"]
    tables = [load(spark, d, n) for n in names]
    left = op.cascade_delete(tables, "article_id", tables[0].where("score < 0.3"))
    out = None
    for n, t in zip(names, left):
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n")
        out = one if out is None else out.union(one)
    return out


@R.query("""WITH c AS (SELECT user_id, value, ts, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events),
  l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(op, (ts, event_id)) AS op FROM c GROUP BY 1)
  SELECT user_id, value FROM l WHERE op <> 'delete'""")
def cdc_apply(spark, d):
    """A change log applied by version, errors read as deletes."""
    e = load(spark, d, "events").select("user_id", "value", "ts", "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    empty = e.drop("op").limit(0)
    return op.apply_changes(empty, e, "user_id", ["ts", "event_id"]).select("user_id", "value")


@R.query("""SELECT user_id::VARCHAR AS run, event_type AS kind, json_extract_string(props, '$.k') AS item, arg_max(value, (ts, event_id)) AS value, arg_max(event_type IN ('error'), (ts, event_id)) AS dimmed
  FROM events GROUP BY 1, 2, 3""")
def snapshot_fold(spark, d):
    """The last write of each item of a run."""
    e = load(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("item"), "value", (F.col("event_type") == "error").alias("dimmed"), F.struct("ts", "event_id").alias("seq"))
    return op.snapshot_fold(e, "run", "kind", "item", "seq", ["value", "dimmed"]).drop("last_seq")


@R.query("""WITH o AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS delta, json_extract_string(props, '$.k') || '.' AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
  s AS (SELECT *, CASE WHEN delta AND coalesce(lag(delta) OVER (PARTITION BY user_id ORDER BY seq), FALSE) THEN 0 ELSE 1 END AS st FROM o),
  i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM s)
  SELECT user_id, min(seq)::INT AS first_seq, bool_or(delta) AS delta, count(*) AS n, string_agg(t, '' ORDER BY seq) AS message FROM i GROUP BY user_id, island""")
def coalesce_deltas(spark, d):
    """Consecutive deltas of a run joined into one message."""
    return op.coalesce_runs(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.concat(F.get_json_object("props", "$.k"), F.lit(".")), F.col("event_type").isin("view", "click"))


@R.query("SELECT l_orderkey AS parent, l_linenumber AS src, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem QUALIFY dst IS NOT NULL")
def next_edges(spark, d):
    """NEXT edges along each parent's children."""
    return op.next_edges(load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "parent"), "parent", "l_linenumber", ["l_linenumber", "l_partkey"])


@R.query("""SELECT event_id, k, CASE WHEN k IS NULL THEN 'missing key' WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown op' ELSE 'ok' END AS verdict
  FROM (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def json_parse_validate(spark, d):
    """Messages parsed and validated; invalid ones keep their reason."""
    m = load(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return m.select("event_id", "k", F.when(F.col("k").isNull(), "missing key").when(~F.col("event_type").isin("view", "click", "purchase"), "unknown op").otherwise("ok").alias("verdict"))


@R.query("""SELECT o_orderkey AS parent, 'decomposed' AS status, o_orderkey || '-' || i AS child, i::INT AS seq FROM orders, range(1, 1 + (o_orderkey % 3 + 1)::BIGINT) r(i)""")
def split_children(spark, d):
    """A parent split into numbered children."""
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("parent"), F.lit("decomposed").alias("status"), F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("seq")).withColumn("child", F.concat_ws("-", "parent", "seq"))


QUERIES, SQL = R.queries, R.sql
