"""The engine's entry points over the tables, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.engine import Engine, graph_tools
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()


def _engine(spark, d, *names, **tables):
    return Engine(spark, {n: load(spark, d, n) for n in names} | tables)


@R.query("""SELECT article_id, title, CASE WHEN lower(title) = '方案' THEN 0 WHEN lower(title) LIKE '方案%' THEN 1 ELSE 2 END AS match_rank, score FROM articles WHERE lower(title) LIKE '%方案%' ORDER BY match_rank, score DESC NULLS LAST, created_at DESC, article_id DESC LIMIT 10""")
def engine_title_search(spark, d):
    """2.12, F3: titles through the engine."""
    return _engine(spark, d, "articles").title_search(" 方案 ", 0)


@R.query("""WITH h AS (SELECT DISTINCT user_id, article_id FROM user_rec_history WHERE preference < 1), u AS (SELECT DISTINCT user_id FROM user_pool_items UNION SELECT 'nobody'),
  p AS (SELECT user_id, article_id, max(remark_score)::DOUBLE AS score FROM user_pool_items GROUP BY 1, 2), k AS (SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY score DESC NULLS LAST, p.article_id) AS rank FROM p LEFT JOIN h USING (user_id, article_id) WHERE h.user_id IS NULL),
  o AS (SELECT * FROM k WHERE rank <= 10), f AS (SELECT article_id, coalesce(score::DOUBLE, 0) AS score, row_number() OVER (ORDER BY coalesce(score::DOUBLE, 0) DESC, created_at DESC, article_id DESC) AS rank FROM (SELECT * FROM articles ORDER BY score DESC NULLS LAST, created_at DESC, article_id DESC LIMIT 10))
  SELECT user_id, article_id, score, rank::INT AS rank, 'pool' AS source FROM o UNION ALL SELECT user_id, article_id, score, rank::INT, 'fallback' FROM u, f WHERE user_id NOT IN (SELECT user_id FROM o)""")
def engine_recommend(spark, d):
    """2.12, O13, J8, O3: recommendations for every user of the pools, and for one without any."""
    e = _engine(spark, d, "user_pool_items", "user_rec_history", "articles")
    users = e.tables["user_pool_items"].select("user_id").union(spark.createDataFrame([("nobody",)], "user_id string"))
    return e.recommend(users)


@R.query("SELECT user_id, pool_type, period_bucket, count(*) AS n FROM user_pool_items GROUP BY ALL HAVING count(*) < 5")
def engine_pools_to_refill(spark, d):
    """2.12, Z4."""
    return _engine(spark, d, "user_pool_items").pools_to_refill(5)


@R.query("""SELECT c_custkey::VARCHAR AS author_id, c_name AS author_name, CASE WHEN lower(c_name) = 'customer#00000002' THEN 0 WHEN lower(c_name) LIKE 'customer#00000002%' THEN 1 ELSE 2 END AS match_rank, count(*) AS article_count, arg_max(o_orderkey, (o_orderdate, o_orderkey::VARCHAR))::VARCHAR AS latest_article_id,
    arg_max(o_orderpriority, (o_orderdate, o_orderkey::VARCHAR)) AS latest_article_title FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower(c_name) LIKE '%customer#00000002%' GROUP BY 1, 2, 3 ORDER BY 3, 4 DESC, max(o_orderdate) DESC, 1 LIMIT 10""")
def engine_author_search(spark, d):
    """2.12, A9, J2, O5: orders are read as articles, customers as authors."""
    a = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("author_id"), F.col("o_orderkey").cast("string").alias("article_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    u = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("author_id"), F.col("c_name").alias("author_name"))
    return _engine(spark, d, articles=a, users=u).author_search("Customer#00000002")


@R.query("SELECT event_id AS id, event_type, user_id::VARCHAR AS article_id FROM events WHERE event_type = 'click'")
def engine_record_events(spark, d):
    """2.12, K5: events of unknown type are dropped, spellings are made even."""
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("event_type"), F.col("user_id").cast("string").alias("article_id"))
    return _engine(spark, d).record_events(e)


@R.query("SELECT article_id, title, 'kept' AS state FROM articles WHERE article_id NOT LIKE '%7' UNION ALL SELECT article_id, 'T ' || article_id, 'new' FROM articles WHERE article_id LIKE '%7'")
def engine_ingest(spark, d):
    """2.12, S11, K1, K6: documents replace the articles of their ids."""
    e = _engine(spark, d, "articles")
    docs = e.tables["articles"].where("article_id like '%7'").select("article_id", F.lit("fallback").alias("title"), F.concat(F.lit("# T "), "article_id", F.lit("\n## h\ntext")).alias("markdown"), F.lit("").alias("tags"), "created_at")
    return e.ingest(docs)["articles"].select("article_id", "title", F.when(F.col("article_id").like("%7"), "new").otherwise("kept").alias("state"))


@R.query("""SELECT article_id, x.h2, x.document, x.content_type FROM articles, (VALUES ('', 'https://i.example/0.png', 'image'), ('h', '["https://i.example/1.png","https://i.example/2.png"]', 'multi_images'), ('h', 'https://i.example/3.png', 'image')) x(h2, document, content_type) WHERE article_id LIKE '%7'""")
def engine_ingest_images(spark, d):
    """Runs of images of ingested documents as chunks of their own."""
    text = "![a](https://i.example/0.png)\n## h\n![](https://i.example/1.png)\n\n![b](https://i.example/2.png)\ntext\n![c](https://i.example/3.png)"
    docs = load(spark, d, "articles").where("article_id like '%7'").select("article_id", "title", F.lit(text).alias("markdown"), F.lit("").alias("tags"), "created_at")
    return _engine(spark, d).ingest(docs)["recall_image"].select("article_id", "h2", "document", "content_type")


@R.query("""SELECT * FROM (VALUES ('add_children'), ('budget_summary'), ('children'), ('children_summary'), ('constraint_violations'), ('create_insight'), ('create_review'), ('descendants'), ('find_nodes'), ('get_node'), ('layer_review'), ('link'), ('merge_route'), ('patch_node'), ('sequence_children'), ('soft_delete'), ('subgraph'), ('unplanned_children')) t(name)""")
def graph_tools_catalog(spark, d):
    """U4: the registered graph tools."""
    nodes = spark.createDataFrame([], "id string, label string, name string, status string, seq int, value double, props map<string,string>")
    edges = spark.createDataFrame([], "src string, dst string, rel string, props map<string,string>")
    return spark.createDataFrame([(n,) for n in graph_tools(nodes, edges).names()], "name string")


@R.query("SELECT 'articles' AS name, count(*) AS n_rows FROM articles UNION ALL SELECT 'user_pool_items', count(*) FROM user_pool_items")
def engine_health(spark, d):
    """2.12: tables and their sizes."""
    return _engine(spark, d, "articles", "user_pool_items").health()


@R.query("""SELECT run, kind, item, arg_max(v, (ts, event_id)) AS payload FROM (SELECT user_id::VARCHAR AS run, event_type AS kind, json_extract_string(props, '$.k') AS item, value AS v, ts, event_id FROM events WHERE user_id = 5) GROUP BY ALL""")
def engine_run_snapshot(spark, d):
    """2.12, Z5: one run's items in their last state."""
    log = load(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("item"), F.struct("ts", "event_id").alias("seq"), F.col("value").alias("payload"))
    return _engine(spark, d, run_events=log).run_snapshot("5").select(F.col("run_id").alias("run"), "kind", "item", "payload")


QUERIES, SQL = R.queries, R.sql
