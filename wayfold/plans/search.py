"""Search queries over articles, chunks and the order tables (read as published articles and authors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import search as op
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()


@R.query("""SELECT article_id, coalesce(title, '') AS title, CASE WHEN lower(title) = '方案' THEN 0 WHEN lower(title) LIKE '方案%' THEN 1 ELSE 2 END AS rank
  FROM articles WHERE lower(title) LIKE '%方案%' ORDER BY rank, score DESC NULLS LAST, article_id LIMIT 20""")
def title_search(spark, d):
    """case-insensitive title lookup in order of match."""
    a = load(spark, d, "articles")
    rank = F.when(op.match_rank(F.col("title"), "方案") < 2, op.match_rank(F.col("title"), "方案")).otherwise(2)
    hits = a.where(F.lower("title").like("%方案%")).withColumn("rank", rank)
    return hits.orderBy("rank", F.desc_nulls_last("score"), "article_id").limit(20).select("article_id", F.coalesce("title", F.lit("")).alias("title"), "rank")


_KEY = """
  q AS (SELECT '%{q}%' AS p, '{q}' AS raw),
  best AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY article_id ORDER BY CASE WHEN lower(coalesce(h2, '')) = raw THEN 0 WHEN lower(coalesce(h2, '')) LIKE raw || '%' THEN 1 ELSE 2 END, created_at DESC, chunk_id DESC) AS r
    FROM article_chunks c, q WHERE lower(coalesce(h2, '')) LIKE p OR lower(coalesce(content, '')) LIKE p) WHERE r = 1)
  SELECT a.article_id, coalesce(a.title, '') AS title, coalesce(type_tags, '') AS type_tags, coalesce(tags, '') AS tags, score, coalesce(chunk_id, '') AS chunk_id, coalesce(h2, '') AS h2
  FROM articles a CROSS JOIN q LEFT JOIN best b ON b.article_id = a.article_id
  WHERE lower(coalesce(a.title, '')) LIKE p OR lower(coalesce(type_tags, '')) LIKE p OR lower(coalesce(tags, '')) LIKE p OR chunk_id IS NOT NULL
  ORDER BY CASE WHEN lower(coalesce(a.title, '')) = raw THEN 0 WHEN lower(coalesce(a.title, '')) LIKE raw || '%' THEN 1 WHEN lower(coalesce(type_tags, '')) LIKE p THEN 2 WHEN lower(coalesce(tags, '')) LIKE p THEN 3 ELSE 4 END,
    score DESC NULLS LAST, a.created_at DESC, a.article_id DESC LIMIT 50"""


@R.query("WITH " + _KEY.format(q="护肤"))
def keyword_search(spark, d):
    """Keyword lookup with each article's best chunk."""
    return op.keyword_search(load(spark, d, "articles"), load(spark, d, "article_chunks"), "护肤", 50)


def _published(spark, d):
    return load(spark, d, "orders").where("o_orderstatus = 'F' and o_totalprice > 0")


@R.query("""SELECT o_orderkey, c_name AS author_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c.c_custkey::VARCHAR = o_custkey::VARCHAR
  WHERE o_orderstatus = 'F' AND o_totalprice > 0""")
def left_join_cast(spark, d):
    """Published articles with their author, joined on a cast key."""
    c = load(spark, d, "customer").where("c_acctbal > 0")
    o = _published(spark, d)
    return o.join(c, o.o_custkey.cast("string") == c.c_custkey.cast("string"), "left").select("o_orderkey", F.col("c_name").alias("author_name"))


@R.query("""SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r = 1""")
def latest_per_group(spark, d):
    """Each author's latest article and number of articles."""
    return op.latest_per_group(load(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@R.query("""SELECT c_custkey::VARCHAR AS author_id, c_name AS author_name, CASE WHEN lower(c_name) = 'customer#00000001' THEN 0 WHEN lower(c_name) LIKE 'customer#00000001%' THEN 1 ELSE 2 END AS match_rank,
    count(*) AS article_count, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_article_id
  FROM customer JOIN orders ON o_custkey = c_custkey WHERE lower(c_name) LIKE '%00000001%' AND o_orderstatus = 'F' AND o_totalprice > 0 GROUP BY 1, 2, 3 ORDER BY 3, 4 DESC, max(o_orderdate) DESC, 1 LIMIT 10""")
def author_search(spark, d):
    """Authors by name with their article count and latest article."""
    authors = load(spark, d, "customer").where(F.lower("c_name").like("%00000001%"))
    latest = op.latest_per_group(_published(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_orderkey"])
    out = authors.join(latest, F.col("c_custkey") == F.col("o_custkey")).withColumn("match_rank", op.match_rank(F.col("c_name"), "customer#00000001"))
    out = out.withColumn("match_rank", F.coalesce("match_rank", F.lit(2))).orderBy("match_rank", F.desc("n"), F.desc("o_orderdate"), F.col("c_custkey").cast("string")).limit(10)
    return out.select(F.col("c_custkey").cast("string").alias("author_id"), F.col("c_name").alias("author_name"), "match_rank", F.col("n").alias("article_count"), F.col("o_orderkey").alias("latest_article_id"))


@R.query("""SELECT article_id, score FROM articles a WHERE NOT EXISTS (SELECT 1 FROM user_rec_history h WHERE h.article_id = a.article_id AND h.preference < 0) ORDER BY score DESC NULLS LAST, created_at DESC, article_id DESC LIMIT 50""")
def fallback_topk_excluding(spark, d):
    """Best articles without an exclusion list, by an anti join (no NOT IN null trap)."""
    bad = load(spark, d, "user_rec_history").where("preference < 0").select("article_id")
    return load(spark, d, "articles").join(bad, "article_id", "left_anti").orderBy(F.desc_nulls_last("score"), F.desc("created_at"), F.desc("article_id")).limit(50).select("article_id", "score")


@R.query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderpriority NOT IN ('2-HIGH')")
def include_exclude_filter(spark, d):
    """F6."""
    return op.include_exclude(load(spark, d, "orders"), "o_orderpriority", ["1-URGENT", " 2-HIGH ", "", "5-LOW"], ["2-HIGH", " "]).select("o_orderkey", "o_orderpriority")


@R.query(f"""SELECT o_orderkey, o_orderdate, 1 AS page, pos, TRUE AS has_more FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') WHERE pos <= 20
  UNION ALL SELECT o_orderkey, o_orderdate, 2, pos - 20, n > 40 FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos, count(*) OVER () AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') WHERE pos BETWEEN 21 AND 40""")
def keyset_page(spark, d):
    """A page of 20 before a date, and the page after its last row."""
    o = load(spark, d, "orders")
    one = op.keyset_page(o, "o_orderdate", "o_orderkey", "1996-01-01 00:00:00", 20).select("o_orderkey", "o_orderdate", F.lit(1).alias("page"), "pos", "has_more")
    last = one.where("pos = 20").first()
    two = op.keyset_page(o, "o_orderdate", "o_orderkey", (last["o_orderdate"], last["o_orderkey"]), 20) if last else o.limit(0).withColumns({"pos": F.lit(0), "has_more": F.lit(False)})
    return one.unionByName(two.select("o_orderkey", "o_orderdate", F.lit(2).alias("page"), "pos", "has_more"))


@R.query("SELECT chunk_id, length(content)::INT AS n_tokens FROM article_chunks WHERE chunk_id IN (SELECT chunk_id FROM article_chunks WHERE h2 = '小结')")
def in_list_lookup(spark, d):
    """Lookup of a list of keys, given as a table, with the token count."""
    c = load(spark, d, "article_chunks")
    keys = c.where("h2 = '小结'").select("chunk_id")
    return c.join(keys, "chunk_id", "left_semi").select("chunk_id", F.char_length("content").alias("n_tokens"))


@R.query("SELECT article_id, score::DOUBLE AS score FROM user_pool_items WHERE user_id = 'u900000001' AND pool_type = 'periodic' AND coalesce(period_bucket, '') = 'w002'")
def memory_get(spark, d):
    """S3, F1: lookup by a composite key; the filter reaches the scan."""
    p = load(spark, d, "user_pool_items")
    return p.where("user_id = 'u900000001' and pool_type = 'periodic' and coalesce(period_bucket, '') = 'w002'").select("article_id", F.col("score").cast("double").alias("score"))


@R.query("SELECT history_id, article_id, ts FROM user_rec_history WHERE user_id = 'u000000002' ORDER BY ts DESC, history_id DESC, article_id LIMIT 50")
def history_recent(spark, d):
    """O2: a user's newest history."""
    return load(spark, d, "user_rec_history").where("user_id = 'u000000002'").orderBy(F.desc("ts"), F.desc_nulls_last("history_id"), "article_id").limit(50).select("history_id", "article_id", "ts")


@R.query("""WITH v AS (SELECT vec_id::VARCHAR AS article_id, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 20)
  SELECT pos, e.event_id FROM v JOIN events e ON json_extract_string(e.props, '$.k') = v.article_id WHERE e.event_type = 'click'""")
def history_by_rank(spark, d):
    """Rows of an id list, keeping the list's rank."""
    ids = load(spark, d, "embeddings").where("label = 3").orderBy("vec_id").limit(20).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    ranked = ids.select(F.posexplode("ids").alias("p", "vec_id")).select((F.col("p") + 1).alias("pos"), F.col("vec_id").cast("string").alias("article_id"))
    e = load(spark, d, "events").where("event_type = 'click'").withColumn("article_id", F.get_json_object("props", "$.k"))
    return e.join(F.broadcast(ranked), "article_id").select("pos", "event_id")  # at most 20 rows


QUERIES, SQL = R.queries, R.sql
