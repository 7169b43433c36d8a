"""Candidate pools, rank fusion and preference windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayfold.functions.text import strip
from wayfold.operators import fusion as op
from wayfold.operators.ranking import distributed_rank
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
_TRIM = "chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)"
_POOL = f"p AS (SELECT user_id, lower(trim(pool_type, {_TRIM})) AS pool, coalesce(period_bucket, '') AS bucket, article_id, CASE WHEN isnan(score) THEN NULL ELSE score::DOUBLE END AS score, similarity::DOUBLE AS similarity, remark_score::DOUBLE AS remark, inserted_at FROM user_pool_items)"


def pool_items(spark, d):
    s = F.col("score").cast("double")
    return load(spark, d, "user_pool_items").select("user_id", F.lower(strip(F.col("pool_type"))).alias("pool"), F.coalesce("period_bucket", F.lit("")).alias("bucket"), "article_id", F.when(~F.isnan(s), s).alias("score"), F.col("similarity").cast("double").alias("similarity"), F.col("remark_score").cast("double").alias("remark"), "inserted_at")


@R.query(f"WITH {_POOL} SELECT user_id, pool, bucket, count(*) AS n FROM p GROUP BY ALL")
def pool_size(spark, d):
    """A1: items in every pool."""
    return pool_items(spark, d).groupBy("user_id", "pool", "bucket").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"WITH {_POOL} SELECT user_id, pool, bucket, count(*) AS n, 10 - count(*) AS missing FROM p GROUP BY ALL HAVING count(*) < 10")
def pools_below_min(spark, d):
    """Pools to refill."""
    return pool_size(spark, d).where("n < 10").withColumn("missing", 10 - F.col("n"))


@R.query(f"WITH {_POOL} SELECT article_id, remark, inserted_at FROM p WHERE user_id = 'u900000001' AND pool = 'periodic' ORDER BY remark DESC NULLS LAST, inserted_at, article_id LIMIT 10")
def pool_pop_topk(spark, d):
    """O1: the items that a pop takes."""
    return pool_items(spark, d).where("user_id = 'u900000001' and pool = 'periodic'").orderBy(F.desc_nulls_last("remark"), "inserted_at", "article_id").limit(10).select("article_id", "remark", "inserted_at")


@R.query(f"""WITH {_POOL}, t AS (SELECT article_id FROM p WHERE user_id = 'u900000001' AND pool = 'periodic' ORDER BY remark DESC NULLS LAST, inserted_at, article_id LIMIT 10)
  SELECT pool, count(*) AS n FROM p WHERE NOT (user_id = 'u900000001' AND pool = 'periodic' AND article_id IN (FROM t)) GROUP BY 1""")
def pool_after_pop(spark, d):
    """O1, K9: pool sizes after the popped items are removed."""
    p = pool_items(spark, d)
    gone = pool_pop_topk(spark, d).select("article_id", F.lit("u900000001").alias("user_id"), F.lit("periodic").alias("pool"))
    return p.join(gone, ["user_id", "pool", "article_id"], "left_anti").groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


_DISLIKE = "dl AS (SELECT DISTINCT article_id FROM user_rec_history WHERE preference < 1 AND user_id = 'u900000001')"


@R.query(f"""WITH {_POOL}, {_DISLIKE}, x AS (SELECT article_id, min((CASE pool WHEN 'short_term' THEN 0 WHEN 'periodic' THEN 1 ELSE 2 END, -coalesce(remark, -1), article_id)) AS m
  FROM p WHERE user_id = 'u900000001' GROUP BY 1)
  SELECT article_id, m[1]::INT AS source FROM x WHERE article_id NOT IN (FROM dl)""".replace("m[1]", "struct_extract(m, 1)"))
def collect_candidates(spark, d):
    """Three pools united, first place kept, minus dislikes."""
    p = pool_items(spark, d).where("user_id = 'u900000001'")
    lists = [p.where(F.col("pool") == k) for k in ("short_term", "periodic", "long_term")]
    seen = op.first_seen(lists, "article_id", [(-F.coalesce("remark", F.lit(-1.0))).alias("r")])
    h = load(spark, d, "user_rec_history").where("preference < 1 and user_id = 'u900000001'").select("article_id")
    return seen.join(h, "article_id", "left_anti").select("article_id", "source")


@R.query(f"WITH {_POOL}, {_DISLIKE} SELECT DISTINCT article_id, article_id IN (FROM dl) AS disliked FROM p WHERE user_id = 'u900000001'")
def anti_semi_dislikes(spark, d):
    """Candidates minus dislikes (anti) and in dislikes (semi)."""
    p = pool_items(spark, d).where("user_id = 'u900000001'").select("article_id").distinct()
    h = load(spark, d, "user_rec_history").where("preference < 1 and user_id = 'u900000001'").select("article_id")
    return p.join(h, "article_id", "left_anti").withColumn("disliked", F.lit(False)).union(p.join(h, "article_id", "left_semi").withColumn("disliked", F.lit(True)))


@R.query("""WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k FROM orders)
  SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
  UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_ops(spark, d):
    """2.8: distinct union, intersection and difference."""
    a = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    b = load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
    return one("union", a.union(b).distinct()).union(one("intersect", a.intersect(b))).union(one("except", a.subtract(b)))


@R.query("""SELECT label, vec_id, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (r - 1) / (n - 1)::DOUBLE END, 6) AS rank_score FROM
  (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""")
def rank_score(spark, d):
    """Linear score of a rank."""
    e = load(spark, d, "embeddings").select("label", "vec_id")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("n"))  # ten labels hold all rows, so no window by label
    e = distributed_rank(e, ["label"], [F.col("vec_id").asc()], "r").join(n, "label")
    return e.select("label", "vec_id", F.round(op.rank_score(F.col("r"), F.col("n")), 6).alias("rank_score"))


@R.query(f"""WITH {_POOL}, h AS (SELECT user_id, pool, article_id, max(score) AS score, max(similarity) AS sim, max(remark) AS rr, count(*) AS support FROM p WHERE score IS NOT NULL AND similarity IS NOT NULL GROUP BY 1, 2, 3),
  c AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool ORDER BY score DESC, article_id) AS cr FROM h QUALIFY cr <= 80),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool ORDER BY sim DESC, article_id) AS fr, count(*) OVER (PARTITION BY user_id, pool) AS n FROM c)
  SELECT user_id, pool, article_id, round(0.25 * (CASE WHEN n = 1 THEN 1 ELSE 1 - (cr - 1) / (n - 1)::DOUBLE END) + 0.35 * (CASE WHEN n = 1 THEN 1 ELSE 1 - (fr - 1) / (n - 1)::DOUBLE END)
    + 0.40 * least(greatest(coalesce(rr, 0), 0), 1) + least(0.10, (support - 1) * 0.05), 6) AS pass_score FROM r WHERE coalesce(rr, 0) >= 0.2""")
def rank_fusion(spark, d):
    """Coarse and fine ranks fused with the rerank score; a coarse recall keeps 80 hits, cut before the shuffle."""
    h = pool_items(spark, d).where("score is not null and similarity is not null").groupBy("user_id", "pool", "article_id").agg(F.max("score").alias("score"), F.max("similarity").alias("sim"), F.max("remark").alias("rr"), F.count(F.lit(1)).alias("support"))
    w = Window.partitionBy("user_id", "pool")
    h = h.withColumn("cr", F.row_number().over(w.orderBy(F.desc("score"), "article_id"))).where("cr <= 80").withColumn("fr", F.row_number().over(w.orderBy(F.desc("sim"), "article_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    score = op.fuse(h, op.rank_score(F.col("cr"), F.col("n")), op.rank_score(F.col("fr"), F.col("n")), F.col("rr"), F.col("support"))
    return h.where("coalesce(rr, 0) >= 0.2").select("user_id", "pool", "article_id", F.round(score, 6).alias("pass_score"))


@R.query("""WITH h AS (SELECT json_extract_string(props, '$.k') AS article_id, value AS score, user_id AS query_idx, event_id AS pos FROM events)
  SELECT article_id, max(score) AS score, arg_min(query_idx, (-score, query_idx, pos)) AS query_idx, arg_min(pos, (-score, query_idx, pos)) AS pos, count(*) AS support FROM h GROUP BY 1""")
def multi_query_merge(spark, d):
    """Best hit over queries, first wins ties, with the support."""
    h = load(spark, d, "events").select(F.get_json_object("props", "$.k").alias("article_id"), F.col("value").alias("score"), F.col("user_id").alias("query_idx"), F.col("event_id").alias("pos"))
    return op.merge_queries(h, "article_id", "score", ["query_idx", "pos"])


@R.query(f"""WITH {_POOL}, b AS (SELECT user_id, article_id, max(remark) AS remark, min(inserted_at) AS first_at FROM p WHERE pool = 'periodic' GROUP BY 1, 2)
  SELECT user_id, article_id, remark, row_number() OVER (PARTITION BY user_id ORDER BY first_at, article_id)::INT AS place, round(avg(coalesce(remark, 0)) OVER (PARTITION BY user_id), 6) AS coverage FROM b""")
def build_pool_items(spark, d):
    """Best entry of each article in first-seen order, with the mean remark."""
    b = pool_items(spark, d).where("pool = 'periodic'").groupBy("user_id", "article_id").agg(F.max("remark").alias("remark"), F.min("inserted_at").alias("first_at"))
    mean = b.groupBy("user_id").agg(F.round(F.avg(F.coalesce("remark", F.lit(0.0))), 6).alias("coverage"))
    placed = distributed_rank(b, ["user_id"], [F.col("first_at").asc(), F.col("article_id").asc()], "place")  # one user has a tenth of the rows
    return placed.join(mean, "user_id").select("user_id", "article_id", "remark", F.col("place").cast("int").alias("place"), "coverage")


@R.query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id % 97, vec_id) AS turn FROM embeddings)
  SELECT r.vec_id, label, turn FROM r JOIN (SELECT label, vec_id % 97 AS a, vec_id AS b FROM r WHERE turn = 1) f USING (label) ORDER BY turn, a, b LIMIT 30""")
def round_robin_diversify(spark, d):
    """W7."""
    e = load(spark, d, "embeddings").select("vec_id", "label")
    return op.round_robin(e, "label", [(F.col("vec_id") % 97).asc(), F.col("vec_id").asc()], 30)


@R.query("""WITH r AS (SELECT candidate_id, source_intent, score, row_number() OVER (PARTITION BY source_intent ORDER BY score DESC NULLS LAST, candidate_id) AS r FROM zhihu_guide_candidates WHERE status <> 'rejected')
  SELECT candidate_id, source_intent, score, r > 2 AS filled FROM r ORDER BY (r > 2)::INT, score DESC NULLS LAST, candidate_id LIMIT 25""")
def diverse_select(spark, d):
    """At most two of an intent, then the best of the rest."""
    c = load(spark, d, "zhihu_guide_candidates").where("status <> 'rejected'").select("candidate_id", "source_intent", "score")
    return op.capped_then_fill(c, "source_intent", [F.desc_nulls_last("score"), F.col("candidate_id").asc()], 2, 25)


@R.query("""WITH l AS (SELECT user_id, lower(event_type) AS k, max((event_id, event_type)) AS m FROM events GROUP BY 1, 2),
  r AS (SELECT user_id, struct_extract(m, 1) AS event_id, struct_extract(m, 2) AS event_type FROM l)
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3""")
def latest_unique_n(spark, d):
    """The last three distinct values of each key."""
    return op.latest_unique(load(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id", 3)


@R.query("""WITH x AS (SELECT vec_id * 7 % (SELECT 2 * count(*) FROM embeddings) AS id, vec_id AS pos FROM embeddings) SELECT id, min(pos) AS pos FROM x WHERE id IN (SELECT vec_id FROM embeddings WHERE label < 5) GROUP BY 1 ORDER BY 2 LIMIT 40""")
def rerank_guard(spark, d):
    """Proposed ids, of which every other one is no row, limited to candidates, once each."""
    e = load(spark, d, "embeddings")
    n = e.agg((2 * F.count(F.lit(1))).alias("n"))  # one row
    proposed = e.crossJoin(n).select((F.col("vec_id") * 7 % F.col("n")).alias("id"), F.col("vec_id").alias("pos"))
    return op.guard_output(proposed, e.where("label < 5").select(F.col("vec_id").alias("id")), "id", "pos", 40)


@R.query("""WITH t AS (SELECT trim(h.user_id, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) AS user_id, trim(x.v, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) AS value, greatest(1, floor(coalesce(h.preference, 0)::DOUBLE)::INT + 1) AS w
    FROM user_rec_history h JOIN articles a USING (article_id), unnest(string_split(a.type_tags, ',')) x(v) WHERE h.clicked AND h.ts >= TIMESTAMP '2025-10-01'),
  s AS (SELECT user_id, value, sum(w)::BIGINT AS weight FROM t WHERE user_id <> '' AND value <> '' GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, value)::INT AS rank FROM s QUALIFY rank <= 5""")
def preference_topk(spark, d):
    """Weighted type frequencies of clicked articles in a time window."""
    h = load(spark, d, "user_rec_history").where("clicked and ts >= timestamp '2025-10-01 00:00:00'").select(strip(F.col("user_id")).alias("user_id"), "article_id", F.greatest(F.lit(1), F.floor(F.coalesce(F.col("preference").cast("double"), F.lit(0.0))).cast("int") + 1).cast("bigint").alias("w"))
    tags = load(spark, d, "articles").select("article_id", F.explode(F.split("type_tags", ",")).alias("v")).select("article_id", strip(F.col("v")).alias("v")).where("v <> ''")
    return op.weighted_frequencies(h.where("user_id <> ''").join(tags, "article_id"), "user_id", F.col("v"), F.col("w"), 5)


@R.query("""SELECT article_id, title, min_pos, n FROM (SELECT title, min(article_id) AS article_id, min(created_at) AS min_pos, count(*) AS n FROM articles GROUP BY 1) ORDER BY min_pos DESC, article_id LIMIT 6""")
def recent_titles(spark, d):
    """Recent distinct titles with their frequency."""
    a = load(spark, d, "articles").groupBy("title").agg(F.min("article_id").alias("article_id"), F.min("created_at").alias("min_pos"), F.count(F.lit(1)).alias("n"))
    return a.orderBy(F.desc("min_pos"), "article_id").limit(6).select("article_id", "title", "min_pos", "n")


QUERIES, SQL = R.queries, R.sql
