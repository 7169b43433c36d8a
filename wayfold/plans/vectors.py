"""Vector queries over the embeddings; the query vectors of a search are those whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayfold.functions.text import nonblank
from wayfold.operators import lexical, vectors as op
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
WIDTH = 64
_ALL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0)"
_SIM = "round(list_cosine_similarity(q.v, e.v), 5)"


def stored(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def queries(spark, d):
    return stored(spark, d).where("id % 50 = 0")


@R.query(f"WITH {_ALL} SELECT q.vec_id AS a, e.vec_id AS b, {_SIM} AS cosine FROM e q JOIN e ON e.vec_id = q.vec_id + 1")
def cosine(spark, d):
    """Cosine of each vector and its successor, inside the JVM."""
    a, b = stored(spark, d).toDF("a", "va", "la"), stored(spark, d).toDF("b", "vb", "lb")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(op.cosine(F.col("va"), F.col("vb")), 5).alias("cosine"))


_TOP = f"SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.v, e.v), 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.v), 9) DESC, e.vec_id) AS rank FROM q JOIN e ON e.vec_id <> q.vec_id"


@R.query(f"WITH {_ALL}, t AS ({_TOP}) SELECT query_id, id, round(s, 5) AS score, rank::INT AS rank FROM t WHERE rank <= 10")
def vector_topk(spark, d):
    """Exact nearest vectors of the stated queries, in blocks."""
    return op.top_k(queries(spark, d), stored(spark, d), 10, WIDTH).withColumn("score", F.round("score", 5))


@R.query(f"WITH {_ALL}, t AS ({_TOP} WHERE e.label IN (1, 2, 3)) SELECT query_id, id, round(s, 5) AS score, rank::INT AS rank FROM t WHERE rank <= 5")
def vector_topk_filtered(spark, d):
    """The scalar filter comes before the similarity."""
    return op.top_k(queries(spark, d), stored(spark, d).where("label in (1, 2, 3)"), 5, WIDTH).withColumn("score", F.round("score", 5))


@R.query(f"WITH {_ALL.replace(' WHERE vec_id % 50 = 0', '')}, t AS ({_TOP}) SELECT query_id, id, round(s, 5) AS score, rank::INT AS rank FROM t WHERE rank <= 8 AND s >= 0.3")
def similar_edges(spark, d):
    """SIMILAR edges of every vector above a threshold, at most eight of a vector."""
    return op.similar_pairs(stored(spark, d), 8, WIDTH, 0.3).withColumn("score", F.round("score", 5))


@R.query()
def vector_topk_indexed(spark, d):
    """The same search by an inverted-file index that probes seven of ten lists (recall is measured in the tests)."""
    s = stored(spark, d)
    index = op.InvertedFile.fit(s, WIDTH)
    return index.search(queries(spark, d), s, 10, probes=-(-7 * len(index.centres) // 10)).withColumn("score", F.round("score", 5))


_EDGE = "g AS (SELECT vec_id AS src, vec_id + i AS dst, 1.0 / i AS weight FROM embeddings, range(1, 13) r(i) WHERE vec_id + i < (SELECT count(*) FROM embeddings))"


@R.query(f"""WITH {_EDGE}, s AS (SELECT vec_id AS id, 1.0 / (1 + vec_id) AS score FROM embeddings WHERE vec_id % 50 = 0),
  n AS (SELECT dst AS id, score * weight * 0.8 AS score FROM g JOIN s ON src = id QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 8)
  SELECT id, round(max(score), 6) AS score FROM (SELECT id, score FROM s UNION ALL SELECT * FROM n) GROUP BY 1""")
def graph_expand(spark, d):
    """Seeds and their neighbours, the best score of each."""
    e = load(spark, d, "embeddings").select("vec_id")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    edges = e.select(F.col("vec_id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i")).crossJoin(total).where("src + i < total").select("src", (F.col("src") + F.col("i")).alias("dst"), (1.0 / F.col("i")).alias("weight"))
    seeds = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), (1.0 / (1 + F.col("vec_id"))).alias("score"))
    return op.expand(seeds, edges, 8, 0.8).withColumn("score", F.round("score", 6))


_GRAMS = r"flatten(list_transform(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^0-9a-z\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}]+'), lambda r: r <> ''), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"
_BM25 = f"""
  dt AS (SELECT doc_id AS id, {_GRAMS.format('text')} AS t FROM documents), d AS (SELECT id, len(t) AS n, t FROM dt WHERE len(t) > 0), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM d),
  qt AS (SELECT DISTINCT doc_id AS query_id, unnest({_GRAMS.format('title')}) AS term FROM documents WHERE doc_id % 50 = 0),
  tf AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  sp AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS s FROM tf JOIN df USING (term) JOIN qt USING (term), st WHERE id <> query_id GROUP BY 1, 2)"""


@R.query(f"WITH {_BM25} SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank FROM sp QUALIFY rank <= 20")
def term_search(spark, d):
    """The sparse side alone, BM25 of the titles of the stated queries over all texts."""
    return _sparse(spark, d, 20).withColumn("score", F.round("score", 6))


def _sparse(spark, d, k):
    docs = load(spark, d, "documents")
    return lexical.bm25(docs.select(F.col("doc_id").alias("id"), "text"), docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text")), k)


@R.query(f"""WITH {_ALL}, {_BM25}, t AS ({_TOP}), s1 AS (SELECT query_id, id, 0.5 * (1 + s) / 2 AS s FROM t WHERE rank <= 20),
  s2 AS (SELECT query_id, id, atan(s) / pi() AS s FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 20),
  r AS (SELECT query_id, id, round(sum(s), 6) AS score FROM (FROM s1 UNION ALL FROM s2) GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r QUALIFY rank <= 20""")
def hybrid_search(spark, d):
    """The best of the dense search and of the term search of every stated query, normalised, weighted and ranked."""
    dense = op.top_k(queries(spark, d), stored(spark, d), 20, WIDTH).select("query_id", "id", "score")
    return op.hybrid(dense, _sparse(spark, d, 20).select("query_id", "id", "score"), 20)


@R.query("""SELECT vec_id AS article_id, cl, rank::INT AS rank FROM (SELECT vec_id, label AS cl, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 3""")
def top_per_label(spark, d):
    """The three rows of each label with the largest first coordinate, by a bounded rank."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("label").alias("cl"), F.col("embedding")[0].alias("s"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("cl").orderBy(F.desc("s"), "article_id"))).where("rank <= 3").drop("s")


@R.query(f"""WITH {_ALL}, t AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label AS cl, round(list_cosine_similarity(q.v, e.v), 9) AS s FROM q JOIN e ON e.vec_id <> q.vec_id),
  g AS (SELECT DISTINCT query_id, cl FROM (SELECT query_id, cl FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5)),
  f AS (SELECT t.*, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM t SEMI JOIN g USING (query_id, cl))
  SELECT query_id, id, cl, round(s, 5) AS score, rank::INT AS rank, title, source, text AS content FROM f JOIN documents ON doc_id = id WHERE rank <= 10 AND trim(text, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) <> ''""")
def coarse_fine_recall(spark, d):
    """Groups of the rows nearest to each stated query, the nearest rows inside these groups, and their content and metadata; hits without content are left out, the others keep their rank."""
    s = stored(spark, d).withColumnRenamed("label", "cl")
    hits = op.coarse_fine(queries(spark, d), s, "cl", 5, 10, WIDTH).join(s.select("id", "cl"), "id")
    content = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "title", "source", F.col("text").alias("content")).where(nonblank(F.col("content")).isNotNull())
    return hits.join(content, "id").select("query_id", "id", "cl", F.round("score", 5).alias("score"), "rank", "title", "source", "content")


QUERIES, SQL = R.queries, R.sql
