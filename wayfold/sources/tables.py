"""Schemas of the relational and vector tables, their creation, and document ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayfold.functions.content import image_chunk, image_groups
from wayfold.functions.strings import chunk_text, keyword_pieces, uuid5_url
from wayfold.functions.text import is_blank
from wayfold.operators.markdown import parse_column
from wayfold.sources.services import Embedder, embed_column

#: Tables with their columns.
SCHEMAS = {
    "articles": "article_id string, title string, cover string, type_tags string, tags string, score float, created_at timestamp",
    "article_chunks": "chunk_id string, article_id string, h2 string, content string, created_at timestamp",
    "user_pool_items": "user_id string, pool_type string, period_bucket string, article_id string, score float, similarity float, remark_score float, inserted_at timestamp",
    "user_rec_history": "history_id string, user_id string, article_id string, clicked boolean, preference float, ts timestamp",
    "user_memory": "user_id string, memory_type string, period_bucket string, content string, updated_at timestamp",
    "user_memory_chunks": "user_id string, memory_type string, period_bucket string, chunk_index int, content string, updated_at timestamp",
    "reco_request_logs": "rec_request_id string, user_id string, session_id string, surface string, query string, status string, returned_count int, candidate_count int, created_at timestamp",
    "reco_event_logs": "id bigint, rec_request_id string, user_id string, session_id string, surface string, article_id string, rank int, event_type string, event_ts timestamp, metadata string",
    "reco_eval_cases": "case_id string, query string, surface string, bucket string",
    "reco_eval_labels": "case_id string, article_id string, relevance float",
    "reco_eval_runs": "run_id string, case_count int, metrics string",
    "recall_coarse": "id string, vector array<float>, article_id string, score float, tags string, created_at_unix bigint",
    "recall_image": "id string, vector array<float>, article_id string, chunk_id string, h2 string, document string, tags string, score float, created_at_unix bigint",
    "recall_fine": "id string, vector array<float>, article_id string, chunk_id string, h2 string, document string, tags string, score float, created_at_unix bigint",
}


def create_tables(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the tables that don't exist; the large ones are bucketed by the key that they are joined on."""
    bucket = {"article_chunks": "article_id", "user_rec_history": "user_id", "user_pool_items": "user_id", "recall_fine": "article_id"}
    for name, cols in SCHEMAS.items():
        by = f" CLUSTERED BY ({bucket[name]}) INTO 64 BUCKETS" if name in bucket else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({cols}) USING parquet{by}")
    return [prefix + n for n in SCHEMAS]


def ingest(docs: DataFrame, embedder: Embedder | None = None, image_embedder: Embedder | None = None) -> dict[str, DataFrame]:
    """Markdown documents (article_id, title, markdown, tags, created_at) as articles, chunks and vectors of texts and images.

    Blank ids or texts are dropped.  One pass parses the text; chunks have
    name-based ids, so that ingesting again gives the same rows.
    """
    good = docs.where(~is_blank(F.col("article_id")) & ~is_blank(F.col("markdown")))
    parsed = good.withColumn("a", parse_column(F.col("markdown"), F.coalesce("title", F.lit(""))))
    articles = parsed.select("article_id", F.col("a.title").alias("title"), F.lit("").alias("cover"), F.lit("").alias("type_tags"), F.coalesce("tags", F.lit("")).alias("tags"), F.lit(0.0).cast("float").alias("score"), "created_at", F.slice(keyword_pieces(F.col("a.title")), 1, 10).alias("keywords"))
    sections = parsed.select("article_id", "created_at", F.posexplode("a.sections").alias("s_no", "s"))
    body = F.array_join(F.transform(F.filter("s.blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    chunks = sections.select("article_id", "created_at", "s_no", F.col("s.h2").alias("h2"), F.posexplode(chunk_text(body)).alias("c_no", "content"))
    chunks = chunks.withColumn("chunk_id", F.concat(F.lit("chk_"), uuid5_url("chunk", F.concat_ws("|", "article_id", "s_no", "c_no"))))
    fine = chunks.select(F.col("chunk_id").alias("id"), embed_column(F.col("content"), embedder).alias("vector"), "article_id", "chunk_id", "h2", F.col("content").alias("document"))
    coarse = articles.select(F.col("article_id").alias("id"), embed_column(F.concat_ws("\n", "title", "tags"), embedder).alias("vector"), "article_id", "score", "tags", F.unix_timestamp("created_at").alias("created_at_unix"))
    # runs of images are chunks of their own, with vectors in a table of their own
    runs = sections.select("article_id", "s_no", F.col("s.h2").alias("h2"), F.posexplode(image_groups(F.col("s.blocks"))).alias("g_no", "urls")).withColumn("c", image_chunk(F.col("urls")))
    runs = runs.withColumn("chunk_id", F.concat(F.lit("chk_"), uuid5_url("chunk", F.concat_ws("|", "article_id", "s_no", F.concat(F.lit("image"), "g_no"), F.array_join("urls", "|")))))
    images = runs.select(F.col("chunk_id").alias("id"), embed_column(F.col("c.content"), image_embedder or embedder).alias("vector"), "article_id", "chunk_id", "h2", F.col("c.content").alias("document"), F.col("c.content_type").alias("content_type"))
    return {"recall_image": images, "articles": articles, "article_chunks": chunks.select("chunk_id", "article_id", "h2", "content", "created_at"), "recall_fine": fine, "recall_coarse": coarse}
