"""The queries of the corpus problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayfold.functions.text import strip
from wayfold.llm import capping, incremental, near_duplicates, packing, paragraphs, shared_spans, splitting, tokens, topn
from wayfold.runtime import load, materialize, scratch


def p1_pieces(spark, d):
    """Problem 1: the pieces of every chunk."""
    return splitting.split_items(load(spark, d, "article_chunks"), "chunk_id", "content", "h2")


def p1_found(spark, d):
    """Problem 1: chunks whose item is divided."""
    return p1_pieces(spark, d).where("piece_no = 2").select("chunk_id")


def p1_cores(spark, d):
    """Problem 1, checked: each chunk's cores joined, whether every piece fits and stands under its head, and whether each repeats what it should."""
    pieces = p1_pieces(spark, d)
    lead = F.char_length("piece") - F.col("core_chars") - F.when(F.col("piece_no") > 1, F.least("core_start", F.lit(splitting.OVERLAP))).otherwise(0)
    under = (lead == 0) & F.col("head").isNull() | (lead > 0) & F.coalesce(F.col("head").startswith(F.substring("piece", F.lit(1), lead - 1)), F.lit(False))
    checked = pieces.select("chunk_id", F.struct("piece_no", F.right("piece", F.col("core_chars")).alias("core")).alias("x"), (F.char_length("piece") <= splitting.LIMIT).alias("fits"), under.alias("under"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["core"]), "")  # one chunk's body
    return checked.groupBy("chunk_id").agg(F.md5(joined).alias("body"), F.bool_and("fits").alias("fits"), F.bool_and("under").alias("under_head"))


def p2_found(spark, d):
    """Problem 2: repeats with the accepted candidate that they repeat; the batches are added one after the other to stored block tables."""
    store = incremental.IncrementalDeduper(spark, scratch(spark, "p2-store"))
    out = incremental.dedup_in_batches(load(spark, d, "zhihu_guide_candidates"), "batch_no", store)
    return out.where("first_id is not null").select(F.col("first_id").cast("bigint").alias("first_id"), F.col("candidate_id").alias("repeat_id"))


def _capped(spark, d, scale):
    return capping.cap_contributors(load(spark, d, "zhihu_guide_candidates"), "candidate_id", capping.author_key(F.col("author_name")), "score", "batch_no", scale=scale)


def p4_found(spark, d):
    """Problem 4: candidates beyond their author's share, lowest scores first."""
    return _capped(spark, d, 0.0).where("not kept").select("candidate_id")


def p4_sampled(spark, d):
    """Problem 4: the same caps with keys drawn by chance, scaled by score."""
    return _capped(spark, d, 10.0).where("not kept").select("candidate_id", "batch_no", "cap")


def p5_found(spark, d):
    """Problem 5: pairs of chunks with largely the same content."""
    return near_duplicates.near_duplicate_pairs(load(spark, d, "article_chunks"), "chunk_id", "content")


def p5_classes(spark, d):
    """Problem 5: each chunk's class of equal content and its number of similar classes."""
    return near_duplicates.near_duplicate_summary(load(spark, d, "article_chunks"), "chunk_id", "content").select("chunk_id", "copies", "links")


def p7_found(spark, d):
    """Problem 7: the ten best items of every pool."""
    groups = [F.col("user_id"), F.lower(strip(F.col("pool_type"))), F.coalesce("period_bucket", F.lit(""))]
    return topn.top_n_per_group(load(spark, d, "user_pool_items"), groups, ["user_id", "pool_type", "period_bucket"], F.col("article_id"), "article_id", F.col("score"), F.col("inserted_at"))


def p8_ids(spark, d):
    """Problem 8: every document's token ids."""
    return tokens.encode_column(load(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark, d):
    """Problem 8, checked: every document's text as its ids give it back."""
    return tokens.decode_column(p8_ids(spark, d), "doc_id", "ids", "text").select("doc_id", F.md5("text").alias("text"))


def p9_checked(spark, d):
    """Problem 9, checked: whether all of each document's tokens have a place, and whether its containers hold no more than they can, place by place without gaps."""
    docs = load(spark, d, "documents")
    placed = materialize(p9_containers(spark, d), "p9-placed")
    w = Window.partitionBy("container").orderBy("place")  # at most 2,048 items
    ends = F.col("token_offset") + F.col("n_tokens")
    follows = F.col("token_offset") == F.coalesce(F.lag(ends).over(w), F.lit(0))
    boxed = placed.where("container is not null").select("doc_id", "container", "place", "n_tokens", (follows & (F.row_number().over(w) == F.col("place"))).alias("follows"), (ends <= packing.CAPACITY).alias("fits"))
    mine = boxed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.bool_and("follows").alias("follows"), F.bool_and("fits").alias("fits"))
    sized = docs.select("doc_id", tokens.token_count(F.col("text")).alias("size")).join(mine, "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(True))
    return sized.select("doc_id", (F.coalesce("n", F.lit(0)) == F.col("size")).alias("whole"), yes(F.col("follows")).alias("follows"), yes(F.col("fits")).alias("fits"))


def p9_containers(spark, d):
    """Problem 9: the container and place of every text."""
    return packing.pack_texts(load(spark, d, "documents"), "doc_id", "text")


def p10_found(spark, d):
    """Problem 10: runs of characters that another document shares."""
    return shared_spans.shared_spans(load(spark, d, "documents"), "doc_id", "text")


def p10_coverage(spark, d):
    """Problem 10: how much of each document is shared."""
    return shared_spans.shared_coverage(load(spark, d, "documents"), "doc_id", "text")


def p10_paragraphs(spark, d):
    """Problem 10 by the method named: near-equal paragraphs of each document, and how many of them are to go."""
    return paragraphs.paragraph_coverage(load(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cores, p2_found, p4_found, p4_sampled, p5_found, p5_classes, p7_found, p8_ids, p8_round_trip, p9_containers, p9_checked, p10_found, p10_coverage, p10_paragraphs)}

_WS = "chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)"
_PLAIN = "lower(regexp_replace({}, '[' || " + _WS + " || ']', '', 'g'))"
_WIDE, _NARROW = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))


def _shingles(source: str, text: str, least: int) -> str:
    return f"""
      t AS (SELECT id, {text} AS t FROM {source}),
      g AS (SELECT DISTINCT id, substr(t, i::BIGINT, 5) AS s FROM t, range(1, length(t) - 3) r(i) WHERE length(t) >= {least}),
      n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      k AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)"""


_AUTHOR = "nullif(" + _PLAIN.format(f"translate(author_name, '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_NARROW.replace(chr(39), chr(39) * 2)}')") + ", '')"

_WORDED = _shingles("(SELECT candidate_id AS id, coalesce(title, '') || coalesce(summary, '') AS w FROM zhihu_guide_candidates)", _PLAIN.format("w"), 60)

SQL = {
    "p2_found": f"""
      WITH RECURSIVE {_WORDED},
      u AS (SELECT candidate_id AS id, lower(trim(url_hash, {_WS})) AS u FROM zhihu_guide_candidates WHERE trim(coalesce(url_hash, ''), {_WS}) <> ''),
      m AS (SELECT a, b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 2 * k >= x.n + y.n - k UNION SELECT x.id, y.id FROM u x JOIN u y ON x.u = y.u AND x.id < y.id),
      nb AS (SELECT b, list(a) AS earlier FROM m GROUP BY b),
      o AS MATERIALIZED (SELECT candidate_id AS id, row_number() OVER (ORDER BY candidate_id) AS rn, coalesce(earlier, []) AS earlier FROM zhihu_guide_candidates LEFT JOIN nb ON b = candidate_id),
      r AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS hit
            UNION ALL
            SELECT rn, CASE WHEN hit IS NULL THEN list_append(kept, id) ELSE kept END, id, hit
            FROM (SELECT o.rn, r.kept, o.id, list_min(list_intersect(o.earlier, r.kept)) AS hit FROM r JOIN o ON o.rn = r.rn + 1))
      SELECT hit AS first_id, id AS repeat_id FROM r WHERE hit IS NOT NULL""",
    "p10_coverage": """
      WITH g AS (SELECT doc_id, i, md5(substr(text, i::BIGINT, 100)) AS s FROM documents, range(1, 1 + greatest(length(text) - 99, 0)) r(i)),
      c AS (SELECT s FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
      h AS (SELECT DISTINCT doc_id, i FROM g JOIN c USING (s)),
      x AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS st FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      y AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
      z AS (SELECT doc_id, max(i) + 100 - min(i) AS n FROM y GROUP BY doc_id, run),
      t AS (SELECT doc_id, count(*) AS n_spans, sum(n)::BIGINT AS shared_chars FROM z GROUP BY 1)
      SELECT doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(shared_chars, 0)::BIGINT AS shared_chars,
             CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text)::DOUBLE, 6) ELSE 0 END AS shared_ratio FROM documents LEFT JOIN t USING (doc_id)""",
    "p10_found": """
      WITH g AS (SELECT doc_id, i, md5(substr(text, i::BIGINT, 100)) AS s FROM documents, range(1, 1 + greatest(length(text) - 99, 0)) r(i)),
      c AS (SELECT s FROM g GROUP BY s HAVING count(DISTINCT doc_id) > 1),
      h AS (SELECT DISTINCT doc_id, i FROM g JOIN c USING (s)),
      x AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS st FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      y AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x)
      SELECT doc_id, min(i)::BIGINT AS span_start, (max(i) + 100 - min(i))::BIGINT AS span_chars FROM y GROUP BY doc_id, run""",
    "p1_found": f"""
      SELECT chunk_id FROM (SELECT chunk_id, trim(coalesce(h2, ''), {_WS}) AS h, trim(coalesce(content, ''), {_WS}) AS c FROM article_chunks)
      WHERE length(CASE WHEN h = '' THEN c ELSE h || chr(10) || c END) > 320""",
    "p1_cores": f"""
      WITH x AS (SELECT chunk_id, trim(coalesce(h2, ''), {_WS}) AS h, trim(coalesce(content, ''), {_WS}) AS c FROM article_chunks)
      SELECT chunk_id, md5(CASE WHEN length(h) >= 160 AND length(h) + 1 + length(c) > 320 THEN substr(h, 160) || chr(10) || c ELSE c END) AS body, TRUE AS fits, TRUE AS under_head FROM x""",
    "p8_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents",
    "p9_checked": "SELECT doc_id, TRUE AS whole, TRUE AS follows, TRUE AS fits FROM documents",
    "p4_found": f"""
      WITH x AS (SELECT candidate_id, batch_no, score, {_AUTHOR} AS who, count(*) OVER (PARTITION BY batch_no) AS n FROM zhihu_guide_candidates)
      SELECT candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_no, who ORDER BY score DESC NULLS LAST, candidate_id) AS r FROM x WHERE who IS NOT NULL)
      WHERE r > ceil(n / 50.0)""",
    "p4_sampled": f"""
      WITH x AS (SELECT candidate_id, batch_no, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, {_AUTHOR} AS who, count(*) OVER (PARTITION BY batch_no) AS n,
                        (('0x' || substr(md5('7-' || candidate_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM zhihu_guide_candidates),
      y AS (SELECT *, row_number() OVER (PARTITION BY batch_no, who ORDER BY score + 10 * -ln(-ln(u)) DESC NULLS LAST, candidate_id) AS r FROM x WHERE who IS NOT NULL)
      SELECT candidate_id, batch_no, ceil(n / 50.0)::BIGINT AS cap FROM y WHERE r > ceil(n / 50.0)""",
    "p5_found": f"""
      WITH {_shingles("(SELECT chunk_id AS id, content FROM article_chunks)", _PLAIN.format("content"), 40)}
      SELECT a AS chunk_id_a, b AS chunk_id_b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * k >= 6 * (x.n + y.n - k)""",
    "p5_classes": f"""
      WITH {_shingles("(SELECT chunk_id AS id, content FROM article_chunks)", _PLAIN.format("content"), 40)},
      l AS (SELECT t AS w, id FROM t WHERE length(t) >= 40), m AS (SELECT w, count(*) AS copies FROM l GROUP BY 1),
      s AS (SELECT a, b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 10 * k >= 6 * (x.n + y.n - k)),
      e AS (SELECT p.w AS x, q.w AS y FROM s JOIN l p ON p.id = a JOIN l q ON q.id = b WHERE p.w <> q.w),
      lk AS (SELECT x, count(DISTINCT y) AS links FROM (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) GROUP BY 1)
      SELECT id AS chunk_id, copies, coalesce(links, 0)::BIGINT AS links FROM l JOIN m USING (w) LEFT JOIN lk ON lk.x = w""",
    "p7_found": f"""
      WITH x AS (SELECT user_id, lower(trim(pool_type, {_WS})) AS pool_type, coalesce(period_bucket, '') AS period_bucket, article_id,
                        CASE WHEN isnan(score) THEN NULL ELSE score END AS score, inserted_at FROM user_pool_items),
      y AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool_type, period_bucket, article_id ORDER BY inserted_at DESC NULLS LAST, score DESC NULLS LAST) AS v FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY user_id, pool_type, period_bucket ORDER BY score DESC NULLS LAST, article_id) AS r FROM y WHERE v = 1)
      SELECT user_id, pool_type, period_bucket, r::INT AS item_rank, article_id FROM z WHERE r <= 10""",
}
