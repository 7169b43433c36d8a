"""Relational search: keyword, title and author lookup, fallback lists, pagination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def clamp_limit(limit: int, default: int, most: int) -> int:
    """A requested limit, or the default when not positive, at most ``most``."""
    return min(limit if limit > 0 else default, most)


def like_pattern(query: str, escape: bool = False) -> str:
    """The lower-case query as it stands in LIKE; its % and _ are wildcards unless escaped."""
    q = query.strip().lower()
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else q


def match_rank(text: Column, query: str) -> Column:
    """0 equal, 1 prefix, 2 contained, null for no match."""
    q, t = like_pattern(query), F.lower(F.coalesce(text, F.lit("")))
    return F.when(t == query.strip().lower(), 0).when(t.like(q + "%"), 1).when(t.like("%" + q + "%"), 2)


def keyword_search(articles: DataFrame, chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Articles whose title, tags or a chunk contain the query, with their best chunk.

    The best chunk is found by an aggregation (min of an ordering struct) over
    matching chunks, so only matches are shuffled and no chunk list is sorted.
    A blank query gives no row; null fields count as empty.
    """
    q, n = like_pattern(query), clamp_limit(limit, 10, 50)
    holds = lambda c: F.lower(F.coalesce(c, F.lit(""))).like(f"%{q}%")
    hit = chunks.where(holds("h2") | holds("content"))
    # newest first, then the highest chunk_id: max_by on negated rank and positive keys
    best = hit.groupBy("article_id").agg(F.max(F.struct((-F.coalesce(match_rank(F.col("h2"), query), F.lit(2))).alias("r"), F.unix_micros("created_at").alias("t"), "chunk_id", "h2", "content")).alias("b"))
    joined = articles.join(best, "article_id", "left")
    keep = holds("title") | holds("type_tags") | holds("tags") | F.col("b").isNotNull()
    rank = F.when(F.lower(F.coalesce("title", F.lit(""))) == query.strip().lower(), 0).when(F.lower(F.coalesce("title", F.lit(""))).like(q + "%"), 1)
    rank = rank.when(holds("type_tags"), 2).when(holds("tags"), 3).otherwise(4)
    blank = lambda c, a: F.coalesce(c, F.lit("")).alias(a)
    out = joined.where(keep & F.lit(bool(query.strip()))).withColumn("rank", rank)
    out = out.orderBy("rank", F.desc_nulls_last("score"), F.desc("created_at"), F.desc("article_id")).limit(n)
    return out.select("article_id", blank(F.col("title"), "title"), blank(F.col("type_tags"), "type_tags"), blank(F.col("tags"), "tags"), "score", blank(F.col("b.chunk_id"), "chunk_id"), blank(F.col("b.h2"), "h2"))


def latest_per_group(df: DataFrame, group: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each group, and the group's size (W1, W2): one aggregation, combined before the shuffle."""
    return df.groupBy(group).agg(F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("m"), F.count(F.lit(1)).alias("n")).select(group, *[F.col(f"m.{c}").alias(c) for c in keep], "n")


def keyset_page(df: DataFrame, key: str, tie: str, cursor: str | tuple | None, limit: int = 20) -> DataFrame:
    """The page after ``cursor``, newest first; ``has_more`` tells whether another follows.

    A cursor is the (key, tie) of the last row seen, so that rows of one key
    on both sides of a page's end are all seen once; a key alone leaves out
    all rows of that key.
    """
    n = clamp_limit(limit, 20, 50)
    rows = df
    if cursor is not None:
        at = cursor if isinstance(cursor, tuple) else (cursor,)
        last = [F.lit(v).cast(df.schema[c].dataType) for v, c in zip(at, (key, tie))]
        after = F.col(key) < last[0]
        # the first bound alone reaches the scan
        rows = df.where(after if len(last) == 1 else (F.col(key) <= last[0]) & (after | (F.col(tie) < last[1])))
    page = rows.orderBy(F.desc(key), F.desc(tie)).limit(n + 1)
    w = Window.orderBy(F.desc(key), F.desc(tie))  # at most n + 1 rows
    return page.withColumn("pos", F.row_number().over(w)).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > n).where(F.col("pos") <= n)


def include_exclude(df: DataFrame, column: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows whose value is in ``include`` (if any is named) and not in ``exclude``; blanks in the lists are dropped."""
    inc, exc = ([x.strip() for x in v if x and x.strip()] for v in (include, exclude))
    out = df.where(F.col(column).isin(inc)) if inc else df
    return out.where(~F.col(column).isin(exc)) if exc else out


def filter_expression(column: str, include: list[str], exclude: list[str]) -> str:
    """The same filter as text for a vector store."""
    quoted = lambda v: ",".join('"' + x.strip().replace("\\", "\\\\").replace('"', '\\"') + '"' for x in v if x and x.strip())
    parts = [f"({column} in [{quoted(include)}])"] if quoted(include) else []
    parts += [f"({column} not in [{quoted(exclude)}])"] if quoted(exclude) else []
    return " and ".join(parts)
