"""Rank fusion, multi-query merging, pools and diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def rank_score(rank: Column, total: Column) -> Column:
    """1 for the first of several, 0 for the last, linear between; 1 if alone, 0 if invalid."""
    valid = (rank > 0) & (total > 0)
    return F.when(valid & (total == 1), 1.0).when(valid, 1 - (rank - 1) / F.nullif(total - 1, F.lit(0)).cast("double")).otherwise(0.0)


def fuse(hits: DataFrame, coarse: Column, fine: Column, rerank: Column, support: Column, bonus: float = 0.05) -> Column:
    """.25 coarse + .35 fine + .40 rerank (in 0..1), and a bonus of at most .10 for further support."""
    unit = F.least(F.greatest(F.coalesce(rerank, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return 0.25 * coarse + 0.35 * fine + 0.40 * unit + F.least(F.lit(0.10), (support - 1) * bonus)


def merge_queries(hits: DataFrame, key: str, score: str, order: list[str]) -> DataFrame:
    """The best hit of each key over several queries, and in how many it occurred (A10, A11); the first wins a tie."""
    best = F.max_by(F.struct(score, *order), F.struct(F.col(score), *[-F.col(c) for c in order]))
    return hits.groupBy(key).agg(best.alias("m"), F.count(F.lit(1)).alias("support")).select(key, F.col("m")[score].alias(score), *[F.col("m")[c].alias(c) for c in order], "support")


def first_seen(lists: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Union of ordered lists with each key at its first place (O13): (key, source, pos)."""
    out = None
    for i, df in enumerate(lists):
        part = df.select(key, F.lit(i).alias("source"), F.struct(*order).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min(F.struct("source", "pos")).alias("m")).select(key, "m.source", "m.pos")


def capped_then_fill(df: DataFrame, group: str, order: list[Column], per_group: int, limit: int) -> DataFrame:
    """At most ``per_group`` of each group in order, then the rest in order, up to ``limit``.

    Only the first ``limit`` rows of each group can be taken, so the ranking
    window keeps no more, and the final choice is a top-k.
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit)
    return ranked.orderBy((F.col("__r") > per_group).cast("int"), *order).limit(limit).withColumn("filled", F.col("__r") > per_group).drop("__r")


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """One of each group in turn, with its ``turn``; in every turn the groups come in the order of their first rows.

    Only the first ``limit`` rows of a group and the groups of the ``limit``
    best first rows can be taken: the window keeps no more of a group, and the
    number of groups that are ordered is bounded before they are joined.
    """
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    first = ranked.where("turn = 1").orderBy(*order).limit(limit)
    place = first.withColumn("__place", F.row_number().over(Window.orderBy(*order))).select(F.col(group).alias("__g"), "__place")  # at most ``limit`` rows
    return ranked.join(F.broadcast(place), F.col(group).eqNullSafe(F.col("__g"))).orderBy("turn", "__place").limit(limit).drop("__g", "__place")


def latest_unique(df: DataFrame, group: str, value: str, pos: str, n: int) -> DataFrame:
    """The last n distinct values (compared without case and outer space), in order of their last occurrence."""
    key = F.lower(F.trim(value))
    last = df.where(key != "").groupBy(group, key.alias("__k")).agg(F.max(F.struct(pos, value)).alias("m")).select(group, f"m.{pos}", f"m.{value}")
    kept = last.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(pos)))).where(F.col("__r") <= n)
    return kept.drop("__r")


def guard_output(proposed: DataFrame, candidates: DataFrame, key: str, pos: str, k: int) -> DataFrame:
    """Proposed ids that are candidates, each once at its first place, the first k."""
    known = proposed.join(candidates.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(pos).alias(pos))
    return known.orderBy(pos).limit(k)


def weighted_frequencies(df: DataFrame, group: str, value: Column, weight: Column, k: int) -> DataFrame:
    """The k heaviest values of each group, ties by value (A13): (group, value, weight, rank)."""
    sums = df.select(group, value.alias("value"), weight.alias("w")).groupBy(group, "value").agg(F.sum("w").alias("weight"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "value"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k)
