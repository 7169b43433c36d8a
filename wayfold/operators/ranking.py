"""Exact ranks and islands inside groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wayfold.runtime import materialize, partitions


def _laid(df: DataFrame, keys: list[Column], order: list[Column], num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows, written in order of (keys, order) with their partition and place in it (__pid, __idx), and how many rows come before each partition (__pid, __before)."""
    n = num_partitions or partitions(df.sparkSession)
    ordered = [*[k.asc_nulls_first() for k in keys], *order]
    laid = materialize(df.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered).withColumn("__pos", F.monotonically_increasing_id()), "ranked")
    laid = laid.withColumns({"__pid": F.shiftrightunsigned("__pos", 33), "__idx": F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__pos")
    parts = laid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition: the only window without a key, bounded by num_partitions
    return laid, parts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__before"))


def distributed_islands(df: DataFrame, group: str, order: list[Column], linked: Column, num_partitions: int | None = None) -> DataFrame:
    """Add ``place`` (1, 2, ... in the whole order) and ``island``: a row belongs to the island of the row before it if both are of one group and linked.

    Like ``distributed_rank`` no group has to fit a task: neighbours are found
    inside the partitions of the order, and one row per partition tells the
    next one how its last row ends.
    """
    laid, _ = _laid(df.withColumn("__linked", F.coalesce(linked, F.lit(False))), [F.col(f"`{group}`")], order, num_partitions)
    tail = F.struct(F.col(f"`{group}`").alias("g"), F.col("__linked").alias("linked"))
    w, over = Window.partitionBy("__pid").orderBy("__idx"), Window.orderBy("__pid")  # the latter over one row per partition
    parts = laid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.max_by(tail, "__idx").alias("__last"))
    parts = parts.select("__pid", (F.sum("__n").over(over) - F.col("__n")).alias("__before"), F.lag("__last").over(over).alias("__prev"))
    near = laid.join(F.broadcast(parts), "__pid").withColumn("__near", F.coalesce(F.lag(tail).over(w), F.col("__prev")))
    goes_on = F.coalesce(F.col("__near.g").eqNullSafe(F.col(f"`{group}`")) & F.col("__near.linked") & F.col("__linked") & F.col("__near").isNotNull(), F.lit(False))
    started = near.withColumn("__start", F.when(goes_on, 0).otherwise(1)).withColumn("__own", F.sum("__start").over(w))
    starts = started.groupBy("__pid").agg(F.sum("__start").alias("__starts"))
    out = started.join(F.broadcast(starts.select("__pid", (F.sum("__starts").over(over) - F.col("__starts")).alias("__offset"))), "__pid")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__idx") + 1).alias("place"), (F.col("__offset") + F.col("__own")).alias("island"))


def distributed_rank(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1, 2, ...) inside each group of ``groups`` in the order of ``order``.

    A window would sort a whole group in one task.  Here rows are range
    partitioned by (group, order), so a hot group spreads over many
    partitions; a row's place in the whole order is its place in its partition
    plus the counts of the partitions before, and its rank is that place less
    the place at which its group starts.  Only one row per partition and one
    row per group are gathered for the offsets, the former by a prefix sum over
    as many rows as there are partitions.

    ``order`` must be total for a defined result.  Null groups are a group of
    their own; an empty table gives an empty table; other columns pass through.
    """
    keys = [F.col(f"`{g}`") for g in groups]
    laid, before = _laid(df, keys, order, num_partitions)
    placed = laid.join(F.broadcast(before), "__pid").withColumn("__at", F.col("__before") + F.col("__idx"))
    named = [k.alias(f"__g{i}") for i, k in enumerate(keys)]
    starts = placed.groupBy(*named).agg(F.min("__at").alias("__start"))
    on = None
    for i, k in enumerate(keys):
        c = k.eqNullSafe(F.col(f"__g{i}"))
        on = c if on is None else on & c
    joined = placed.join(starts, on) if on is not None else placed.crossJoin(starts)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") - F.col("__start") + 1).alias(rank))
