"""Problem 6: one row of counts, recency and totals per entity, for hundreds of event types.

Method: event types are partitioned into blocks; every block is stored in a
folder of its own, bucketed by entity; a block is read from its folder once,
aggregated by entity in place, and the co-bucketed blocks are joined onto the
complete entity table without a further shuffle of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfold.functions.text import nonblank
from wayfold.runtime import materialize_buckets, partitions

#: Types in a block: wide enough for few joins, narrow enough for one generated aggregation.
BLOCK_TYPES = 32
#: The type table is fixed; beyond so many rows it isn't broadcast, and features of more names are refused with an error.
MAX_TYPES = 10_000


def typed_events(history: DataFrame, types: DataFrame) -> DataFrame:
    """(user_id, event_type, ts, preference): distinct events that have a type.

    Rows equal in stripped user_id, article_id and ts are one event; of those
    that differ in their flag or preference the smallest (null first) counts.
    Events with null or blank user_id, of no type, or with a null flag or
    preference are left out.  The shuffle is by all three columns, so an entity
    with a third of the rows is spread.
    """
    rows = history.select(nonblank(F.col("user_id")).alias("user_id"), "article_id", "ts", F.struct("clicked", "preference").alias("x")).where("user_id is not null")
    once = rows.groupBy("user_id", "article_id", "ts").agg(F.min("x").alias("x")).select("user_id", "ts", "x.*")
    tenths = F.round(F.col("preference").cast("double") * 10).try_cast("int")
    known = types.select("event_type", F.col("clicked").alias("type_clicked"), "pref_tenths").dropDuplicates(["type_clicked", "pref_tenths"])
    if known.limit(MAX_TYPES + 1).count() <= MAX_TYPES:
        known = F.broadcast(known)
    return once.withColumn("tenths", tenths).join(known, (F.col("clicked") == F.col("type_clicked")) & (F.col("tenths") == F.col("pref_tenths"))).select("user_id", "event_type", "ts", F.col("preference").cast("double").alias("preference"))


def entity_blocks(events: DataFrame, type_names: list[str], block: int = BLOCK_TYPES) -> list[DataFrame]:
    """One (user_id, block) for each block of types; block maps a type's number to its (n, last, total).

    Events are first summed by (user_id, event_type), partly before they are
    shuffled; after that an entity has at most one row for each type.  The sums
    are written once, by block and bucketed by entity: a block reads its own
    folder, and neither its aggregation nor its joins shuffle it again.
    """
    spark = events.sparkSession
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(type_names)], "event_type string, number int")
    sums = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.sum("preference").alias("total"))
    sums = sums.join(F.broadcast(numbers), "event_type").select("user_id", "number", "n", "last", "total", F.floor(F.col("number") / block).cast("int").alias("block"))  # at most MAX_TYPES names
    stored = materialize_buckets(sums, "p6-sums", "block", "user_id", partitions(spark))
    entry = F.struct(F.col("number").alias("key"), F.struct("n", "last", "total").alias("value"))
    return [stored.where(F.col("block") == k).groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("block")) for k in range(-(-len(type_names) // block))]


def _joined(history: DataFrame, types: DataFrame, block: int) -> tuple[DataFrame, list[str], list[str]]:
    names = [r[0] for r in types.select("event_type").where("event_type is not null").distinct().orderBy("event_type").limit(MAX_TYPES + 1).collect()]
    if len(names) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    table = history.select(nonblank(F.col("user_id")).alias("user_id")).where("user_id is not null").distinct()
    cols = []
    for k, b in enumerate(entity_blocks(typed_events(history, types), names, block)):
        table = table.join(b.withColumnRenamed("block", f"block_{k}"), "user_id", "left")
        cols.append(f"block_{k}")
    return table, names, cols


def _days(last: Column, as_of: str) -> Column:
    return F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(last)) / 86_400_000_000).cast("bigint")


def feature_table(history: DataFrame, types: DataFrame, as_of: str = "2026-01-01 00:00:00", block: int = BLOCK_TYPES) -> DataFrame:
    """(user_id, n_events, days_since_last, totals): one row per entity, each an array over all types by name.

    Every entity of the history with a nonblank user_id has a row; a type that
    it has no event of has count 0, days null and total 0.  Days are the whole
    days from the last event to ``as_of``.  Types with a null name or equal
    flag and tenths are taken once.  An empty history gives no row.
    """
    table, names, cols = _joined(history, types, block)
    parts: dict[str, list[Column]] = {"n": [], "days": [], "total": []}
    for k, c in enumerate(cols):
        numbers = F.sequence(F.lit(k * block), F.lit(min((k + 1) * block, len(names)) - 1))
        at = lambda i, c=c: F.try_element_at(F.col(c), i)
        parts["n"].append(F.transform(numbers, lambda i: F.coalesce(at(i)["n"], F.lit(0)).cast("bigint")))
        parts["days"].append(F.transform(numbers, lambda i: _days(at(i)["last"], as_of)))
        parts["total"].append(F.transform(numbers, lambda i: F.coalesce(at(i)["total"], F.lit(0.0))))
    none = {"n": F.array().cast("array<bigint>"), "days": F.array().cast("array<bigint>"), "total": F.array().cast("array<double>")}
    whole = {k: F.concat(*v) if v else none[k] for k, v in parts.items()}
    return table.select("user_id", whole["n"].alias("n_events"), whole["days"].alias("days_since_last"), whole["total"].alias("totals"))


def feature_rows(history: DataFrame, types: DataFrame, as_of: str = "2026-01-01 00:00:00", block: int = BLOCK_TYPES) -> DataFrame:
    """(user_id, event_type, n_events, days_since_last, total): the nonzero features of ``feature_table`` in rows."""
    table, names, cols = _joined(history, types, block)
    if not names:
        return table.select("user_id", F.lit("").alias("event_type"), F.lit(0).cast("bigint").alias("n_events"), F.lit(0).cast("bigint").alias("days_since_last"), F.lit(0.0).alias("total")).limit(0)
    entries = F.concat(*[F.coalesce(F.map_entries(c), F.expr("cast(array() as array<struct<key:int,value:struct<n:bigint,last:timestamp,total:double>>>)")) for c in cols])
    rows = table.select("user_id", F.explode(entries).alias("e"))
    type_name = F.element_at(F.array(*[F.lit(t) for t in names]), F.col("e.key") + 1)
    return rows.select("user_id", type_name.alias("event_type"), F.col("e.value.n").alias("n_events"), _days(F.col("e.value.last"), as_of).alias("days_since_last"), F.col("e.value.total").alias("total"))
