"""Keyed merges: upserts, replacement, cascading deletes, change streams and folds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wayfold.operators.ranking import distributed_islands, distributed_rank
from wayfold.runtime import materialize


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the largest ``order`` of each key: one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("m")).select(*keys, *[F.col("m")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both, the latest version of each key; of equal versions the new row.

    ``keep_first`` columns keep the value of the old row when there is one.
    Idempotent: applying a batch again changes nothing.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = F.struct(F.col(version), F.col("__new"))
    rest = [c for c in old.columns if c not in keys]
    aggs = [F.max_by(F.struct(*rest), order).alias("m"), *[F.min_by(c, F.struct("__new", version)).alias(f"__first_{c}") for c in keep_first]]
    return both.groupBy(*keys).agg(*aggs).select(*keys, *[(F.col(f"__first_{c}") if c in keep_first else F.col("m")[c]).alias(c) for c in rest]).select(*old.columns)


def upsert_keep_nonblank(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A blank or null new value keeps the old one."""
    cols = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*cols).alias("__o"))
    n = new.select(*keys, F.struct(*cols).alias("__n"))
    joined = o.join(n, keys, "full")

    def pick(c: str) -> Column:
        v = F.col("__n")[c]
        filled = F.nullif(F.trim(v), F.lit("")) if dict(new.dtypes)[c] == "string" else v
        return F.coalesce(filled, F.col("__o")[c]).alias(c)

    return joined.select(*keys, *[pick(c) for c in cols])


def replace_partition(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of a replaced key go, whatever their number (K6)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade_delete(tables: list[DataFrame], key: str, deleted: DataFrame) -> list[DataFrame]:
    """Every dependent table without the rows of deleted keys (K8)."""
    gone = deleted.select(key).distinct()
    return [t.join(gone, key, "left_anti") for t in tables]


def apply_changes(base: DataFrame, changes: DataFrame, key: str, version: list[str], op: str = "op") -> DataFrame:
    """The table after a change log: the last change of each key wins, deletes remove it.

    Changes may arrive in any order and more than once: the order is that of
    ``version``, which the base has as well.
    """
    cols = base.columns
    both = base.withColumn(op, F.lit("upsert")).unionByName(changes.select(*cols, op))
    last = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in cols if c != key], op), F.struct(*version, F.when(F.col(op) == "delete", 1).otherwise(0))).alias("m"))
    return last.where(F.col("m")[op] != "delete").select(key, *[F.col("m")[c].alias(c) for c in cols if c != key]).select(*cols)


def snapshot_fold(log: DataFrame, run: str, kind: str, item: str, seq: str, payload: list[str]) -> DataFrame:
    """State of each item after an ordered log: the last write wins."""
    return log.groupBy(run, kind, item).agg(F.max_by(F.struct(*payload), F.col(seq)).alias("m"), F.max(seq).alias("last_seq")).select(run, kind, item, *[F.col("m")[c].alias(c) for c in payload], "last_seq")


def coalesce_runs(log: DataFrame, run: str, seq: str | list[str], text: Column, is_delta: Column) -> DataFrame:
    """Consecutive deltas joined into one message, other rows single (W8): (run, first_seq, delta, n, message).

    ``seq`` orders a run's rows; given several columns that order them, rows
    are numbered from 1 in their run.  A message has the number of its first
    row.  A run with a third of all rows is spread, only a message has to fit a
    task.
    """
    order = [seq] if isinstance(seq, str) else seq
    marked = log.select(run, *order, text.alias("text"), is_delta.alias("delta"))
    grouped = distributed_islands(marked, run, [F.col(c).asc() for c in order], F.col("delta"))
    number = F.col(seq) if isinstance(seq, str) else F.col("place")
    parts = grouped.groupBy(run, "island").agg(F.min(number).alias("first_seq"), F.first("delta").alias("delta"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
    whole = parts.select(run, "first_seq", "delta", "n", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("message"))
    if isinstance(seq, str):
        return whole
    whole = materialize(whole, "messages")
    starts = whole.groupBy(F.col(run).alias("__run")).agg(F.min("first_seq").alias("__start"))
    return whole.join(starts, F.col(run).eqNullSafe(F.col("__run"))).select(run, (F.col("first_seq") - F.col("__start") + 1).cast("int").alias("first_seq"), "delta", "n", "message")


def joined_lines(rows: DataFrame, group: str, order: list[Column], line: Column, lines: int = 500) -> DataFrame:
    """(group, part, text): the lines of each group in order, so many to a part; ``rank`` in ``line`` is a row's number in its group.

    A group's text may be larger than a task, so it comes in parts; joined by
    line feeds in order of ``part`` they are the whole.
    """
    ranked = distributed_rank(rows, [group], order).select(group, "rank", line.alias("line"))
    part = ((F.col("rank") - 1) / lines).cast("int").alias("part")
    held = ranked.groupBy(group, part).agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return held.select(group, "part", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def next_edges(df: DataFrame, parent: str, node: str, order: list[str]) -> DataFrame:
    """(parent, src, dst): each node and the next of its parent."""
    w = Window.partitionBy(parent).orderBy(*order)
    return df.select(parent, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).where("dst is not null")


def patch(nodes: DataFrame, patches: DataFrame, key: str, props: str = "props") -> DataFrame:
    """Open properties of nodes overwritten key by key by their patches (K16); nodes without a patch stay."""
    p = patches.groupBy(key).agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries(props)))).alias("__p"))
    kept = F.map_filter(F.coalesce(props, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("__p", k))
    return nodes.join(p, key, "left").withColumn(props, F.when(F.col("__p").isNull(), F.col(props)).otherwise(F.map_concat(kept, "__p"))).drop("__p")


def append_steps(runs: DataFrame, steps: DataFrame, run: str, seq: str, status: str) -> DataFrame:
    """Runs with the status and number of their last step."""
    last = steps.groupBy(run).agg(F.max(F.struct(seq, status)).alias("m"), F.count(F.lit(1)).alias("n_steps"))
    return runs.join(last, run, "left").select(*[c for c in runs.columns if c != status], F.coalesce(F.col("m")[status], F.col(status)).alias(status), F.col("m")[seq].alias("last_seq"), F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


def first_valid_lookup(items: DataFrame, answers: DataFrame, group: str, item: str, order: str, valid: Column) -> DataFrame:
    """Items with their first valid answer, others dropped, renumbered inside their group."""
    best = answers.where(valid).groupBy(item).agg(F.min_by(F.struct(*[c for c in answers.columns if c not in (item, "pos")]), "pos").alias("a"))
    return items.join(best, item).select(group, item, "a.*", F.row_number().over(Window.partitionBy(group).orderBy(F.when(F.col(order) <= 0, 1).otherwise(0), order, item)).alias("visit_order"))


def greedy_choice(specs: DataFrame, offers: DataFrame, group: str, spec: str, item: str, score: str) -> DataFrame:
    """For each spec of a group in order the best offer whose item isn't chosen yet (W12), of equal scores the smaller item.

    A choice depends on those before it, so a group's offers pass through one
    task in order; only its chosen items are held.
    """
    both = offers.select(group, spec, item, score).join(specs.select(group, spec).distinct(), [group, spec], "left_semi")
    laid = both.repartition(group).sortWithinPartitions(group, spec, F.desc_nulls_last(score), item)
    schema = T.StructType([both.schema[c] for c in (group, spec, item)])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches):
        at, done, taken = None, None, set()
        for b in batches:
            out = []
            for g, s, i in zip(*(b.column(c).to_pylist() for c in (group, spec, item))):
                if (g,) != at:
                    at, done, taken = (g,), None, set()
                if (s,) != done and i not in taken:
                    taken.add(i)
                    done = (s,)
                    out.append((g, s, i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.names)

    return laid.mapInArrow(run, schema)
