"""Problem 4: no contributor keeps more than its share, the best records first.

Method: quality-weighted reservoir sampling without replacement.  Each record
gets an exponential random key scaled by its score, each partition keeps a
reservoir of the cap-size largest keys of each contributor, and the reservoirs
are united.  Keys are kept as logarithms: for a weight exp(score / scale),
``score + scale * gumbel`` orders records as the exponential keys do.  ``scale``
sets how much chance decides; as it goes to 0 the keys go to the scores, and
the highest scores are kept, ties by the smaller id, which is what the required
result asks for.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayfold.functions.text import WHITE_SPACE
from wayfold.operators.ranking import distributed_rank
from wayfold.runtime import materialize

#: Steps of the quantiles that bracket a contributor's smallest kept key, and their accuracy.
GRID, ACCURACY = 128, 10_000


def fold_name(name: str | None) -> str | None:
    """The name in lower case, without white space, in ordinary character width; null when nothing is left."""
    if name is None:
        return None
    out = []
    for ch in name:
        kind, _, code = unicodedata.decomposition(ch).partition("> ")
        out.append("".join(chr(int(x, 16)) for x in code.split()) if kind in ("<wide", "<narrow") else ch)
    folded = "".join(c for c in unicodedata.normalize("NFC", "".join(out)) if c not in WHITE_SPACE)
    return folded.lower() or None


def author_key(name: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def fold(v: pa.Array) -> pa.Array:
        seen: dict = {}
        return pa.array([seen[x] if x in seen else seen.setdefault(x, fold_name(x)) for x in v.to_pylist()], pa.string())

    return fold(name)


def selection_key(score: Column, record: Column, scale: float, seed: int) -> Column:
    """The logarithm of the exponential key, times ``scale``; minus infinity for a null or NaN score.

    Chance comes from a hash of the record, so that a retry repeats it.
    """
    digits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), record.cast("string"))), 1, 13), 16, 10).cast("double")
    gumbel = -F.log(-F.log((digits + 0.5) / float(1 << 52)))
    return F.coalesce(F.when(~F.isnan(score), score + F.lit(float(scale)) * gumbel if scale else score), F.lit(float("-inf")))


def reservoirs(batches):
    """(group, cap, key, id, ...) rows of a partition -> the same rows and ``evicted``.

    A reservoir of ``cap`` keys is kept for each group; a row that the
    reservoir gives up is evicted: ``cap`` rows of its own partition come
    before it.  Ties stay for the later stage.  At most twice the caps wait.
    """
    held: dict[int, list] = {}

    def emit(rows: pa.RecordBatch, evicted: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, evicted))], [*rows.schema.names, "evicted"])

    def cut(g: int):
        rows = pa.concat_batches(held[g])
        cap, key = rows.column("cap")[0].as_py(), rows.column("key").to_numpy()
        least = np.partition(key, len(key) - cap)[len(key) - cap] if len(key) > cap else -np.inf
        stays = key >= least
        held[g] = [rows.filter(pa.array(stays))]
        return rows.filter(pa.array(~stays))

    for b in batches:
        if not b.num_rows:
            continue
        group = b.column("g").to_numpy()
        for g in np.unique(group):
            held.setdefault(int(g), []).append(b.filter(pa.array(group == g)))
            if sum(x.num_rows for x in held[int(g)]) > 2 * held[int(g)][0].column("cap")[0].as_py():
                gone = cut(int(g))
                if gone.num_rows:
                    yield emit(gone, True)
    for g in list(held):
        gone = cut(g)
        for rows, evicted in ((gone, True), *((x, False) for x in held.pop(g))):
            if rows.num_rows:
                yield emit(rows, evicted)


def cap_contributors(df: DataFrame, id_col: str, contributor: Column, score_col: str, batch_col: str, share: int = 50, scale: float = 0.0, seed: int = 7) -> DataFrame:
    """(id, batch, contributor, cap, kept) of the records of contributors beyond their cap.

    Each contributor keeps ceil(rows of the batch / ``share``) records of a
    batch, those of the largest keys, of equal keys those of the smaller ids.
    Records of contributors within their cap are all kept and not listed; so
    are records with a null contributor, which still count as rows of the
    batch.  Null and NaN scores come last; repeated rows count like any; a null
    batch is a batch; an empty table gives an empty one; other columns are not
    read.

    Only contributors beyond their cap, at most ``share`` - 1 for a batch, are
    looked at.  After the reservoirs, two quantiles of a contributor's keys
    bracket its smallest kept one: what lies above is kept, what lies below is
    dropped, and only what lies between, about three of GRID parts and ties, is
    ranked, by a distributed rank.  No contributor's records meet in one task.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{batch_col}`").alias("batch"), contributor.alias("who"), F.col(f"`{score_col}`").cast("double").alias("score"))
    by_who = rows.groupBy("batch", "who").agg(F.count(F.lit(1)).alias("n"))
    caps = by_who.groupBy("batch").agg(F.ceil(F.sum("n") / share).alias("cap"))
    same = F.col("x.batch").eqNullSafe(F.col("y.batch"))
    over = by_who.alias("x").join(caps.alias("y"), same).where("who is not null and n > cap").select("x.batch", "who", "cap")
    over = materialize(over.withColumn("g", F.monotonically_increasing_id()), "p4-over")
    hot = rows.alias("x").join(over.alias("y"), same & (F.col("x.who") == F.col("y.who"))).select("id", "g", "cap", selection_key(F.col("score"), F.col("id"), scale, seed).alias("key"))
    schema = T.StructType([*hot.schema.fields, T.StructField("evicted", T.BooleanType())])
    held = materialize(hot.mapInArrow(reservoirs, schema), "p4-reservoirs")

    alive = held.where("not evicted").drop("evicted")
    steps = [i / GRID for i in range(GRID + 1)]
    brackets = alive.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("cap").alias("c"), F.percentile_approx("key", steps, ACCURACY).alias("q"))
    below = (F.lit(1.0) - F.col("c") / F.col("n")) * GRID  # the smallest kept key lies at this step
    low = F.element_at("q", F.greatest(F.floor(below) - 1, F.lit(0)).cast("int") + 1)
    high = F.element_at("q", F.least(F.ceil(below) + 1, F.lit(GRID)).cast("int") + 1)
    brackets = brackets.select("g", F.when(F.col("n") <= F.col("c"), float("-inf")).otherwise(low).alias("low"), high.alias("high"))
    placed = materialize(alive.join(brackets, "g"), "p4-placed")
    sure = placed.groupBy("g").agg(F.count(F.when(F.col("key") > F.col("high"), 1)).alias("above"))
    between = placed.where("key >= low and key <= high").select("id", "g", "cap", "key")
    ranked = distributed_rank(between, ["g"], [F.col("key").desc(), F.col("id").asc_nulls_last()]).join(sure, "g")
    ends = placed.where("key > high or key < low").select("id", "g", "cap", (F.col("key") > F.col("high")).alias("kept"))
    out = held.where("evicted").select("id", "g", "cap", F.lit(False).alias("kept")).union(ends).union(ranked.select("id", "g", "cap", (F.col("rank") <= F.col("cap") - F.col("above")).alias("kept")))
    named = out.join(over.select("g", "batch", "who"), "g")
    return named.select(F.col("id").alias(id_col), F.col("batch").alias(batch_col), F.col("who").alias("contributor"), "cap", "kept")
