"""Vector search: exact top-k of stated queries, thresholds, an inverted-file index, graph expansion, hybrid hits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Query vectors in a block and stored vectors in a block: one product of both fits a task's memory.
QUERY_BLOCK, STORED_BLOCK = 512, 4096
#: Vectors in a block of a self join, on average.
SELF_BLOCK = 2048


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double; 0 for null, empty, unequal length or zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.when(ok, dot(a, b) / F.nullif(n, F.lit(0.0))).otherwise(F.lit(0.0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows; a null vector, one of another length or with a null, or zero is a zero row."""
    out = np.zeros((len(column), width))
    good = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    rows = np.flatnonzero(good.to_numpy(zero_copy_only=False))
    if len(rows):
        flat = column.filter(good).flatten()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), width)
        if flat.null_count:
            values = np.where(np.isnan(values).any(1, keepdims=True), 0, values)
        out[rows] = values
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores at or above the threshold of each row, ties by id: a partial selection, then a sort of what it leaves."""
    if scores.shape[1] > k:
        bound = np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], threshold)
    else:
        bound = np.full(len(scores), threshold)
    row, col = np.nonzero(scores >= bound[:, None])
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - starts[row] < k
    return row[keep], col[keep]


def _in_blocks(rows: DataFrame, name: str, key: str, group: str | None, size: int) -> DataFrame:
    """Rows with the number of their block of about ``size`` rows; a group of any size is divided into as many blocks as it needs."""
    if group is None:
        return rows.withColumn(name, F.floor(F.monotonically_increasing_id() / size))
    n = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(n, group).withColumn(name, F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / size))).drop("__n")


def top_k(queries: DataFrame, stored: DataFrame, k: int, width: int, threshold: float | None = None, exclude_self: bool = True, group: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k stored vectors nearest to each query by cosine, ties by id.

    queries and stored have (id, vec); with ``group``, a column of both, a row
    of queries meets the stored rows of its group only.  Both are cut into blocks, and a pair of
    blocks is one matrix product in a task that keeps at most k rows of each
    query; then the best of the blocks are ranked.  The query set is a stated
    one (not every row), so the work is queries times rows, spread by block.
    """
    by = [group] if group else []
    none = F.array().cast(stored.schema["vec"].dataType)
    qn = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"), *by)
    q = _in_blocks(qn, "qb", "query_id", group, QUERY_BLOCK).groupBy("qb", *by).agg(F.collect_list("query_id").alias("qi"), F.collect_list(F.coalesce("qv", none)).alias("qm"))
    s = _in_blocks(stored.select("id", "vec", *by), "sb", "id", group, STORED_BLOCK).groupBy("sb", *by).agg(F.collect_list("id").alias("si"), F.collect_list(F.coalesce("vec", none)).alias("sm"))
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                qi, si = (np.array(b.column(c)[row].as_py()) for c in ("qi", "si"))
                scores = np.round(_matrix(b.column("qm")[row].values, width) @ _matrix(b.column("sm")[row].values, width).T, 9)
                if exclude_self:
                    scores[qi[:, None] == si[None, :]] = -2
                r, c = _best(si, scores, k, threshold if threshold is not None else -1.5)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(si[c]), pa.array(scores[r, c])], schema.names)

    best = (s.join(q, group) if group else s.crossJoin(q)).select("qi", "qm", "si", "sm").mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def coarse_fine(queries: DataFrame, stored: DataFrame, group: str, coarse: int, k: int, width: int) -> DataFrame:
    """(query_id, id, score, rank): the k rows nearest to each query among the groups of its ``coarse`` nearest rows.

    Coarse recall looks at all rows; fine recall reads the rows of recalled
    groups only.
    """
    near = top_k(queries, stored, coarse, width).join(stored.select("id", group), "id").select("query_id", group).distinct()
    wanted = near.join(queries.select(F.col("id").alias("query_id"), "vec"), "query_id").select(F.col("query_id").alias("id"), "vec", group)
    return top_k(wanted, stored.join(near, group, "left_semi"), k, width, group=group)


def similar_pairs(stored: DataFrame, k: int, width: int, threshold: float, block: int = SELF_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): for every vector the k others nearest to it by cosine, at or above a threshold, ties by id.

    Exact.  Rows are filed into blocks by a hash of their id and sent once to
    each pair of blocks that theirs is in; a pair is one matrix product in a
    task, used in both directions, that keeps at most k rows of each vector.
    The work is rows times rows, spread by pair, without a cross join.
    """
    rows = stored.select("id", F.coalesce("vec", F.array().cast(stored.schema["vec"].dataType)).alias("vec")).where("id is not null")
    n = -(-rows.count() // block) or 1
    b = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filed = rows.withColumn("b", b).withColumn("o", other).select(F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "id", "vec")
    kind = stored.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

    def best(own, others, scores):
        scores = np.where(own[:, None] == others[None, :], -2, scores)
        r, c = _best(others, scores, k, threshold)
        return [(own[r], others[c], scores[r, c])]

    def run(pair: pa.Table) -> pa.Table:
        blocks = pair.column("b").to_numpy()
        ids, m = np.array(pair.column("id").to_pylist()), _matrix(pair.column("vec").combine_chunks(), width)
        low = blocks == blocks.min()
        x, y = (low, ~low) if not low.all() else (low, low)
        alone = pair.column("lo")[0].as_py() != pair.column("hi")[0].as_py() and low.all()
        found = []
        if not alone:
            scores = np.round(m[x] @ m[y].T, 9)
            found += best(ids[x], ids[y], scores)
            if x is not y:
                found += best(ids[y], ids[x], scores.T)
        parts = [np.concatenate(c) for c in zip(*found)] if found else [ids[:0], ids[:0], np.zeros(0)]
        return pa.table(parts, schema=to_arrow_schema(schema))

    hits = filed.groupBy("lo", "hi").applyInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass
class InvertedFile:
    """A nearest-neighbour index: every vector is filed under its nearest centre; a query looks into the nearest few.

    Centres are fitted on at most ``sample`` vectors (a bound, not a share);
    every row is indexed.  The number of lists grows with the square root of
    the rows, so a list holds about that many rows, and a query that probes a
    fixed number of lists reads a share that falls as the table grows.  More
    ``probes`` give more recall; probing all centres is exact.
    """

    centres: np.ndarray

    @staticmethod
    def fit(stored: DataFrame, width: int, lists: int | None = None, sample: int = 20_000, rounds: int = 12, seed: int = 5) -> InvertedFile:
        if lists is None:
            lists = max(1, min(sample, round(stored.count() ** 0.5)))
        rows = stored.where(F.size("vec") == width).orderBy(F.xxhash64("id", F.lit(seed))).limit(sample).select("vec").toArrow()
        x = _matrix(rows.column("vec").combine_chunks(), width)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else np.zeros((1, width))
        for _ in range(rounds):
            near = np.argmax(x @ c.T, axis=1) if len(x) else np.zeros(0, int)
            for j in range(len(c)):
                if (near == j).any():
                    m = x[near == j].mean(0)
                    c[j] = m / (np.linalg.norm(m) or 1)
        return InvertedFile(c)

    def file(self, rows: DataFrame, probes: int = 1) -> DataFrame:
        """Rows with a ``list`` column: one row for each of the ``probes`` nearest centres."""
        c = self.centres

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def nearest(v: pa.Array) -> pa.Array:
            order = np.argsort(-(_matrix(v, c.shape[1]) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            return pa.array(list(order), pa.list_(pa.int32()))

        return rows.select("*", F.explode(nearest("vec")).alias("list"))

    def search(self, queries: DataFrame, stored: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """(query_id, id, score, rank) from the probed lists only, by products of blocks of a list; a list that holds a third of all rows is many blocks."""
        return top_k(self.file(queries.select("id", "vec"), probes), self.file(stored.select("id", "vec")), k, self.centres.shape[1], group="list")


def expand(seeds: DataFrame, edges: DataFrame, per_seed: int, factor: float) -> DataFrame:
    """Seeds (id, score) and up to ``per_seed`` neighbours of each by edge weight, at a share of the seed's score; the best of each id."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    near = edges.join(seeds.withColumnRenamed("id", "src"), "src").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_seed).select(F.col("dst").alias("id"), (F.col("score") * F.col("weight") * factor).alias("score"))
    return seeds.select("id", "score").union(near).groupBy("id").agg(F.max("score").alias("score"))


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """(query_id, id, score, rank): two hit lists (query_id, id, score) united by the weighted sum of their normal scores, rounded to 6 places, ties by id.

    A cosine s counts (1 + s) / 2, a term score s counts 2 / pi * atan(s); a hit
    that a list lacks counts 0 there.  Each list is the best of its own search,
    so nothing but hits is shuffled here.
    """
    parts = [dense.select("query_id", "id", (weights[0] * (1 + F.col("score")) / 2).alias("s")), sparse.select("query_id", "id", (weights[1] * F.atan("score") * (2 / math.pi)).alias("s"))]
    both = parts[0].unionByName(parts[1]).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def backfill(hits: DataFrame, contents: DataFrame, key: str, column: str) -> DataFrame:
    """Hits with the content of the relational side, else their own; rank and other columns are kept."""
    other = contents.select(key, F.col(column).alias("__c")).dropDuplicates([key])
    return hits.join(other, key, "left").select(*[F.coalesce(F.nullif(F.col("__c"), F.lit("")), F.col(column)).alias(c) if c == column else F.col(c) for c in hits.columns])


def latest_version(chunks: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of the newest version of each key."""
    newest = chunks.groupBy(*keys).agg(F.max(version).alias(version))
    return chunks.join(newest, [*keys, version], "left_semi")
