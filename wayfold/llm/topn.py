"""Problem 7: the N best items of every group.

Method: sorted runs merged by a loser tree.  Every partition of the
deduplicated items is a run, ordered by group and score and cut to N items a
group, as no later one can be among the N best.  The runs are bucketed by
group; in a bucket they lie group by group, and a loser tree merges the runs
of a group until N items are out, then seeks to the next group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, so a step replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), max(1, len(runs))
        self.k, self.tree = k, [-1] * k
        winners = [-1] * k + list(range(len(runs))) + [-1] * (k - len(runs))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1]

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or self.at[a] == len(self.runs[a]):
            return False
        if b < 0 or self.at[b] == len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator:
        while (w := self.tree[0]) >= 0 and self.at[w] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.k) // 2
            while node:
                if self._before(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def merge_top(runs: Iterable[list], n: int) -> list:
    """The first n of the merged runs; the rest is not visited."""
    out = []
    for item in LoserTree([r for r in runs if r]):
        out.append(item)
        if len(out) == n:
            break
    return out


def group_changes(columns: list[pa.Array]) -> np.ndarray:
    """For each row but the first whether it differs from the row before; null equals null, and nothing else."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def top_n_per_group(df: DataFrame, groups: list[Column], names: list[str], item: Column, item_name: str, score: Column, version: Column, n: int = 10) -> DataFrame:
    """(names..., item_rank, item): the n best of each group, ranked from 1.

    Of rows equal in group and item only the one with the latest version
    counts (null versions first; of equal versions the higher score).  Items
    rank by score from high to low, null and NaN last and equal, then by item
    from low to high in code-point order.  Null groups form a group; null items
    come last; an empty table gives an empty one; other columns are not read.

    The first shuffle is by group and item, so a group of millions is spread;
    the second moves at most n rows of a group from each partition.
    """
    value = F.when(~F.isnan(score), score.cast("double"))
    keyed = df.select(*[g.alias(f"g{i}") for i, g in enumerate(groups)], item.alias("item"), value.alias("score"), version.alias("v"))
    g = [f"g{i}" for i in range(len(groups))]
    latest = keyed.groupBy(*g, "item").agg(F.max(F.struct("v", "score")).alias("m")).select(*g, "item", F.col("m.score").alias("score"))
    in_run = latest.sortWithinPartitions(*g, F.col("score").desc_nulls_last(), F.col("item").asc_nulls_last())
    schema = T.StructType([*(latest.schema[c] for c in g), T.StructField("item", latest.schema["item"].dataType), T.StructField("score", T.DoubleType()), T.StructField("run", T.IntegerType())])

    def cut(batches):
        """The run of a partition, cut to n items a group: places from where the group changes, without a loop over rows."""
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c) for c in g]
            first = tuple(c[0].as_py() for c in cols)
            starts = np.concatenate([[True], group_changes(cols)])
            at = np.arange(b.num_rows)
            place = at - np.maximum.accumulate(np.where(starts, at, 0))
            if first == last:
                place[: np.argmax(starts[1:]) + 1 if starts[1:].any() else b.num_rows] += seen
            last, seen = tuple(c[-1].as_py() for c in cols), int(place[-1]) + 1
            yield b.filter(pa.array(place < n))

    runs = in_run.select(*g, "item", "score", F.spark_partition_id().alias("run")).mapInArrow(cut, schema)
    bucketed = runs.repartition(*g).sortWithinPartitions(*g, "run", F.col("score").desc_nulls_last(), F.col("item").asc_nulls_last())
    out_schema = T.StructType([*(T.StructField(a, latest.schema[c].dataType) for a, c in zip(names, g)), T.StructField("item_rank", T.IntegerType()), T.StructField(item_name, latest.schema["item"].dataType)])

    kinds = [to_arrow_type(f.dataType) for f in out_schema.fields]

    def merge(batches):
        def groups_of():
            key, parts, run = None, [], None
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in (*g, "run", "score", "item"))):
                    k = row[: len(g)]
                    if k != key:
                        if parts:
                            yield key, parts
                        key, parts, run = k, [], None
                    if row[-3] != run:
                        run = row[-3]
                        parts.append([])
                    s, it = row[-2], row[-1]
                    parts[-1].append((s is None, -s if s is not None else 0.0, it is None, "" if it is None else it))
            if parts:
                yield key, parts

        rows = []
        for key, parts in groups_of():
            rows += [(*key, i, None if x[2] else x[3]) for i, x in enumerate(merge_top(parts, n), 1)]
            if len(rows) >= 20_000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], out_schema.names)

    return bucketed.mapInArrow(merge, out_schema)
