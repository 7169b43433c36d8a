"""Event-time aggregates and keyed job state over streams (Z3, Z8-Z10, A29); windows with watermarks are an extension."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


def tumbling(events: DataFrame, ts: str, keys: list[str], seconds: int, value: str, watermark: str | None = None) -> DataFrame:
    """Sums in tumbling windows (Z8); the same plan for a table and a stream."""
    e = events.withWatermark(ts, watermark) if watermark else events
    g = e.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding_ratio(events: DataFrame, ts: str, kind: str, part: str, whole: str, size: str, slide: str, watermark: str) -> DataFrame:
    """The share of two event types in sliding windows."""
    g = events.withWatermark(ts, watermark).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count(F.when(F.col(kind) == part, 1)).alias("part"), F.count(F.when(F.col(kind) == whole, 1)).alias("whole"))
    return g.select(F.col("w.start").alias("start"), "part", "whole", F.when(F.col("whole") > 0, F.least(F.col("part") / F.col("whole"), F.lit(1.0))).otherwise(0.0).alias("ratio"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Session windows by key."""
    e = events.withWatermark(ts, watermark) if watermark else events
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class JobCoalescer:
    """State machine of one key's jobs (Z3): queued, running, and dirty when new queries come while it runs."""

    def __init__(self, keep: int = 3):
        self.keep, self.state, self.queries, self.dirty = keep, "idle", [], False

    def _merge(self, new: Iterable[str]) -> bool:
        before = list(self.queries)
        for q in (x.strip() for x in new):
            if q:
                self.queries = [x for x in self.queries if x.lower() != q.lower()] + [q]
        self.queries = self.queries[-self.keep :]
        return self.queries != before

    def enqueue(self, queries: Iterable[str], room: bool = True) -> str:
        if self.state == "idle":
            if not room:
                return "dropped_queue_full"
            self._merge(queries)
            self.state = "queued"
            return "queued"
        changed = self._merge(queries)
        self.dirty = self.dirty or (self.state == "running" and changed)
        return "deduped"

    def start(self) -> list[str]:
        self.state, self.dirty = "running", False
        return list(self.queries)

    def finish(self) -> str:
        """Runs again if dirty."""
        self.state = "queued" if self.dirty else "idle"
        if self.state == "idle":
            self.queries = []
        return self.state


def replay_jobs(log: DataFrame, keys: list[str], seq: str, action: str, query: str) -> DataFrame:
    """The outcome of each logged action of each key, in order of ``seq``.

    The rows of a key pass through one task in order, as the machine's steps
    depend on each other, but are never held together: its state is all that
    is kept.
    """
    rows = log.select(*keys, seq, action, query).repartition(*keys).sortWithinPartitions(*keys, seq)
    schema = T.StructType([*(log.schema[k] for k in (*keys, seq)), T.StructField("result", T.StringType()), T.StructField("n_queries", T.IntegerType())])

    def run(batches):
        key, m = None, JobCoalescer()
        for b in batches:
            results, counts = [], []
            for row in zip(*(b.column(c).to_pylist() for c in (*keys, action, query))):
                if row[: len(keys)] != key:
                    key, m = row[: len(keys)], JobCoalescer()
                what, text = row[-2], row[-1]
                if what == "enqueue":
                    result = m.enqueue([text]) if text and text.strip() else "dropped_invalid"
                elif what == "start":
                    result = "started" if m.state == "queued" and m.start() is not None else "ignored"
                else:
                    result = m.finish() if m.state == "running" else "ignored"
                results.append(result)
                counts.append(len(m.queries))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, seq)), pa.array(results, pa.string()), pa.array(counts, pa.int32())], schema.names)

    return rows.mapInArrow(run, schema)
