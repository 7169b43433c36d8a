"""Interfaces of outside services with offline implementations, and search results as a batch source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Embedder(Protocol):
    """Texts to vectors of one width."""

    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic offline embedder: signed hashes of character trigrams, scaled to unit length."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for j in range(max(1, len(t) - 2) if t else 0):
                h = xxhash.xxh64_intdigest(t[j : j + 3])
                out[i, h % self.width] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed_column(text: Column, embedder: Embedder | None = None) -> Column:
    """Vectors of a text column by Arrow batches; null counts as empty, whose vector is zero."""
    e = embedder or HashingEmbedder()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(v: pa.Array) -> pa.Array:
        m = e.embed([x or "" for x in v.to_pylist()]).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * e.width), pa.array(m.reshape(-1)))

    return run(text)


def lexical_rerank(query: Column, document: Column) -> Column:
    """An offline rerank score: the share of the query's distinct characters that the document has."""
    chars = F.array_distinct(F.filter(F.split(F.lower(query), ""), lambda x: x != ""))
    have = F.filter(chars, lambda x: F.contains(F.lower(document), x))
    return F.when(F.size(chars) > 0, F.size(have) / F.size(chars)).otherwise(0.0)


class RateLimiter:
    """Calls a second of one client, and linear backoff of its retries."""

    def __init__(self, per_second: float, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.gap, self.sleep, self.clock, self.next = 1 / per_second, sleep, clock, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap

    def call(self, f: Callable, attempts: int = 3, pause: float = 0.5):
        for n in range(1, attempts + 1):
            self.wait()
            try:
                return f()
            except ConnectionError:
                if n == attempts:
                    raise
                self.sleep(pause * n)


def limited_map(df: DataFrame, column: str, call: Callable[[str], str], out: str, workers: int = 6, per_second: float = 30.0) -> DataFrame:
    """``call`` on each value by at most ``workers`` tasks at a shared rate; the first error fails the job."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = RateLimiter(per_second / workers)
        for b in batches:
            values = [None if x is None else limit.call(lambda x=x: call(x)) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], [*b.schema.names, out])

    return df.repartition(workers).mapInArrow(run, schema)


class _SearchReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(q) for q in json.loads(self.options.get("queries", "[]"))]

    def read(self, partition):
        """One query is one partition; the offline index is a file of JSON lines with query, title, url, summary, at a path that all executors see."""
        most = min(max(int(self.options.get("count", "10")), 1), int(self.options.get("most", "10")))
        n = 0
        with open(self.options["index"], encoding="utf-8") as f:
            for line in f:
                item = json.loads(line)
                if n < most and partition.value in (item.get("title") or "") + (item.get("summary") or ""):
                    n += 1
                    yield (partition.value, n, item.get("title"), item.get("url"), item.get("summary"))


class SearchDataSource(DataSource):
    """``spark.read.format("search")``: results of queries as rows."""

    @classmethod
    def name(cls):
        return "search"

    def schema(self):
        return "query string, pos int, title string, url string, summary string"

    def reader(self, schema):
        return _SearchReader(self.options)


def search(spark: SparkSession, queries: list[str], index: str, count: int = 10, most: int = 10) -> DataFrame:
    """Search results; the count is clamped to 1..``most``."""
    spark.dataSource.register(SearchDataSource)
    return spark.read.format("search").option("queries", json.dumps(queries)).option("index", index).option("count", count).option("most", most).load()


#: The map endpoints and the parameters that each needs.
MAP_ENDPOINTS = {
    "poi_keyword": ["keywords"], "poi_around": ["location"], "poi_detail": ["id"], "input_tips": ["keywords"], "geocode": ["address"], "regeocode": ["location"], "distance": ["origins", "destination"],
    "walking": ["origin", "destination"], "transit": ["origin", "destination", "city1"], "driving": ["origin", "destination"], "bicycling": ["origin", "destination"], "district": ["keywords"], "ip_location": [],
}


def map_requests(df: DataFrame, endpoint: str, call: Callable[[str], str], workers: int = 2, per_second: float = 1.0) -> DataFrame:
    """Answers of a map endpoint for a table of its parameters (S16, S17): ``request`` and ``answer`` as JSON text.

    Rows that lack a required parameter aren't sent; their answer is null.
    """
    need = MAP_ENDPOINTS[endpoint]
    ready = F.lit(True)
    for c in need:
        ready = ready & (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    asked = df.withColumn("request", F.when(ready, F.to_json(F.struct(F.lit(endpoint).alias("endpoint"), *need))))
    return limited_map(asked, "request", call, "answer", workers, per_second)


def envelope(answer: Column) -> Column:
    """struct<ok,info,body> of an answer."""
    return F.struct((F.get_json_object(answer, "$.status") == "1").alias("ok"), F.get_json_object(answer, "$.info").alias("info"), answer.alias("body"))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, lo: int = 0, hi: int = 0, parts: int = 8, **options: str) -> DataFrame:
    """A relational source (S1, S2); with a numeric key it is read in ``parts`` ranges."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        r = r.option("partitionColumn", key).option("lowerBound", lo).option("upperBound", hi).option("numPartitions", parts)
    return r.load()
