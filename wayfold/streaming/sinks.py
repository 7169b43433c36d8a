"""Where results go: topics, server-sent events and metric texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value): each row as a JSON message under its key."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def publish(df: DataFrame, servers: str, topic: str, key: str, checkpoint: str) -> StreamingQuery:
    """A stream's rows to a topic (K11): the result topic, or the retry topic for failures."""
    return messages(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def server_sent(df: DataFrame, event: Column, order: list[Column]) -> DataFrame:
    """(seq parts..., text): events in the form of a server-sent stream (K19); line feeds in the data are continued lines."""
    data = F.regexp_replace(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), "\n", "\ndata: ")
    return df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n")).alias("text"))


def exposition(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """(line): samples in the text form of metric scrapers (K21); quotes, backslashes and line feeds in labels are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), safe(c), F.lit('"')) for c in labels])
    return metrics.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def cumulative_buckets(df: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """(by..., le, n): a cumulative histogram, +Inf last (A30): one pass, one row per group before it is unfolded."""
    aggs = [F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"b{len(bounds)}")]
    names = [*(f"{b:g}" for b in bounds), "+Inf"]
    rows = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"b{i}").alias("n")) for i, n in enumerate(names)])
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
