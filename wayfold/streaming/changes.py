"""Change streams: article-sync messages applied to a table, and their retries."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayfold.operators.merge import apply_changes

MESSAGE = (
    "event_scope string, event_id string, article_id string, op string, reason string, author_id string, status string, version_ms bigint, "
    "title string, brief string, cover_url string, manual_type_tag string, secondary_tags array<string>, markdown string"
)
#: Attempts, base and most seconds of the quadratic retry delay.
MAX_ATTEMPTS, BASE_SECONDS, MOST_SECONDS = 5, 5, 120


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """The other columns, the message's fields, ``valid`` and ``problem`` (S10): article_id and op are required, the scope defaults."""
    rest = [c for c in raw.columns if c != column]
    m = raw.select(*rest, F.from_json(F.col(column).cast("string"), MESSAGE, {"mode": "PERMISSIVE"}).alias("m"), F.col(column).cast("string").alias("raw"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    out = m.select(*rest, "raw", "m.*").withColumn("event_scope", F.when(blank("event_scope"), "article_sync").otherwise(F.col("event_scope")))
    broken = F.col("article_id").isNull() & F.col("op").isNull() & F.col("event_id").isNull()
    problem = F.when(broken, "no message").when(blank("article_id"), "no article_id").when(blank("op"), "no op").when(~F.lower("op").isin("upsert", "delete"), "unknown op")
    return out.withColumn("problem", problem).withColumn("valid", F.col("problem").isNull())


def kafka_source(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None) -> DataFrame:
    """The primary or the retry topic as a stream (S8, S9); needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest")
    return (reader.option("maxOffsetsPerTrigger", per_trigger) if per_trigger else reader).load()


def retry_delay(attempt):
    """Seconds to wait before an attempt: quadratic, capped; null beyond the last."""
    return F.when(attempt <= MAX_ATTEMPTS, F.least(attempt * attempt * BASE_SECONDS, F.lit(MOST_SECONDS)))


def merge_into(path: str, key: str = "article_id", version: str = "version_ms") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a versioned table of changes below ``path``.

    Each batch appends its valid changes under its own number, so a batch that
    is run again replaces its own files: exactly once.  ``current`` folds them.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where("valid").drop("raw", "valid", "problem")
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where("not valid").select("raw", "problem").write.mode("overwrite").json(f"{path}_rejected/batch={number}")

    return write


def current(spark: SparkSession, path: str, key: str = "article_id", version: str = "version_ms") -> DataFrame:
    """The table after all changes so far: by version, whatever the order of arrival."""
    log = spark.read.parquet(path).drop("batch")
    base = log.drop("op").limit(0)
    return apply_changes(base, log.withColumn("op", F.lower("op")), key, [version, "event_id"])


def retry_states(failures: DataFrame) -> DataFrame:
    """Keyed retry state of a stream of failures (message_id, attempt, failed_at): the next attempt or a dead letter.

    State is one attempt number for each message, with a processing-time
    timeout that forgets a message not heard of for an hour.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        attempt = state.get[0] if state.exists else 0
        last = None
        for f in frames:
            attempt += len(f)
            last = f["failed_at"].max() if last is None else max(last, f["failed_at"].max())
        delay = min(attempt * attempt * BASE_SECONDS, MOST_SECONDS)
        dead = attempt >= MAX_ATTEMPTS
        if dead:
            state.remove()
        else:
            state.update((attempt,))
            state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"message_id": [key[0]], "attempt": [attempt], "due": [last + pd.Timedelta(seconds=0 if dead else delay)], "verdict": ["dead" if dead else "retry"]})

    return failures.groupBy("message_id").applyInPandasWithState(step, "message_id string, attempt int, due timestamp, verdict string", "attempt int", "update", "ProcessingTimeTimeout")


def redeliver(retries: DataFrame) -> DataFrame:
    """Messages of a stream of retries (message_id, payload, attempt, due), each given out again once it is due.

    State is the last retry of each message; it leaves with the processing-time
    timeout that is set to its due time.  (message_id, payload, attempt, due).
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            payload, attempt, due = state.get
            state.remove()
            yield pd.DataFrame({"message_id": [key[0]], "payload": [payload], "attempt": [attempt], "due": [pd.Timestamp(due, unit="ms")]})
            return
        held = state.get if state.exists else None
        for f in frames:
            for r in f.itertuples(index=False):
                if held is None or r.attempt >= held[1]:
                    held = (r.payload, int(r.attempt), int(pd.Timestamp(r.due).timestamp() * 1000))
        state.update(held)
        state.setTimeoutDuration(max(1, held[2] - int(time.time() * 1000)))

    return retries.groupBy("message_id").applyInPandasWithState(step, "message_id string, payload string, attempt int, due timestamp", "payload string, attempt int, due long", "append", "ProcessingTimeTimeout")


def due_at(failures: DataFrame, as_of: str, busy: bool = False) -> DataFrame:
    """The retries of a table of failures (message_id, attempt, failed_at) that are due: the last failure of each message that isn't dead, after its delay; none while primary jobs run."""
    last = failures.groupBy("message_id").agg(F.max(F.struct("attempt", "failed_at")).alias("m")).select("message_id", "m.*")
    due = F.col("failed_at") + F.make_dt_interval(secs=retry_delay(F.col("attempt")))
    return last.withColumn("due", due).where((F.col("due") <= F.lit(as_of).cast("timestamp")) & F.lit(not busy))
