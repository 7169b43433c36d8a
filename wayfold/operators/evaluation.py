"""Recommendation evaluation over a request log and an event log.

Event log: rec_request_id, user_id, article_id, rank, event_type, event_ts.
Ratios are 0 for an empty denominator and clamped to 0..1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfold.runtime import materialize

#: The event types and the weights of the positive ones.
EVENT_TYPES = ["impression", "click", "like", "favorite", "read_complete", "dislike"]
WEIGHTS = {"click": 1.0, "like": 2.0, "favorite": 2.0, "read_complete": 2.0}
CONVERSIONS = ["like", "favorite", "read_complete"]
POSITIVE = list(WEIGHTS)


def ratio(n: Column, d: Column) -> Column:
    """n / d in 0..1; 0 where d is null or not positive."""
    return F.when(d > 0, F.least(F.greatest(F.coalesce(n / d, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def clean_events(events: DataFrame) -> DataFrame:
    """Events of a known type and a nonblank article, types in lower case and stripped (K5)."""
    kind = F.lower(F.trim("event_type"))
    return events.where(kind.isin(EVENT_TYPES) & (F.trim("article_id") != "")).withColumn("event_type", kind)


def since(events: DataFrame, as_of: str, seconds: int, column: str = "event_ts") -> DataFrame:
    """Rows of the last ``seconds`` before ``as_of`` (F2)."""
    return events.where(F.col(column) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def cells(events: DataFrame, ranks: int = 0) -> DataFrame:
    """(rec_request_id, article_id, impressions, clicks, conversions, positive): the log by request and article.

    All counts and distinct counts follow from these sums, so the log is read
    and shuffled once, combined before the shuffle, and no row is expanded for
    each distinct count.  With ``ranks``, w1, w2, ... are the weights of
    positive events by rank.
    """
    n = lambda *t: F.count(F.when(F.col("event_type").isin(*t), 1))
    by_rank = [F.sum(F.when(F.col("rank") == r, weight())).alias(f"w{r}") for r in range(1, ranks + 1)]
    return events.groupBy("rec_request_id", "article_id").agg(n("impression").alias("impressions"), n("click").alias("clicks"), n(*CONVERSIONS).alias("conversions"), n(*POSITIVE).alias("positive"), *by_rank)


def weight() -> Column:
    """The weight of an event's type; 0 for one that isn't positive."""
    out = F.lit(0.0)
    for t, v in WEIGHTS.items():
        out = F.when(F.col("event_type") == t, v).otherwise(out)
    return out


def per_request(cells: DataFrame, articles: DataFrame | None = None, ranks: int = 0) -> DataFrame:
    """One row per request: its sums, positive items and, given articles, distinct topics and items of its impressions."""
    c = cells
    aggs = [F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.sum("conversions").alias("conversions"), F.count(F.when((F.col("positive") > 0) & F.col("article_id").isNotNull(), 1)).alias("positive_items"), F.sum("positive").alias("positive"), F.count(F.when((F.col("impressions") > 0) & F.col("article_id").isNotNull(), 1)).alias("items")]
    aggs += rank_sums(ranks)
    if articles is not None:
        # an empty tag text is no topic, a null one falls back (T4)
        topic = F.nullif(F.coalesce("type_tags", "tags", F.lit("")), F.lit(""))
        c = c.join(articles.select("article_id", topic.alias("topic")), "article_id", "left")
        aggs.append(F.size(F.collect_set(F.when(F.col("impressions") > 0, F.col("topic")))).alias("topics"))  # bounded by the request's items
    return c.groupBy("rec_request_id").agg(*aggs)


def totals() -> list[Column]:
    """Aggregates over ``per_request`` rows."""
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("impressions", "clicks", "conversions")] + [F.count(F.when(F.col("positive") > 0, 1)).alias("positive_requests"), F.coalesce(F.sum("positive_items"), F.lit(0)).alias("positive_items")]


def seen_articles(cells: DataFrame) -> DataFrame:
    """One row: the number of distinct impressed articles."""
    return cells.where("impressions > 0").select("article_id").distinct().agg(F.count("article_id").alias("unique_articles"))


def event_counts(events: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of conditional and conditional distinct counts (A2)."""
    c = cells(events)
    return requests.agg(F.count(F.lit(1)).alias("requests")).crossJoin(per_request(c).agg(*totals())).crossJoin(seen_articles(c))  # one row each


def coverage(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Share of all articles that had an impression (A4)."""
    seen = seen_articles(cells(events)).withColumnRenamed("unique_articles", "recommended")
    return seen.crossJoin(articles.agg(F.count(F.lit(1)).alias("total"))).select("recommended", "total", ratio(F.col("recommended"), F.col("total")).alias("coverage"))


def mean_diversity() -> Column:
    shown = F.col("impressions") > 0
    return F.coalesce(F.avg(F.when(shown, ratio(F.col("topics"), F.col("items")))), F.lit(0.0)).alias("diversity")


def diversity(events: DataFrame, articles: DataFrame) -> DataFrame:
    """Mean over requests of distinct topics per distinct impressed article (A5)."""
    return per_request(cells(events), articles).agg(mean_diversity())


def personalization(events: DataFrame, max_rows: int = 2000, max_users: int = 50) -> DataFrame:
    """Mean of 1 - Jaccard over user pairs.

    The row and user limits are the feature: rows are taken by (user, newest
    first), users by name, so at most ``max_users`` squared pairs exist.
    """
    rows = events.where("event_type = 'impression' and user_id <> ''").orderBy("user_id", F.desc("event_ts"), F.desc("event_id")).limit(max_rows).select("user_id", "article_id")
    users = rows.groupBy("user_id").agg(F.collect_set("article_id").alias("seen")).orderBy("user_id").limit(max_users)
    every = users.agg(F.collect_list("seen").alias("l"))  # at most ``max_rows`` articles of ``max_users`` users
    both = lambda x, y: F.size(F.array_intersect(x, y))
    apart = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: 1 - both(x, y) / F.nullif(F.size(x) + F.size(y) - both(x, y), F.lit(0)))))
    return every.select(F.explode_outer(apart).alias("d")).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("personalization"))


def mean_ndcg(ranks: int) -> Column:
    """Mean NDCG over rows with w1, w2, ... that have a weight; the ideal order is of the observed ranks."""
    got = F.array(*[F.coalesce(F.col(f"w{r}"), F.lit(0.0)) for r in range(1, ranks + 1)])
    gain = lambda a: F.aggregate(F.transform(a, lambda w, i: w / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda x, y: x + y)
    ideal = gain(F.sort_array(got, asc=False))
    return F.coalesce(F.avg(F.when(ideal > 0, gain(got) / ideal)), F.lit(0.0)).alias("ndcg")


def rank_sums(ranks: int) -> list[Column]:
    return [F.sum(f"w{r}").alias(f"w{r}") for r in range(1, ranks + 1)]


def ndcg_at(events: DataFrame, k: int = 10) -> DataFrame:
    """Mean NDCG over requests with a positive event; the ideal order is of the observed ranks up to k (A7): one aggregation, no sort of the log."""
    by_rank = [F.sum(F.when(F.col("rank") == r, weight())).alias(f"w{r}") for r in range(1, k + 1)]
    return events.where(F.col("event_type").isin(POSITIVE) & F.col("rank").between(1, k)).groupBy("rec_request_id").agg(*by_rank).agg(mean_ndcg(k))


def summary(events: DataFrame, requests: DataFrame | None, articles: DataFrame, k: int = 10) -> DataFrame:
    """Nine metrics in long form: (metric, value) (A8); without a request log, the requests are those of the events.

    The log is read for the cells, which are written, and for the bounded
    personalization; all else comes from the cells.
    """
    by_cell = materialize(cells(events, k), "cells")
    per = per_request(by_cell, articles, k)
    one = per.agg(*totals(), mean_diversity(), mean_ndcg(k), F.count(F.lit(1)).alias("seen_requests")).crossJoin(seen_articles(by_cell)).crossJoin(articles.agg(F.count(F.lit(1)).alias("total"))).crossJoin(personalization(events))
    one = one.withColumnRenamed("seen_requests", "requests") if requests is None else one.crossJoin(requests.agg(F.count(F.lit(1)).alias("requests")))
    c = F.col
    metrics = {
        "hit_rate": ratio(c("positive_requests"), c("requests")),
        "recall": ratio(c("positive_items"), F.greatest("unique_articles", F.lit(1))),
        "precision": ratio(c("positive_items"), c("impressions")),
        "ranking_quality": c("ndcg"),
        "diversity": c("diversity"),
        "coverage": ratio(c("unique_articles"), c("total")),
        "personalization": c("personalization"),
        "ctr": ratio(c("clicks"), c("impressions")),
        "cvr": ratio(c("conversions"), c("clicks")),
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, 6).alias("value")) for k, v in metrics.items()])).alias("m")).select("m.*")
