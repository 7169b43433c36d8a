"""Guide-material steps: reject, dedup, score, rank, decide, select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wayfold.functions.strings import by_keywords, url_normalize

#: Query templates with their intents, in order.
QUERY_TEMPLATES = [("", "overview"), (" 攻略", "overview"), (" 自由行", "itinerary"), (" 路线", "itinerary"), (" 住哪里", "hotel_area"), (" 交通", "transport"), (" 美食", "food"), (" 避坑", "pitfall"), (" 预算", "budget"), (" 几天合适", "itinerary"), (" 景点推荐", "attraction"), (" 季节", "season"), (" 亲子", "scene"), (" 情侣", "scene"), (" 第一次", "overview")]
#: Query templates for videos with their intents, in order.
VIDEO_TEMPLATES = [("", "overview"), (" 攻略", "overview"), (" vlog", "overview"), (" 自由行", "itinerary"), (" 路线", "itinerary"), (" 景点", "attraction"), (" 美食", "food"), (" 住宿", "hotel_area"), (" 交通", "transport"), (" 避坑", "pitfall"), (" 预算", "budget"), (" 几天合适", "itinerary"), (" 第一次", "overview")]
#: Intents and the words that tell them, in order.
INTENT_WORDS = [("hotel_area", ["住", "酒店", "住宿"]), ("transport", ["交通", "地铁", "机场"]), ("food", ["美食", "餐厅", "吃"]), ("pitfall", ["避坑", "注意", "坑"]), ("budget", ["预算", "花费", "费用"]), ("itinerary", ["路线", "行程", "几天"]), ("attraction", ["景点", "玩法", "推荐"]), ("season", ["季节", "樱花", "冬天", "夏天"])]
#: The intents of videos know no seasons.
VIDEO_INTENTS = [x for x in INTENT_WORDS if x[0] != "season"]
#: Scores by age in days; older, and of unknown age.
FRESHNESS, FRESH_OLD, FRESH_UNKNOWN = [(30, 15.0), (90, 12.0), (365, 9.0), (1095, 5.0)], 2.0, 3.0


def full_text(title: Column, summary: Column) -> Column:
    return F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.coalesce(c, F.lit("")), F.lit(w))
    return out


def count_contained(c: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(c, F.lit(w)).cast("int")
    return out


def reject_reason(title: Column, url: Column, author: Column, text: Column, blocked: list[str], negative: list[str]) -> Column:
    """The first reason to reject a candidate, null for none."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(title), "no title").when(empty(url), "no url").when(contains_any(author, blocked), "blocked author").when(contains_any(text, negative), "negative keyword")


def classify(source_intent: Column, text: Column, words: list[tuple[str, list[str]]] | None = None) -> Column:
    """The source's intent unless blank or other, else by words in order."""
    return F.coalesce(F.when(~source_intent.isin("", "other"), source_intent), by_keywords(text, words or INTENT_WORDS, "other"))


def freshness(edit_time: Column, as_of: str, max_age_days: int | None = None) -> Column:
    """Score of an age in unix seconds (X18); with ``max_age_days`` an older one scores 1."""
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - edit_time) / 86400.0
    out = F.lit(FRESH_OLD)
    for limit, value in reversed(FRESHNESS):
        out = F.when(days <= limit, value).otherwise(out)
    if max_age_days is not None:
        out = F.when(days > max_age_days, 1.0).otherwise(out)
    return F.when(F.coalesce(edit_time, F.lit(0)) <= 0, FRESH_UNKNOWN).otherwise(out)


def readability(title: Column, summary: Column) -> Column:
    """2.5 for a title of 8 to 60 characters, 2.5 for a summary of 40 to 300."""
    part = lambda c, a, b: F.when(F.char_length(c).between(a, b), 2.5).otherwise(0.0)
    return part(title, 8, 60) + part(summary, 40, 300)


def score(c: DataFrame, must: list[str], should: list[str], trusted: list[str], as_of: str) -> Column:
    """The weighted score, one decimal."""
    text = full_text(F.col("title"), F.col("summary"))
    count = lambda x: F.log10(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)) + 1)
    parts = [
        F.least(F.lit(30.0), count_contained(text, must) * 12.0),
        F.least(F.lit(8.0), count_contained(text, should) * 2.0),
        F.when(classify(F.col("source_intent"), text) != "other", 20.0).otherwise(6.0),
        F.least(F.lit(20.0), count(F.col("vote_up_count")) * 8 + count(F.col("comment_count")) * 3),
        freshness(F.col("edit_time"), as_of),
        F.when(F.col("is_article"), 8.0).otherwise(3.0),
        F.when(F.col("search_scope") == "global_search", 6.0).otherwise(0.0),
        F.when(contains_any(F.col("author_name"), trusted), 5.0).otherwise(0.0),
        readability(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return F.round(out, 1)


def video_score(c: DataFrame, must: list[str], should: list[str], trusted: list[str], as_of: str, max_age_days: int | None = None) -> Column:
    """The weighted score of videos (title, summary, source_intent, author_name, publish_time and counts of views, likes, favorites and comments on screen), one decimal."""
    text = full_text(F.col("title"), F.col("summary"))
    count = lambda x: F.log10(F.greatest(F.coalesce(F.col(x), F.lit(0)), F.lit(0)) + 1)
    intent = classify(F.col("source_intent"), text, VIDEO_INTENTS)
    part = lambda x, a, b: F.when(F.char_length(F.coalesce(x, F.lit(""))).between(a, b), 3.0).otherwise(0.0)
    out = F.least(F.lit(30.0), count_contained(text, must) * 12.0) + F.least(F.lit(10.0), count_contained(text, should) * 2.0) + F.when(intent != "other", 22.0).otherwise(6.0)
    out = out + F.least(F.lit(22.0), count("view_count") * 6 + count("like_count") * 5 + count("favorite_count") * 4 + count("danmaku_count") * 2)
    out = out + freshness(F.col("publish_time"), as_of, max_age_days) + part("title", 6, 80) + part("summary", 20, 500) + F.when(contains_any(F.col("author_name"), trusted), 5.0).otherwise(0.0)
    return F.round(out, 1)


def status(rejected: Column, score: Column, matched_must: Column, summary: Column, popularity: Column, article: Column | None = None, *, accept: float, review: float, least_summary: int, least_popularity: int) -> Column:
    """accepted, review or rejected (X16, X17): a hard reject or a score below ``review`` rejects; a score below ``accept``, no core word, a short summary, low popularity or, where articles are asked for, no article is for review.

    ``matched_must`` is null where no core words are given.
    """
    weak = (F.char_length(F.coalesce(summary, F.lit(""))) < least_summary) | (F.coalesce(popularity, F.lit(0)) < least_popularity) | F.coalesce(matched_must == 0, F.lit(False))
    if article is not None:
        weak = weak | ~F.coalesce(article, F.lit(False))
    return F.when(F.coalesce(rejected, F.lit(False)) | (score < review), "rejected").when(weak | (score < accept), "review").otherwise("accepted")


def dedup(c: DataFrame, key: str, strength: Column, order: str) -> DataFrame:
    """The strongest candidate of each key, the earliest of equal ones, with all sources in order of arrival."""
    best = F.max_by(F.struct("candidate_id", "title", "url"), F.struct(strength, -F.col(order)))
    sources = F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col("source_query").alias("q"))))
    g = c.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("b"), sources.alias("s"))
    return g.select(key, "b.candidate_id", "b.title", F.array_distinct(F.transform("s", lambda x: x["q"])).alias("sources"))


def match_decisions(decisions: DataFrame, pool: DataFrame) -> DataFrame:
    """Decisions matched by hash, else by normal address (J20): (decision_id, candidate_id)."""
    p = pool.select("candidate_id", F.col("url_hash").alias("ph"), url_normalize(F.col("url")).alias("pu"))
    by_hash = p.where("ph is not null").groupBy("ph").agg(F.min("candidate_id").alias("by_hash"))
    by_url = p.groupBy("pu").agg(F.min("candidate_id").alias("by_url"))
    d = decisions.withColumn("pu", url_normalize(F.col("url"))).join(by_hash, F.col("url_hash") == F.col("ph"), "left").join(by_url, "pu", "left")
    return d.select("decision_id", F.coalesce("by_hash", "by_url").alias("candidate_id"))


def query_plan(topics: DataFrame, topic: str, n: int, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """The first n distinct queries of each topic by template (X21): (topic, pos, query, intent)."""
    t = F.trim(F.col(topic))
    made = F.array(*[F.struct(F.lit(i).alias("pos"), F.trim(F.concat(t, F.lit(s))).alias("query"), F.lit(k).alias("intent")) for i, (s, k) in enumerate(templates or QUERY_TEMPLATES)])
    kept = F.slice(F.filter(made, lambda x: x["query"] != ""), 1, n)
    return topics.where(t != "").select(t.alias("topic"), F.explode(kept).alias("x")).select("topic", "x.*")
