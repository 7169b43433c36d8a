"""Column expressions over requests, trips, routes, annotations and article blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wayfold.functions.strings import snippet, stable_id
from wayfold.functions.text import strip

#: Windows in seconds.
WINDOWS = {"1h": 3600, "6h": 21_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}
#: Limits of an annotation's lists and summary, and what stands in for missing parts.
MOST_TAGS, MOST_REASONS, MOST_EVIDENCE, MOST_SUMMARY = 6, 5, 5, 280
NO_TITLE, NO_SUMMARY, NO_REASON = "知乎攻略素材", "这条素材没有结构化摘要，保留标题和筛选信号供复核。", "主题相关性待复核"
#: Formats of composed texts.
INTRO = {"title": 'This article focuses on "%s".', "types": "Its primary types are %s.", "keywords": "Important keywords include %s.", "headings": "Key sections cover %s."}
ROUTE = {"metres": "距离约 %.1f 公里", "minutes": "耗时约 %.0f 分钟", "cost": "费用约 %.0f"}
CLIMATE = "%d月: %.0f-%.0f°C, 降水%.0fmm, 极端天气风险=%s"
EVIDENCE = {"votes": "赞同 %d", "comments": "评论 %d", "query": "命中搜索：%s", "scope": "来源范围：%s"}
#: Words of preferences, in order.
ALTITUDE = [("不接受高海拔", ["不接受高海拔", "不能高海拔", "怕高反", "高反严重", "不去高海拔"]), ("可接受高海拔", ["接受高海拔", "能接受高海拔", "可以高海拔", "高反没问题", "能接受高反"])]
DRIVING = [("控制日均驾驶", ["不接受长途", "不想长途", "少开车", "每天少开", "不想开太久"]), ("可接受较长日均驾驶", ["接受长途", "能接受长途", "可以长途", "高强度自驾", "长途没问题"])]
PACE = [("轻松", ["轻松", "慢"]), ("紧凑", ["紧凑", "多打卡"]), ("均衡", ["均衡"])]
NATURE = ["自然风光", "自然", "风景", "雪山", "峡谷", "湖泊", "森林", "草原", "徒步"]


def window_seconds(c: Column, default: str = "24h") -> Column:
    """The length of a named window; the default's for any other text."""
    key = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.lit(WINDOWS[default])
    for k, v in WINDOWS.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def clamp(c: Column, default: int, low: int, high: int) -> Column:
    """A requested number inside its bounds; the default when null or not positive."""
    return F.when(F.coalesce(c, F.lit(0)) <= 0, default).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def history_id(user: Column, ts: Column, article: Column) -> Column:
    """user|nanoseconds|article."""
    return F.concat_ws("|", F.coalesce(user, F.lit("")), (F.unix_micros(ts) * 1000).cast("string"), F.coalesce(article, F.lit("")))


def memory_chunk_id(user: Column, kind: Column, bucket: Column, index: Column, version: Column) -> Column:
    """user|type|bucket|index|version."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (user, kind, bucket, index, version)])


def _labelled(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    out = F.lit("")
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def trip_facts(text: Column) -> Column:
    """struct<start_city, days, budget, altitude, driving, pace, nature> of what was said of a trip (X25, X26); empty texts and 0 for what wasn't."""
    t = F.coalesce(text, F.lit(""))
    money = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*([wW万])", 1)
    long_way = F.contains(t, F.lit("长途"))
    willing = F.lit(False)
    for w in ("能接受", "可接受", "接受", "可以"):
        willing = willing | F.contains(t, F.lit(w))
    driving = _labelled(t, DRIVING)
    nature = F.lit(False)
    for w in NATURE:
        nature = nature | F.contains(t, F.lit(w))
    return F.struct(
        F.regexp_extract(t, r"从[ \t\n]*([\p{IsHan}A-Za-z]{2,12})[ \t\n]*出发", 1).alias("start_city"),
        F.coalesce(F.nullif(F.regexp_extract(t, r"([0-9]{1,4})[ \t\n]*天", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("days"),
        F.when(money != "", F.concat(money, F.lit("万"))).otherwise("").alias("budget"),
        _labelled(t, ALTITUDE).alias("altitude"),
        F.when((driving == "") & willing & long_way, "可接受较长日均驾驶").otherwise(driving).alias("driving"),
        _labelled(t, PACE).alias("pace"),
        nature.alias("nature"),
    )


def route_text(label: Column, metres: Column, minutes: Column, cost: Column, notes: Column) -> Column:
    """What is known of a route in one line."""
    told = [label, *(F.when(c > 0, F.format_string(ROUTE[k], c / d)) for k, c, d in (("metres", metres, 1000), ("minutes", minutes, 1.0), ("cost", cost, 1.0)))]
    return F.concat_ws("，", *told, F.nullif(notes, F.lit("")))


def climate_text(month: Column, low: Column, high: Column, rain: Column, risk: Column) -> Column:
    """One month's climate in words."""
    return F.format_string(CLIMATE, month, low, high, rain, risk)


def annotation(trip: Column, topic: Column, title: Column, summary: Column, url: Column, status: Column, selected: Column, intent: Column, scope: Column, reasons: Column, votes: Column, comments: Column, query: Column) -> Column:
    """A candidate as a map annotation (X46): struct<id, title, summary, status, tags, reasons, evidence>; null without title and summary."""
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    first = lambda a, n: F.slice(F.array_distinct(F.filter(F.transform(a, lambda x: strip(x)), lambda x: x != "")), 1, n)
    state = F.when(F.coalesce(selected, F.lit(False)) | (text(status) == "selected"), "selected").when(text(status) == "rejected", "rejected").when(text(status).isin("accepted", "review"), "review").otherwise("raw")
    key = F.when(text(url) != "", text(url)).otherwise(F.concat(text(title), text(summary)))
    kept = F.slice(F.coalesce(reasons, F.array().cast("array<string>")), 1, MOST_REASONS)
    evidence = [*(F.when(c > 0, F.format_string(EVIDENCE[k], c)) for k, c in (("votes", votes), ("comments", comments))), *(F.when(text(c) != "", F.format_string(EVIDENCE[k], c)) for k, c in (("query", query), ("scope", scope)))]
    made = F.struct(
        stable_id("ann-", F.lit("zhihu"), trip, topic, key).alias("id"),
        F.when(text(title) != "", text(title)).otherwise(NO_TITLE).alias("title"),
        snippet(F.when(text(summary) != "", summary).otherwise(NO_SUMMARY), MOST_SUMMARY).alias("summary"),
        state.alias("status"),
        first(F.array(F.lit("知乎"), state, text(intent), text(scope)), MOST_TAGS).alias("tags"),
        F.when(F.size(kept) == 0, F.array(F.lit(NO_REASON))).otherwise(kept).alias("reasons"),
        F.slice(F.filter(F.array(*evidence), lambda x: x.isNotNull()), 1, MOST_EVIDENCE).alias("evidence"),
    )
    return F.when((text(title) != "") | (text(summary) != ""), made)


def image_groups(blocks: Column) -> Column:
    """Runs of image blocks (struct<type, text>) as arrays of addresses (X42); any other block ends a run, blank addresses are left out."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("run"))
    close = lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"])

    def step(s, b):
        image, url = F.lower(strip(b["type"])) == "image", strip(F.coalesce(b["text"], F.lit("")))
        run = F.when(image, F.concat(s["run"], F.when(url != "", F.array(url)).otherwise(empty))).otherwise(empty)
        return F.struct(F.when(image, s["done"]).otherwise(close(s)).alias("done"), run.alias("run"))

    return F.coalesce(F.aggregate(blocks, start, step, close), F.array().cast("array<array<string>>"))


def image_chunk(urls: Column) -> Column:
    """struct<content_type, content> of a run: one address as it is, several as a JSON array."""
    return F.when(F.size(urls) > 1, F.struct(F.lit("multi_images").alias("content_type"), F.to_json(urls).alias("content"))).when(F.size(urls) == 1, F.struct(F.lit("image").alias("content_type"), urls[0].alias("content")))


def coarse_text(title: Column, type_tags: Column, keywords: Column, headings: Column, keyword_score: Column) -> Column:
    """The text that stands for an article in coarse recall (X42); tags, keywords and headings are arrays."""
    part = lambda name, a, sep: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}: "), F.array_join(a, sep)))
    title = strip(F.coalesce(title, F.lit("")))
    lists = (("types", type_tags), ("keywords", F.slice(keywords, 1, 6)), ("headings", F.slice(headings, 1, 4)))
    intro = [F.when(title != "", F.format_string(INTRO["title"], title)), *(F.when(F.size(a) > 0, F.format_string(INTRO[k], F.array_join(a, ", "))) for k, a in lists)]
    told = F.concat_ws(" ", *intro)
    return F.concat_ws("\n", F.concat(F.lit("title: "), title), part("type_tags", type_tags, ", "), part("keywords", keywords, ", "), part("headings", headings, " | "), F.when(told != "", F.concat(F.lit("intro: "), told)), F.concat(F.lit("keyword_score: "), F.format_string("%.1f", keyword_score)))


def inlined(url: Column) -> Column:
    """Whether an image address must be sent as data, as its host can't be reached from outside (S21): loopback, private and link-local addresses and names without a dot; not data or other schemes."""
    url = strip(F.coalesce(url, F.lit("")))
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    near = host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)") | (host == "") | ~F.contains(host, F.lit("."))
    return url.rlike(r"^https?://") & near


def final_json(answer: Column, weather: Column, seasonal: Column, review: Column) -> Column:
    """The assembled answer (X48): notes without repeats, in order."""
    return F.to_json(F.struct(answer.alias("answer"), F.array_distinct(weather).alias("weather_notes"), F.array_distinct(seasonal).alias("seasonal_events"), review.alias("constraint_review_summary"), F.lit(False).alias("insufficient_information")))


def first_unique(values: Column, n: int, fold: bool = False) -> Column:
    """The first n distinct nonblank values, trimmed; compared without case if ``fold``."""
    kept = F.filter(F.transform(values, lambda x: strip(x)), lambda x: x != "")
    key = F.transform(kept, F.lower) if fold else kept
    return F.slice(F.filter(kept, lambda x, i: F.array_position(key, F.lower(x) if fold else x) == i + 1), 1, n)
