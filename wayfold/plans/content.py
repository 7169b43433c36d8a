"""Queries of ids, requests, annotations, routes, article texts, messages and service calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.functions import content as cx, strings as fx
from wayfold.functions.text import nonblank, strip
from wayfold.operators import markdown, vectors
from wayfold.plans.registry import Registry
from wayfold.runtime import load
from wayfold.sources import services
from wayfold.streaming import sinks

R = Registry()
_WS = "chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)"
_CAND = "zhihu_guide_candidates"


def _cases(value, rules, default="''"):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({value}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in rules) + f" ELSE {default} END"


@R.query("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 3600 WHEN 1 THEN 21600 WHEN 3 THEN 604800 WHEN 4 THEN 2592000 ELSE 86400 END AS seconds FROM events""")
def window_bounds(spark, d):
    """Windows by name; anything else is the default."""
    names = F.array(*[F.lit(x) for x in ("1h", " 6H ", "24h", "7d", "30D", "2w", "")])
    return load(spark, d, "events").select("event_id", cx.window_seconds(F.element_at(names, (F.col("event_id") % 7 + 1).cast("int"))).alias("seconds"))


@R.query("SELECT event_id, CASE WHEN k <= 0 THEN 10 ELSE least(k, 50) END AS topk, CASE WHEN 3 * k <= 0 THEN 40 ELSE least(greatest(3 * k, 10), 100) END AS recall FROM (SELECT event_id, event_id % 70 - 5 AS k FROM events)")
def request_clamps(spark, d):
    """Requested numbers inside their bounds, or the default."""
    k = F.col("event_id") % 70 - 5
    return load(spark, d, "events").select("event_id", cx.clamp(k, 10, 1, 50).alias("topk"), cx.clamp(3 * k, 40, 10, 100).alias("recall"))


@R.query("SELECT coalesce(user_id, '') || '|' || (epoch_us(ts) * 1000) || '|' || article_id AS id, count(*) AS n FROM user_rec_history GROUP BY 1")
def history_ids(spark, d):
    """Ids of history rows; rows delivered twice have one id."""
    h = load(spark, d, "user_rec_history")
    return h.groupBy(cx.history_id(F.col("user_id"), F.col("ts").cast("timestamp"), F.col("article_id")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT user_id || '|' || pool_type || '|' || coalesce(period_bucket, '') || '|' || n || '|' || floor(epoch(inserted_at))::BIGINT AS id FROM (SELECT *, length(article_id) AS n FROM user_pool_items)")
def memory_chunk_ids(spark, d):
    """Ids of memory chunks with their version."""
    p = load(spark, d, "user_pool_items")
    return p.select(cx.memory_chunk_id(F.col("user_id"), F.col("pool_type"), F.col("period_bucket"), F.char_length("article_id"), F.floor(F.unix_micros(F.col("inserted_at").cast("timestamp")) / 1_000_000)).alias("id"))


@R.query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('，', 'p' || l_partkey, '距离约 ' || printf('%.1f', l_quantity::INT * 100 / 1000.0) || ' 公里', CASE WHEN l_linenumber > 1 THEN '耗时约 ' || l_linenumber || ' 分钟' END, nullif(l_returnflag, 'N')) AS told FROM lineitem""")
def route_text(spark, d):
    """What is known of each route."""
    l = load(spark, d, "lineitem")  # noqa: E741
    told = cx.route_text(F.concat(F.lit("p"), "l_partkey"), F.col("l_quantity") * 100, F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("double")), F.lit(0.0), F.nullif("l_returnflag", F.lit("N")))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", told.alias("told"))


@R.query("""WITH m AS (SELECT c_nationkey AS region, month(o_orderdate) AS m, floor(min(o_totalprice) / 1000) AS lo, floor(max(o_totalprice) / 1000) AS hi, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
  SELECT region, string_agg(m || '月: ' || lo::BIGINT || '-' || hi::BIGINT || '°C, 降水' || n || 'mm, 极端天气风险=' || CASE WHEN hi > 400 THEN 'high' ELSE 'low' END, '; ' ORDER BY m) AS told FROM m GROUP BY 1""")
def climate_text(spark, d):
    """Each region's climate by month in words."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    price = lambda f: F.floor(f("o_totalprice") / 1000).cast("double")
    m = load(spark, d, "orders").join(c, "o_custkey").groupBy("region", F.month("o_orderdate").alias("m")).agg(price(F.min).alias("lo"), price(F.max).alias("hi"), F.count(F.lit(1)).cast("double").alias("n"))
    told = cx.climate_text(F.col("m"), F.col("lo"), F.col("hi"), F.col("n"), F.when(F.col("hi") > 400, "high").otherwise("low"))
    return m.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("m", told.alias("t")))), lambda x: x["t"]), "; ").alias("told"))  # at most twelve months


_T = lambda c: f"trim(coalesce({c}, ''), {_WS})"
_STATE = f"CASE WHEN coalesce(score > 80, FALSE) OR {_T('status')} = 'selected' THEN 'selected' WHEN {_T('status')} = 'rejected' THEN 'rejected' WHEN {_T('status')} IN ('accepted', 'review') THEN 'review' ELSE 'raw' END"
_SUMMARY = f"trim(regexp_replace(CASE WHEN {_T('summary')} <> '' THEN summary ELSE '{cx.NO_SUMMARY}' END, '[ \\t\\r\\n]+', ' ', 'g'), {_WS})"


@R.query(f"""SELECT candidate_id, 'ann-' || substr(sha1('zhihu|' || run_id || '|' || source_query || '|' || CASE WHEN {_T('url')} <> '' THEN {_T('url')} ELSE {_T('title')} || {_T('summary')} END), 1, 16) AS id, CASE WHEN {_T('title')} <> '' THEN {_T('title')} ELSE '{cx.NO_TITLE}' END AS title,
  CASE WHEN length({_SUMMARY}) > 280 THEN substr({_SUMMARY}, 1, 280) || '...' ELSE {_SUMMARY} END AS summary, {_STATE} AS status,
  list_filter(['知乎', {_STATE}, {_T('source_intent')}, {_T('search_scope')}], lambda x, i: x <> '' AND list_position(['知乎', {_STATE}, {_T('source_intent')}, {_T('search_scope')}], x) = i)[1:6] AS tags,
  CASE WHEN len(coalesce(reasons, [])) = 0 THEN ['{cx.NO_REASON}'] ELSE reasons[1:5] END AS reasons,
  list_filter([CASE WHEN vote_up_count > 0 THEN '赞同 ' || vote_up_count END, CASE WHEN comment_count > 0 THEN '评论 ' || comment_count END, CASE WHEN {_T('source_query')} <> '' THEN '命中搜索：' || source_query END, CASE WHEN {_T('search_scope')} <> '' THEN '来源范围：' || search_scope END], lambda x: x IS NOT NULL)[1:5] AS evidence
  FROM {_CAND} WHERE {_T('title')} <> '' OR {_T('summary')} <> ''""")
def guide_annotations(spark, d):
    """Candidates as annotations."""
    c = load(spark, d, _CAND)
    a = cx.annotation(*[F.col(x) for x in ("run_id", "source_query", "title", "summary", "url", "status")], F.col("score") > 80, *[F.col(x) for x in ("source_intent", "search_scope", "reasons", "vote_up_count", "comment_count", "source_query")])
    return c.select("candidate_id", a.alias("a")).where("a is not null").select("candidate_id", "a.*")


_WORDS = "coalesce(title, '') || ' ' || coalesce(summary, '')"


@R.query(f"""WITH t AS (SELECT candidate_id, '从' || substr(coalesce(nullif(title, ''), '某地'), 1, 3) || '出发 ' || {_WORDS} || CASE candidate_id % 3 WHEN 0 THEN ' 预算 1.5w' WHEN 1 THEN ' 20 万' ELSE '' END AS t FROM {_CAND}),
  x AS (SELECT *, {_cases('t', cx.DRIVING)} AS dr FROM t)
  SELECT candidate_id, regexp_extract(t, '从[ \\t\\n]*([\\p{{Han}}A-Za-z]{{2,12}})[ \\t\\n]*出发', 1) AS start_city, coalesce(TRY_CAST(nullif(regexp_extract(t, '([0-9]{{1,4}})[ \\t\\n]*天', 1), '') AS INT), 0) AS days,
    CASE WHEN regexp_extract(t, '([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([wW万])', 1) <> '' THEN regexp_extract(t, '([0-9]+(?:\\.[0-9]+)?)[ \\t\\n]*([wW万])', 1) || '万' ELSE '' END AS budget, {_cases('t', cx.ALTITUDE)} AS altitude,
    CASE WHEN dr = '' AND (contains(t, '能接受') OR contains(t, '可接受') OR contains(t, '接受') OR contains(t, '可以')) AND contains(t, '长途') THEN '可接受较长日均驾驶' ELSE dr END AS driving, {_cases('t', cx.PACE)} AS pace, {' OR '.join(f"contains(t, '{w}')" for w in cx.NATURE)} AS nature FROM x""")
def trip_facts(spark, d):
    """Start city, days, budget and preferences in what was said."""
    lead = F.concat(F.lit("从"), F.substring(F.coalesce(F.nullif("title", F.lit("")), F.lit("某地")), 1, 3), F.lit("出发 "))
    money = F.when(F.col("candidate_id") % 3 == 0, " 预算 1.5w").when(F.col("candidate_id") % 3 == 1, " 20 万").otherwise("")
    text = F.concat(lead, F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")), money)
    return load(spark, d, _CAND).select("candidate_id", cx.trip_facts(text).alias("f")).select("candidate_id", "f.*")


_IMG = "regexp_full_match(l, 'https?://[^ ]+[.](jpg|jpeg|png|webp)')"


@R.query(f"""WITH b AS (SELECT chunk_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT chunk_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ls FROM article_chunks)),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY chunk_id ORDER BY i) AS run FROM b WHERE {_IMG}), r AS (SELECT chunk_id, min(i) AS lead, list(l ORDER BY i) AS urls FROM g GROUP BY chunk_id, run)
  SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY lead)::INT AS no, CASE WHEN len(urls) > 1 THEN 'multi_images' ELSE 'image' END AS content_type, len(urls)::INT AS n FROM r""")
def image_group_chunks(spark, d):
    """Runs of image lines of each chunk, as image chunks."""
    lines = F.filter(F.transform(F.split("content", "\n"), strip), lambda x: x != "")
    blocks = F.transform(lines, lambda l: F.struct(F.when(l.rlike(r"^https?://[^ ]+[.](jpg|jpeg|png|webp)$"), "image").otherwise("text").alias("type"), l.alias("text")))
    g = load(spark, d, "article_chunks").where("content is not null").select("chunk_id", F.posexplode(cx.image_groups(blocks)).alias("p", "urls"))
    return g.select("chunk_id", (F.col("p") + 1).alias("no"), cx.image_chunk(F.col("urls")).alias("c"), F.size("urls").alias("n")).select("chunk_id", "no", "c.content_type", "n")


@R.query(f"""WITH h AS (SELECT article_id, list({_T('h2')} ORDER BY chunk_id) AS h FROM article_chunks WHERE {_T('h2')} <> '' GROUP BY 1), a AS (SELECT article_id, trim(coalesce(title, ''), chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)) AS t, CASE WHEN {_T('type_tags')} <> '' THEN [{_T('type_tags')}] ELSE [] END AS y, coalesce(h, []) AS h FROM articles LEFT JOIN h USING (article_id)),
  i AS (SELECT *, concat_ws(' ', CASE WHEN t <> '' THEN 'This article focuses on "' || t || '".' END, CASE WHEN len(y) > 0 THEN 'Its primary types are ' || array_to_string(y, ', ') || '.' END, CASE WHEN len(h) > 0 THEN 'Key sections cover ' || array_to_string(h[1:4], ', ') || '.' END) AS intro FROM a)
  SELECT article_id, concat_ws(chr(10), 'title: ' || t, CASE WHEN len(y) > 0 THEN 'type_tags: ' || array_to_string(y, ', ') END, CASE WHEN len(h) > 0 THEN 'headings: ' || array_to_string(h, ' | ') END, CASE WHEN intro <> '' THEN 'intro: ' || intro END, 'keyword_score: 0.4') AS coarse FROM i""")
def coarse_text(spark, d):
    """The text that stands for an article in coarse recall."""
    none = F.array().cast("array<string>")
    heads = load(spark, d, "article_chunks").where(nonblank(F.col("h2")).isNotNull()).groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", nonblank(F.col("h2")).alias("h")))), lambda x: x["h"]).alias("h"))
    a = load(spark, d, "articles").join(heads, "article_id", "left")
    tags = F.when(nonblank(F.col("type_tags")).isNotNull(), F.array(nonblank(F.col("type_tags")))).otherwise(none)
    return a.select("article_id", cx.coarse_text(F.col("title"), tags, none, F.coalesce("h", none), F.lit(0.4)).alias("coarse"))


@R.query("""SELECT event_id, 'event: ' || event_type || chr(10) || 'data: {"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' || chr(10) || chr(10) AS text FROM events""")
def server_sent_events(spark, d):
    """Events in the form of a server-sent stream."""
    e = load(spark, d, "events").select("event_id", "event_type", "user_id")
    return sinks.server_sent(e, F.col("event_type"), [F.col("event_id")]).withColumnRenamed("o0", "event_id")


@R.query("""SELECT user_id::VARCHAR AS key, '{"user_id":' || user_id || ',"n":' || count(*) || '}' AS value FROM events GROUP BY user_id""")
def result_messages(spark, d):
    """Results as messages under their key."""
    return sinks.messages(load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")


@R.query("""SELECT 'events_total{event_type="' || event_type || '",day="' || strftime(ts, '%Y-%m-%d') || '"} ' || count(*) AS line FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')""")
def metric_lines(spark, d):
    """Counters in the text form of metric scrapers."""
    e = load(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.exposition(e, "events_total", ["event_type", "day"], "n")


@R.query("""WITH b AS (SELECT * FROM (VALUES ('5', 5.0), ('25', 25.0), ('100', 100.0), ('+Inf', NULL)) b(le, hi)) SELECT event_type, le, count(*) FILTER (hi IS NULL OR value <= hi) AS n FROM events, b GROUP BY 1, 2""")
def cumulative_histogram(spark, d):
    """A cumulative histogram by label."""
    return sinks.cumulative_buckets(load(spark, d, "events"), "value", [5.0, 25.0, 100.0], ["event_type"])


@R.query("SELECT event_id, event_type, upper(event_type) || '!' AS answer FROM events")
def limited_calls(spark, d):
    """A service called on each row by a few workers at a shared rate."""
    e = load(spark, d, "events").select("event_id", "event_type")
    return services.limited_map(e, "event_type", lambda x: x.upper() + "!", "answer", workers=4, per_second=1e9)


@R.query("""SELECT n_nationkey, CASE WHEN trim(n_name) <> '' AND n_nationkey % 4 <> 0 THEN '{"endpoint":"geocode","address":"' || n_name || '"}' END AS request, CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey % 2 = 0 END AS ok FROM nation""")
def map_calls(spark, d):
    """Parameters of a map endpoint, sent where they are whole, and the answers' envelopes."""
    n = load(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("address"))
    even = {r["n_name"]: r["n_nationkey"] % 2 == 0 for r in load(spark, d, "nation").select("n_name", "n_nationkey").limit(1000).collect()}  # the offline service's answers: a fixed table of 25 rows

    def call(request: str) -> str:
        import json

        return json.dumps({"status": "1" if even[json.loads(request)["address"]] else "0", "info": "x"})

    out = services.map_requests(n, "geocode", call, workers=2, per_second=1e9)
    return out.select("n_nationkey", "request", services.envelope(F.col("answer"))["ok"].alias("ok"))


@R.query("""WITH q AS (SELECT list_distinct(list_filter(string_split(lower('周末 Lake 夜市'), ''), lambda x: x <> '')) AS q) SELECT chunk_id, round(len(list_filter(q, lambda x: contains(lower(content), x))) / len(q)::DOUBLE, 6) AS score FROM article_chunks, q WHERE content IS NOT NULL""")
def lexical_scores(spark, d):
    """The offline rerank score of every chunk."""
    c = load(spark, d, "article_chunks").where("content is not null")
    return c.select("chunk_id", F.round(services.lexical_rerank(F.lit("周末 Lake 夜市"), F.col("content")), 6).alias("score"))


@R.query("""SELECT user_id, article_id, row_number() OVER (PARTITION BY user_id ORDER BY round(coalesce(s, 0) + coalesce(r, 0), 6) DESC, coalesce(r, 0) DESC, coalesce(s, 0) DESC, pos)::INT AS place FROM
    (SELECT user_id, article_id, max(CASE WHEN isnan(score) THEN NULL ELSE score::DOUBLE END) AS s, max(remark_score::DOUBLE) AS r, min((inserted_at, article_id)) AS pos FROM user_pool_items GROUP BY 1, 2) QUALIFY place <= 20""")
def candidate_order(spark, d):
    """Candidates by boosted score, then boost, then score, then place of arrival."""
    s = F.col("score").cast("double")
    p = load(spark, d, "user_pool_items").groupBy("user_id", "article_id").agg(F.max(F.when(~F.isnan(s), s)).alias("s"), F.max(F.col("remark_score").cast("double")).alias("r"), F.min(F.struct("inserted_at", "article_id")).alias("pos"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    w = F.row_number().over(vectors.Window.partitionBy("user_id").orderBy(F.round(z("s") + z("r"), 6).desc(), z("r").desc(), z("s").desc(), "pos"))
    return p.withColumn("place", w).where("place <= 20").select("user_id", "article_id", "place")


@R.query(f"""WITH s AS (SELECT candidate_id, list_filter(list_transform(coalesce(reasons, []), lambda x: trim(x, {_WS})), lambda x: x <> '') AS r FROM {_CAND}), u AS (SELECT candidate_id, list_concat(r, list_transform(r, lambda x: lower(x))) AS r FROM s)
  SELECT candidate_id, list_filter(r, lambda x, i: list_position(list_transform(r, lambda y: lower(y)), lower(x)) = i)[1:2] AS firsts FROM u""")
def first_unique_n(spark, d):
    """The first two distinct reasons, without regard to case."""
    r = F.coalesce("reasons", F.array().cast("array<string>"))
    return load(spark, d, _CAND).select("candidate_id", cx.first_unique(F.concat(r, F.transform(r, F.lower)), 2, fold=True).alias("firsts"))


@R.query("SELECT user_id, round(coalesce(avg(similarity::DOUBLE), 0), 5) AS coverage_score FROM user_pool_items GROUP BY 1")
def mean_similarity(spark, d):
    """The mean similarity of what was recalled."""
    return load(spark, d, "user_pool_items").groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.col("similarity").cast("double")), F.lit(0.0)), 5).alias("coverage_score"))


@R.query("""SELECT vec_id AS id, vec_id % 9 AS rank, coalesce(nullif(trim(text), ''), 'own ' || vec_id) AS content FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")
def memory_backfill(spark, d):
    """Hits with the content of the relational side, else their own."""
    hits = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 9).alias("rank"), F.concat(F.lit("own "), "vec_id").alias("content"))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.trim("text").alias("content"))
    return vectors.backfill(hits, docs, "id", "content")


@R.query("SELECT user_id, article_id, inserted_at FROM user_pool_items WHERE (user_id, inserted_at) IN (SELECT user_id, max(inserted_at) FROM user_pool_items GROUP BY 1)")
def latest_version(spark, d):
    """rows of each user's newest version."""
    return vectors.latest_version(load(spark, d, "user_pool_items").select("user_id", "article_id", "inserted_at"), ["user_id"], "inserted_at")


@R.query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS block FROM events""")
def json_blocks(spark, d):
    """The JSON block inside a model's text."""
    text = F.when(F.col("event_id") % 3 == 0, F.lit("none here")).otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done")))
    return load(spark, d, "events").select("event_id", fx.json_block(text).alias("block"))


@R.query("""SELECT o_orderkey, list_filter(ps, lambda x, i: i = 1 OR x <> ps[i - 1]) AS points FROM (SELECT o_orderkey, [o_custkey % 170 + 1, o_custkey % 170 + 1, o_orderkey % 170 + 1, (o_custkey + o_orderkey) % 170 + 1] AS ps FROM orders)""")
def polyline_points(spark, d):
    """Points of a route's nested steps, consecutive repeats dropped; here the longitudes."""
    a, b = F.col("o_custkey") % 170 + 1, F.col("o_orderkey") % 170 + 1
    point = lambda x: F.concat(x.cast("string"), F.lit(",5"))
    steps = F.to_json(F.array(F.struct(F.concat(point(a), F.lit(";"), point(a)).alias("polyline")), F.struct(F.concat(F.lit("0,0;"), point(b), F.lit(";x")).alias("polyline")), F.struct(point((F.col("o_custkey") + F.col("o_orderkey")) % 170 + 1).alias("polyline"))))
    return load(spark, d, "orders").select("o_orderkey", F.transform(fx.polyline_points(steps), lambda p: p["lng"].cast("bigint")).alias("points"))


@R.query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://map.example/static?location=' || (s_suppkey % 180) || '.5,' || (s_suppkey % 90) || '.25&zoom=10&size=400*400&key=k' END AS url FROM supplier")
def static_map_urls(spark, d):
    """Addresses of map images; none for an invalid place."""
    lng = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey") % 180 + 0.5).otherwise(500.0)
    return load(spark, d, "supplier").select("s_suppkey", fx.static_map_url("https://map.example/static", "k", lng.cast("double"), (F.col("s_suppkey") % 90 + 0.25).cast("double")).alias("url"))


@R.query("""SELECT n_regionkey AS region, '{"answer":"r' || n_regionkey || '","weather_notes":["' || n_regionkey || '"],"seasonal_events":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || '],"constraint_review_summary":"ok","insufficient_information":false}' AS answer FROM nation GROUP BY 1""")
def final_assembly(spark, d):
    """An answer assembled from notes without repeats."""
    g = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    note = F.array(F.col("region").cast("string"), F.col("region").cast("string"))
    return g.select("region", cx.final_json(F.concat(F.lit("r"), "region"), note, F.concat("names", "names"), F.lit("ok")).alias("answer"))


@R.query("""WITH j AS (SELECT article_id AS id, coalesce(nullif(trim(CASE WHEN article_id LIKE '%1' THEN ' override ' ELSE '' END), ''), nullif(trim(title), ''), '') AS title FROM articles) SELECT id AS article_id, title FROM j""")
def article_json(spark, d):
    """Articles read from JSON, their fields overridden by nonblank arguments."""
    a = load(spark, d, "articles").select(F.to_json(F.struct("article_id", "title")).alias("json"), F.when(F.col("article_id").like("%1"), " override ").otherwise("").alias("over"))
    p = a.select(F.from_json("json", "article_id string, title string").alias("a"), "over")
    return p.select("a.article_id", F.coalesce(F.nullif(F.trim("over"), F.lit("")), F.nullif(F.trim("a.title"), F.lit("")), F.lit("")).alias("title"))


@R.query("""WITH a AS (SELECT l_orderkey AS node, l_linenumber AS attempt, bool_and(l_quantity > 25) AS passed FROM lineitem GROUP BY 1, 2), f AS (SELECT node, min(attempt) FILTER (passed AND attempt <= 3) AS won FROM a GROUP BY 1)
  SELECT node, CASE WHEN won IS NOT NULL THEN 'approved' ELSE 'blocked' END AS status, coalesce(won, 3)::INT AS attempts FROM f""")
def review_retries(spark, d):
    """Reviews of each attempt; approved by the first of three in which all pass, else blocked."""
    a = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("attempt")).agg(F.bool_and(F.col("l_quantity") > 25).alias("passed"))
    f = a.groupBy("node").agg(F.min(F.when(F.col("passed") & (F.col("attempt") <= 3), F.col("attempt"))).alias("won"))
    return f.select("node", F.when(F.col("won").isNotNull(), "approved").otherwise("blocked").alias("status"), F.coalesce("won", F.lit(3)).alias("attempts"))


@R.query(f"""WITH t AS (SELECT run_id, source_intent AS topic, 0 AS level, min(candidate_id) AS seen FROM {_CAND} WHERE trim(coalesce(source_intent, '')) <> '' GROUP BY 1, 2 UNION ALL SELECT run_id, source_query, 1, min(candidate_id) FROM {_CAND} WHERE trim(coalesce(source_query, '')) <> '' GROUP BY 1, 2
    UNION ALL SELECT run_id, trim(substr(run_id, 17)), 2, 0 FROM {_CAND} WHERE trim(substr(run_id, 17)) <> '' GROUP BY 1),
  u AS (SELECT run_id, topic, min((level, seen)) AS pos FROM t GROUP BY 1, 2) SELECT run_id, topic, row_number() OVER (PARTITION BY run_id ORDER BY pos, topic)::INT AS place FROM u QUALIFY place <= 24""")
def guide_topic_union(spark, d):
    """Topics of phases, anchors and the trip united, each once at its first place, at most 24 (the feature's cap)."""
    c = load(spark, d, _CAND)
    of = lambda col, level: c.where(F.trim(F.coalesce(col, F.lit(""))) != "").groupBy("run_id", F.col(col).alias("topic")).agg(F.min("candidate_id").alias("at")).withColumn("level", F.lit(level))
    trip = c.select("run_id", F.trim(F.expr("substring(run_id, 17)")).alias("topic")).where("topic <> ''").distinct().select("run_id", "topic", F.lit(0).cast("bigint").alias("at"), F.lit(2).alias("level"))
    u = of("source_intent", 0).unionByName(of("source_query", 1)).unionByName(trip).groupBy("run_id", "topic").agg(F.min(F.struct("level", "at")).alias("pos"))
    return u.withColumn("place", F.row_number().over(vectors.Window.partitionBy("run_id").orderBy("pos", "topic"))).where("place <= 24").select("run_id", "topic", "place")


_HOST = "lower(regexp_extract(u, '^https?://([^/:?#]*)', 1))"


@R.query(f"""WITH x AS (SELECT candidate_id, CASE candidate_id % 6 WHEN 0 THEN 'http://127.0.0.1/a.png' WHEN 1 THEN 'https://10.1.2.3:80/a' WHEN 2 THEN 'data:image/png;base64,xx' WHEN 3 THEN 'http://images/a' WHEN 4 THEN 'ftp://10.0.0.1/a' ELSE url END AS u FROM {_CAND})
  SELECT candidate_id, regexp_matches(u, '^https?://') AND (regexp_matches({_HOST}, '^(127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') OR {_HOST} = '' OR NOT contains({_HOST}, '.')) AS inlined FROM x WHERE u IS NOT NULL""")
def image_inlining(spark, d):
    """Image addresses that must be sent as data."""
    n = F.col("candidate_id") % 6
    u = F.when(n == 0, "http://127.0.0.1/a.png").when(n == 1, "https://10.1.2.3:80/a").when(n == 2, "data:image/png;base64,xx").when(n == 3, "http://images/a").when(n == 4, "ftp://10.0.0.1/a").otherwise(F.col("url"))
    return load(spark, d, _CAND).withColumn("u", u).where("u is not null").select("candidate_id", cx.inlined(F.col("u")).alias("inlined"))


@R.query(f"""WITH l AS (SELECT doc_id, coalesce(title, 'untitled') AS fallback, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_WS})) AS ls FROM documents)
  SELECT doc_id, coalesce(nullif(trim(substr(list_filter(ls, lambda x: starts_with(x, '# '))[1], 3), {_WS}), ''), fallback) AS title, list_transform(list_filter(ls, lambda x: starts_with(x, '## ')), lambda x: trim(substr(x, 4), {_WS})) AS headings FROM l""")
def markdown_outline(spark, d):
    """Title and headings of every document read as Markdown."""
    doc = load(spark, d, "documents").select("doc_id", markdown.parse_column(F.col("text"), F.coalesce("title", F.lit("untitled"))).alias("a"))
    heads = F.transform(F.filter("a.sections", lambda s: s["h2"] != ""), lambda s: s["h2"])
    return doc.select("doc_id", "a.title", heads.alias("headings"))


@R.query("SELECT * FROM (VALUES ('keyword_search'), ('pool_get_size'), ('pool_pop_topk'), ('pools_to_refill'), ('text_rerank'), ('title_search'), ('user_history_add'), ('user_history_recent'), ('user_history_similar'), ('user_memory_get'), ('user_memory_upsert'), ('user_memory_hybrid_search'), ('doc_ingest'), ('vector_search')) t(name)")
def tools_catalog(spark, d):
    """The registered tools."""
    from wayfold.engine import Engine, default_tools

    tables = {n: load(spark, d, n) for n in ("articles", "article_chunks", "user_pool_items", "user_rec_history")}
    return spark.createDataFrame([(n,) for n in default_tools(Engine(spark, tables)).names()], "name string")


QUERIES, SQL = R.queries, R.sql
