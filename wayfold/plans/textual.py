"""Text, identifier, address and JSON queries over articles, chunks, candidates and documents."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayfold.functions import strings as fx
from wayfold.functions.text import strip
from wayfold.operators import fusion, markdown, merge
from wayfold.operators.ranking import distributed_rank
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
_BR = fx.SIGNAL_BREAKS.replace("'", "''")
_EDGE = fx.SIGNAL_EDGES.replace("'", "''")


def _sig(c):
    parts = f"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '{_BR}'), lambda x: trim(trim(trim(x), '{_EDGE}'))), lambda x: length(x) >= 2)"
    return f"list_filter({parts}, lambda x, i: list_position(list_transform({parts}, lambda y: lower(y)), lower(x)) = i)"


@R.query(f"SELECT article_id, {_sig('title')} AS signals FROM articles")
def signal_split(spark, d):
    """X4."""
    return load(spark, d, "articles").select("article_id", fx.signals(F.col("title")).alias("signals"))


@R.query(f"SELECT article_id, list_filter({_sig('tags')}, lambda x: length(x) BETWEEN 2 AND 24 AND lower(x) NOT IN ('type', 'title', 'tag', 'tags', 'intro', 'summary')) AS pieces FROM articles")
def keyword_pieces(spark, d):
    """X5."""
    return load(spark, d, "articles").select("article_id", fx.keyword_pieces(F.col("tags")).alias("pieces"))


@R.query(f"SELECT article_id, round(least(len(list_filter({_sig('tags')}, lambda t: contains('旅行攻略', lower(t)) OR contains(lower(t), '旅行攻略') OR contains('美食', lower(t)) OR contains(lower(t), '美食'))), 5) * 0.2, 6) AS boost FROM articles")
def keyword_boost(spark, d):
    """Containment either way between query signals and tags."""
    q = F.array(F.lit("旅行攻略"), F.lit("美食"))
    return load(spark, d, "articles").select("article_id", F.round(fx.keyword_signal_score(q, F.col("tags")), 6).alias("boost"))


@R.query("SELECT vec_id, round(least(vec_id % 9, 5) * 0.2, 6) AS coverage FROM embeddings")
def keyword_coverage(spark, d):
    """X7."""
    return load(spark, d, "embeddings").select("vec_id", F.round(fx.keyword_coverage(F.col("vec_id") % 9), 6).alias("coverage"))


def _edge(c):
    return f"trim(trim(trim({c}), '{_EDGE}'))"


_KEEP = "list_filter({}, lambda x: length(x) BETWEEN 2 AND 24 AND lower(x) NOT IN ('type', 'title', 'tag', 'tags', 'intro', 'summary'))"


@R.query(f"""WITH h AS (SELECT article_id, list(trim(h2) ORDER BY chunk_id) FILTER (trim(coalesce(h2, '')) <> '') AS h FROM article_chunks GROUP BY 1),
  s AS (SELECT a.article_id, {_KEEP.format(_sig('type_tags'))} AS ty, {_KEEP.format(_sig('tags'))} AS tg, list_concat([coalesce(title, '')], coalesce(h, [])) AS x FROM articles a LEFT JOIN h USING (article_id)),
  k AS (SELECT article_id, unnest(ty) AS k, 5 AS w, generate_subscripts(ty, 1) AS n, 0 AS part, 0 AS no FROM s UNION ALL SELECT article_id, unnest(tg), 4, generate_subscripts(tg, 1), 1, 0 FROM s
    UNION ALL SELECT article_id, unnest(l), 4, generate_subscripts(l, 1), 2, no FROM (SELECT article_id, no, {_KEEP.format("list_transform(regexp_extract_all(t, '#([\\p{Han}A-Za-z0-9_\\-]+)', 1), lambda y: " + _edge('y') + ")")} AS l FROM (SELECT article_id, unnest(x) AS t, generate_subscripts(x, 1) AS no FROM s))
    UNION ALL SELECT article_id, unnest(l), 2, generate_subscripts(l, 1), 3, no FROM (SELECT article_id, no, {_KEEP.format(_sig('t'))} AS l FROM (SELECT article_id, unnest(x) AS t, generate_subscripts(x, 1) AS no FROM s))),
  g AS (SELECT article_id, lower(k) AS key, sum(w)::BIGINT AS weight, min((part, no, n)) AS seen, arg_min(k, (part, no, n)) AS keyword FROM k GROUP BY 1, 2)
  SELECT article_id, keyword, weight FROM g QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY weight DESC, length(keyword), seen) <= 5""")
def keyword_detect(spark, d):
    """Weighted keywords from types, tags, hashtags and pieces of title and headings; heavier, shorter and first seen in order."""
    heads = load(spark, d, "article_chunks").where(F.trim(F.coalesce("h2", F.lit(""))) != "").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", F.trim("h2").alias("h")))).alias("h"))
    a = load(spark, d, "articles").join(heads, "article_id", "left")
    texts = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce(F.transform("h", lambda x: x["h"]), F.array().cast("array<string>")))
    a = a.select("article_id", "type_tags", "tags", texts.alias("x"))
    kept = lambda c: F.filter(c, lambda x: F.char_length(x).between(2, 24) & ~F.lower(x).isin(fx.KEYWORD_STOPS))
    edged = lambda c: F.transform(c, lambda y: F.trim(F.btrim(F.trim(y), F.lit(fx.SIGNAL_EDGES))))
    entry = lambda c, w, part, no: F.transform(c, lambda k, n: F.struct(k.alias("k"), F.lit(w).alias("w"), F.struct(F.lit(part).alias("part"), no.alias("no"), n.alias("n")).alias("at")))
    per_text = lambda f, w, part: F.flatten(F.transform("x", lambda t, no: entry(kept(f(t)), w, part, no)))
    zero = F.lit(0)
    every = F.concat(entry(fx.keyword_pieces(F.col("type_tags")), 5, 0, zero), entry(fx.keyword_pieces(F.col("tags")), 4, 1, zero), per_text(lambda t: edged(fx.hashtags(t)), 4, 2), per_text(fx.signals, 2, 3))
    k = a.select("article_id", F.explode(every).alias("e")).groupBy("article_id", F.lower("e.k").alias("key")).agg(F.sum("e.w").alias("weight"), F.min(F.struct("e.at", "e.k")).alias("m"))
    r = F.row_number().over(Window.partitionBy("article_id").orderBy(F.desc("weight"), F.char_length("m.k"), "m.at"))
    return k.withColumn("r", r).where("r <= 5").select("article_id", F.col("m.k").alias("keyword"), "weight")


_WS = "chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288)"
INTENT, TOP_K = "周末 护肤 旅行攻略 预算 日语学习 夜市", 12
_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+'), lambda x: length(x) >= 2))"
_PRE = f"""q AS (SELECT {_SET.format(f"'{INTENT}'")} AS q),
  x AS (SELECT article_id, coalesce(score, 0)::DOUBLE AS s, row_number() OVER (ORDER BY created_at DESC, article_id) - 1 AS i, count(*) OVER () AS n, {_SET.format("coalesce(title, '') || ' ' || coalesce(type_tags, '') || ' ' || coalesce(tags, '')")} AS t,
    coalesce(list_filter(list_transform(string_split(lower(coalesce(type_tags, '')), ','), lambda y: trim(y, {_WS})), lambda y: y <> '')[1], nullif(trim(lower(coalesce(title, '')), {_WS}), ''), 'default') AS cluster FROM articles),
  p AS (SELECT article_id, cluster, i, round(0.35 * s + 0.45 * CASE WHEN len(t) > 0 THEN len(list_intersect(t, q)) / greatest(len(t), len(q))::DOUBLE ELSE 0 END + 0.20 * CASE WHEN n <= 1 THEN 1 ELSE 1 - i / (n - 1)::DOUBLE END, 6) AS score FROM x, q)"""


@R.query(f"WITH {_PRE} SELECT article_id, cluster, score FROM p")
def prefilter_score(spark, d):
    """Every article's score, overlap with the intent and recency, the latter by an explicit order, and its cluster."""
    return _prefilter(spark, d).select("article_id", "cluster", "score")


def _prefilter(spark, d):
    a = load(spark, d, "articles")
    n = a.agg(F.count(F.lit(1)).alias("n"))  # one row
    placed = distributed_rank(a, [], [F.desc("created_at"), F.col("article_id").asc()], "place").crossJoin(n)
    recency = F.when(F.col("n") <= 1, 1.0).otherwise(1 - (F.col("place") - 1) / (F.col("n") - 1))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("type_tags", F.lit("")), F.coalesce("tags", F.lit("")))
    score = 0.35 * F.coalesce(F.col("score").cast("double"), F.lit(0.0)) + 0.45 * fx.overlap(fx.keyword_set(F.lit(INTENT)), fx.keyword_set(text)) + 0.20 * recency
    kinds = F.filter(F.transform(F.split(F.lower(F.coalesce("type_tags", F.lit(""))), ","), lambda y: strip(y)), lambda y: y != "")
    cluster = F.coalesce(F.try_element_at(kinds, F.lit(1)), F.nullif(strip(F.lower(F.coalesce("title", F.lit("")))), F.lit("")), F.lit("default"))
    return placed.select("article_id", cluster.alias("cluster"), F.round(score, 6).alias("score"), "place")


@R.query(f"""WITH {_PRE}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, i) AS turn FROM p), f AS (SELECT cluster, score AS fs, i AS fi FROM r WHERE turn = 1)
  SELECT article_id, cluster, turn, score FROM r JOIN f USING (cluster) ORDER BY turn, fs DESC, fi LIMIT least(greatest(2 * {TOP_K}, 12), 30)""")
def rerank_prefilter(spark, d):
    """The candidates of a reranking: of all articles by score, one of each cluster in turn, 12 to 30 of them (the feature's cap)."""
    best = fusion.round_robin(_prefilter(spark, d), "cluster", [F.desc("score"), F.col("place").asc()], min(max(2 * TOP_K, 12), 30))
    return best.select("article_id", "cluster", "turn", "score")


@R.query("SELECT chunk_id, i::INT AS no, substr(content, (i * 280 + 1)::BIGINT, 320) AS chunk FROM article_chunks, range(0, 1000) r(i) WHERE length(content) > 0 AND i <= greatest(ceil((length(content) - 40) / 280.0) - 1, 0)")
def fixed_window_chunks(spark, d):
    """X2, W10."""
    c = load(spark, d, "article_chunks")
    return c.select("chunk_id", F.posexplode(fx.fixed_windows(F.col("content"), 320, 40)).alias("no", "chunk"))


@R.query()
def chunk_text(spark, d):
    """Paragraphs packed to a size, with the tail of the chunk before."""
    return load(spark, d, "article_chunks").select("chunk_id", F.posexplode(fx.chunk_text(F.col("content"))).alias("no", "chunk"))


@R.query()
def markdown_parse(spark, d):
    """Documents read as Markdown articles."""
    doc = load(spark, d, "documents").select("doc_id", markdown.parse_column(F.col("text"), F.coalesce("title", F.lit("untitled"))).alias("a"))
    return doc.select("doc_id", "a.title", F.posexplode("a.sections").alias("section", "s")).select("doc_id", "title", "section", "s.h2", F.size("s.blocks").alias("n_blocks"))


@R.query("SELECT candidate_id, regexp_replace(trim(url), '[?#].*$', '') AS url FROM zhihu_guide_candidates")
def url_normalize(spark, d):
    """X15."""
    return load(spark, d, "zhihu_guide_candidates").select("candidate_id", fx.url_normalize(F.col("url")).alias("url"))


@R.query("SELECT candidate_id, regexp_replace(url || '?key=' || coalesce(url_hash, 'x') || '&p=1', '([?&](?:key|sig|token)=)[^&#]*', '\\1***', 'gi') AS url FROM zhihu_guide_candidates")
def url_redact(spark, d):
    """S18."""
    c = load(spark, d, "zhihu_guide_candidates")
    return c.select("candidate_id", fx.url_redact(F.concat("url", F.lit("?key="), F.coalesce("url_hash", F.lit("x")), F.lit("&p=1"))).alias("url"))


@R.query("SELECT candidate_id, 'ann-' || substr(sha1(concat_ws('|', url, title)), 1, 16) AS id FROM zhihu_guide_candidates")
def stable_id(spark, d):
    """X13."""
    return load(spark, d, "zhihu_guide_candidates").select("candidate_id", fx.stable_id("ann-", F.col("url"), F.col("title")).alias("id"))


_H = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || concat_ws('|', article_id, chunk_id)))"


@R.query(f"""WITH h AS (SELECT chunk_id, {_H} AS h FROM article_chunks)
  SELECT chunk_id, 'chk_' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4 + 1)::BIGINT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def uuid5_ids(spark, d):
    """X11: name-based ids of chunks."""
    c = load(spark, d, "article_chunks")
    return c.select("chunk_id", F.concat(F.lit("chk_"), fx.uuid5_url("chunk", F.concat_ws("|", "article_id", "chunk_id"))).alias("id"))


@R.query("SELECT article_id, regexp_matches(lower(article_id), '^(demo|test|sample|src)[-_]?[0-9]*') AS demo FROM articles")
def demo_id_flag(spark, d):
    """X11: ids that look like samples."""
    return load(spark, d, "articles").select("article_id", F.lower("article_id").rlike("^(demo|test|sample|src)[-_]?[0-9]*").alias("demo"))


@R.query("""SELECT doc_id, list_transform(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[。！？!?\\n；;]+'), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ' || chr(160) || chr(12288))), lambda x: x <> '')[1:4], lambda x: substr(x, 1, 160)) AS fragments FROM documents""")
def first_fragments(spark, d):
    """X22."""
    return load(spark, d, "documents").select("doc_id", fx.first_fragments(F.col("text")).alias("fragments"))


@R.query("""WITH s AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 220 THEN substr(s, 1, 220) || '...' ELSE s END AS snippet FROM s""")
def snippet(spark, d):
    """X23."""
    return load(spark, d, "documents").select("doc_id", fx.snippet(F.col("text")).alias("snippet"))


@R.query("""SELECT candidate_id, TRY_CAST(nullif(regexp_extract(summary, '([0-9]+)元', 1), '') AS INT) AS price, regexp_extract(title, '^([\\p{Han}]{2})', 1) AS lead, len(regexp_extract_all(summary, '[0-9]+')) AS numbers FROM zhihu_guide_candidates""")
def regex_extract(spark, d):
    """X25, X24."""
    c = load(spark, d, "zhihu_guide_candidates")
    return c.select("candidate_id", F.nullif(F.regexp_extract("summary", "([0-9]+)元", 1), F.lit("")).try_cast("int").alias("price"), F.regexp_extract("title", r"^([\p{IsHan}]{2})", 1).alias("lead"), F.size(F.regexp_extract_all("summary", F.lit("[0-9]+"), F.lit(0))).cast("bigint").alias("numbers")).withColumn("numbers", F.when(F.col("numbers") >= 0, F.col("numbers")))


@R.query("SELECT article_id, CASE WHEN json_valid(tags) AND tags LIKE '[%' THEN list_filter(list_transform(from_json(tags, '[\"VARCHAR\"]'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS tags FROM articles")
def json_array_clean(spark, d):
    """X31, S11."""
    return load(spark, d, "articles").select("article_id", fx.json_array_clean(F.col("tags")).alias("tags"))


@R.query("""SELECT event_id, lng, lat, lng IS NOT NULL AS valid FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN abs(value) > 90 OR (event_id % 5 = 0) THEN NULL ELSE value END AS lng,
    CASE WHEN event_id % 7 = 0 OR abs(value) > 90 OR event_id % 5 = 0 THEN NULL ELSE value END AS lat FROM events)""")
def lnglat_valid(spark, d):
    """Parsed places; out of range, the origin and broken texts are invalid."""
    e = load(spark, d, "events")
    v = F.col("value").cast("string")
    text = F.when(F.col("event_id") % 7 == 0, F.concat(v, F.lit(";"), v)).when(F.col("event_id") % 5 == 0, F.lit("0,0")).otherwise(F.concat(v, F.lit(","), v))
    return e.select("event_id", fx.lng_lat(text).alias("p")).select("event_id", "p.lng", "p.lat", F.col("p").isNotNull().alias("valid"))


@R.query("SELECT candidate_id, CASE WHEN vote_up_count >= 10000 THEN round(round(vote_up_count / 10000.0, 1) * 10000)::BIGINT ELSE vote_up_count END AS votes FROM zhihu_guide_candidates")
def cn_number_parse(spark, d):
    """Counts with units."""
    c = load(spark, d, "zhihu_guide_candidates")
    text = F.when(F.col("vote_up_count") >= 10000, F.concat(F.round(F.col("vote_up_count").cast("decimal(20,4)") / 10000, 1).cast("decimal(12,1)").cast("string"), F.lit("万"))).otherwise(F.col("vote_up_count").cast("string"))
    return c.select("candidate_id", fx.cn_number(text).alias("votes"))


@R.query()
def html_text_clean(spark, d):
    """Page text without markup."""
    return load(spark, d, "documents").select("doc_id", fx.html_text(F.concat(F.lit("<p>&lt;"), F.coalesce("text", F.lit("")), F.lit("</p>"))).alias("text"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@R.query(f"""SELECT candidate_id, CASE WHEN {_HOST} = '' OR url IS NULL THEN NULL WHEN {_HOST} = 'localhost' OR regexp_matches({_HOST}, '^127\\.') THEN 'loopback'
  WHEN regexp_matches({_HOST}, '^(10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)') OR {_HOST} LIKE '%.local' THEN 'private' ELSE 'public' END AS host_kind FROM zhihu_guide_candidates""")
def host_classify(spark, d):
    """S21."""
    return load(spark, d, "zhihu_guide_candidates").select("candidate_id", fx.host_kind(F.col("url")).alias("host_kind"))


@R.query("SELECT chunk_id, replace(replace(content, '预算', '[a]'), '押金', '[b]') AS content FROM article_chunks")
def redact(spark, d):
    """X38."""
    return load(spark, d, "article_chunks").select("chunk_id", fx.redact(F.col("content"), {"预算": "[a]", "押金": "[b]"}).alias("content"))


@R.query("""SELECT candidate_id, CASE WHEN contains(t, 'timeout') OR contains(t, '很慢') THEN 'timeout' WHEN contains(t, '网') OR contains(t, '信号') THEN 'network' ELSE 'other' END AS class FROM (SELECT candidate_id, lower(coalesce(summary, '')) AS t FROM zhihu_guide_candidates)""")
def error_class(spark, d):
    """An ordered keyword classifier."""
    c = load(spark, d, "zhihu_guide_candidates")
    return c.select("candidate_id", fx.by_keywords(F.lower(F.coalesce("summary", F.lit(""))), [("timeout", ["timeout", "很慢"]), ("network", ["网", "信号"])], "other").alias("class"))


@R.query("""WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type FROM events WHERE event_type IN ('view', 'click')), l AS (SELECT user_id, arg_max(event_type, n) AS last_turn FROM x GROUP BY 1)
  SELECT user_id, ((n - 1) // 100)::INT AS part, string_agg(n || '. ' || event_type, chr(10) ORDER BY n) AS transcript, any_value(last_turn) AS last_turn FROM x JOIN l USING (user_id) GROUP BY 1, 2""")
def user_transcript(spark, d):
    """One user's turns, numbered and joined in order, in parts of a hundred, with the user's last turn."""
    e = load(spark, d, "events").where("event_type in ('view', 'click')").select("user_id", "ts", "event_id", "event_type")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_turn"))
    text = merge.joined_lines(e, "user_id", [F.col("ts").asc(), F.col("event_id").asc()], F.format_string("%d. %s", "rank", "event_type"), 100)
    return text.withColumnRenamed("text", "transcript").join(last, "user_id")


@R.query("SELECT candidate_id, CASE WHEN trim(coalesce(author_name, '')) = '' OR regexp_full_match(author_name, '[\\s\\x{3000}]*') THEN '' ELSE 'h_' || substr(sha256(author_name), 1, 6) END AS author, substr(trim(regexp_replace(coalesce(title, ''), '[^a-zA-Z0-9\\p{Han}]+', '_', 'g'), '_'), 1, 24) AS slug FROM zhihu_guide_candidates")
def short_ids(spark, d):
    """X14, X24."""
    return load(spark, d, "zhihu_guide_candidates").select("candidate_id", fx.short_hash(F.col("author_name")).alias("author"), fx.slug(F.col("title")).alias("slug"))


@R.query("""SELECT event_id, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN printf('%.1f-%.1f', least(floor(value / 100 * 10), 9) / 10, least(floor(value / 100 * 10), 9) / 10 + 0.1) ELSE '-' END AS bucket FROM events""")
def confidence_buckets(spark, d):
    """X39, T18."""
    return load(spark, d, "events").select("event_id", fx.confidence_bucket(F.col("value") / 100).alias("bucket"))


QUERIES, SQL = R.queries, R.sql
