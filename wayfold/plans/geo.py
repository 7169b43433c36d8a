"""Scope, anchor and place queries; the rules and anchors are named by words of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import geo as op
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
REGIONS = (op.Region("湖区", ("湖区", "水乡"), ("湖区", "湖心岛", "渡口", "湖", "盐场")), op.Region("山区", ("山区",), ("山区", "天文台", "古镇", "花海")))
PROVINCES = (op.Region("城里", ("城里", "市里"), ("城里", "夜市", "小火车站", "湖心岛夜市")), op.Region("岛上", ("岛上",), ("岛上", "渡口", "湖心岛")))
#: Scope and start city by the candidate's number.
_SCOPE = "CASE candidate_id % 4 WHEN 0 THEN '湖区三日' WHEN 1 THEN '山区自驾，花海' WHEN 2 THEN '城里和水乡' ELSE '全国' END"
_START = "CASE candidate_id % 5 WHEN 0 THEN '渡口' WHEN 1 THEN '天文台' WHEN 2 THEN '夜市' WHEN 3 THEN '古镇' ELSE '' END"


def _scoped(spark, d):
    c = load(spark, d, "zhihu_guide_candidates").select("candidate_id", "run_id", "title", F.expr(_SCOPE).alias("scope"), F.expr(_START).alias("start"))
    return c, op.Scope(F.col("scope"), F.col("scope"), F.col("start"), regions=REGIONS, provinces=PROVINCES)


def _has(text, words):
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _forms(patterns):
    return "(" + " OR ".join("contains(t, " + " || ".join(x for x in (f"'{p.split('{}')[0]}'", "s", f"'{p.split('{}')[1]}'") if x != "''") + ")" for p in patterns) + ")"


_RULES = [*REGIONS, *PROVINCES]
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_NAMED = "list_distinct(list_concat(" + ", ".join(f"CASE WHEN {_has('sc', r.names)} THEN {_LIST(r.allows)} ELSE [] END" for r in _RULES) + "))"
_MEANT = "(contains(sc, s) OR " + " OR ".join(f"({_has('sc', r.names)} AND len(list_filter({_LIST(r.allows)}, lambda a: contains(a, s) OR contains(s, a))) > 0)" for r in _RULES) + ")"
_KNOWN = sorted(dict.fromkeys(w for r in _RULES for w in (*r.names, *r.allows)), key=len, reverse=True)
_FAMILY = "(" + " OR ".join(f"(list_contains({_LIST([*r.names, *r.allows])}, s) AND (list_contains({_LIST(r.names)}, k) OR k = s))" for r in PROVINCES) + ")"


def _checked(allow_start):
    leave = f"(s <> '' AND contains(t, s) AND {_forms(op.TRANSFER)} AND CASE WHEN k = s THEN NOT (({_has('t', op.SIGHTS)} AND NOT {_has('t', op.MOVES)}) OR {_forms(op.VISIT)}) ELSE {_FAMILY} AND {_has('t', op.LOGISTICS)} AND NOT {_has('t', op.TOURISM)} END)" if allow_start else "FALSE"
    return f"""x AS (SELECT candidate_id, run_id, trim(coalesce(title, '')) AS t, {_SCOPE} AS sc, {_START} AS s FROM zhihu_guide_candidates),
  y AS (SELECT *, CASE WHEN {_has('sc', op.ANYWHERE)} THEN [] WHEN s <> '' AND NOT {_MEANT} THEN list_filter({_NAMED}, lambda v: NOT (contains(v, s) OR contains(s, v))) ELSE {_NAMED} END AS al FROM x),
  k AS (SELECT unnest({_LIST(_KNOWN)}) AS k, unnest(range(1, {len(_KNOWN) + 1})) AS no),
  z AS (SELECT candidate_id, arg_min(k, no) AS keyword FROM y, k WHERE len(al) > 0 AND contains(t, k) AND NOT {leave} AND len(list_filter(al, lambda a: contains(a, k) OR contains(k, a))) = 0 GROUP BY 1)"""


@R.query(f"WITH {_checked(True)} SELECT candidate_id, keyword FROM z")
def geo_scope_violation(spark, d):
    """The keyword by which a title leaves its trip's scope, the longest first; the start city is exempt where one leaves or passes it."""
    c, scope = _scoped(spark, d)
    return c.select("candidate_id", scope.violation(F.col("title"), True).alias("keyword")).where("keyword is not null")


@R.query(f"WITH {_checked(False)} SELECT x.candidate_id FROM x LEFT JOIN z USING (candidate_id) WHERE keyword IS NULL")
def geo_scope_kept(spark, d):
    """places inside their trip's scope, the start city not exempt."""
    c, scope = _scoped(spark, d)
    return c.where(scope.violation(F.col("title"), False).isNull()).select("candidate_id")


@R.query(f"""WITH {_checked(True)} SELECT run_id, count(keyword) AS n_violations, CASE WHEN count(keyword) = 0 THEN 95 ELSE 30 END AS score, count(keyword) = 0 AS passed, list_sort(coalesce(list(DISTINCT keyword) FILTER (keyword IS NOT NULL), [])) AS keywords
  FROM x LEFT JOIN z USING (candidate_id) GROUP BY 1""")
def geo_scope_review(spark, d):
    """A run's review: 95 and passed without a violation, else 30, with the keywords that leave the scope."""
    c, scope = _scoped(spark, d)
    n = F.count("keyword")
    score, passed = op.scope_review(n)
    return c.select("run_id", scope.violation(F.col("title"), True).alias("keyword")).groupBy("run_id").agg(n.alias("n_violations"), score.alias("score"), passed.alias("passed"), F.sort_array(F.collect_set("keyword")).alias("keywords"))


@R.query(f"SELECT candidate_id, {_has('t', op.LOGISTICS_KINDS)} AS logistics, {_has('t', op.ADMINISTRATIVE)} AND NOT {_has('t', op.NATURAL)} AS administrative FROM (SELECT candidate_id, coalesce(title, '') || ' ' || coalesce(summary, '') AS t FROM zhihu_guide_candidates)")
def place_kinds(spark, d):
    """texts that tell logistics or an office rather than a sight."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    return load(spark, d, "zhihu_guide_candidates").select("candidate_id", op.is_logistics_kind(text).alias("logistics"), op.is_administrative(text).alias("administrative"))


ANCHORS = [op.Anchor("湖心岛国家公园", "湖区", ("水乡", "渡口"), priority=90), op.Anchor("天文台", "山区", ("花海",), priority=95), op.Anchor("古镇", "山区", priority=80), op.Anchor("夜市", "城里", ("小火车站",), priority=90), op.Anchor("云峰", "云上", priority=10), op.Anchor("山区", "山区", kind="destination")]
_OWN = sorted((a for a in ANCHORS if a.kind != "destination"), key=lambda a: -a.priority)


@R.query("WITH p AS (SELECT article_id, coalesce(title, '') || ' ' || coalesce(type_tags, '') AS t FROM articles), q AS (SELECT article_id, list_filter([" + ", ".join(f"CASE WHEN {_has('t', [a.destination, *a.aliases, a.name])} THEN '{a.name}' END" for a in _OWN) + f"], lambda x: x IS NOT NULL) AS f FROM p) SELECT article_id, CASE WHEN len(f) = 0 THEN {_LIST([a.name for a in _OWN])} ELSE f END AS anchors FROM q")
def phase_anchors(spark, d):
    """The anchors of each phase by destination, alias or name, all of them where none fits."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("type_tags", F.lit("")))
    return load(spark, d, "articles").select("article_id", op.phase_anchors(text, ANCHORS).alias("anchors"))


@R.query("WITH k AS (SELECT * FROM (VALUES " + ", ".join(f"('{a.name}', {_LIST([*a.spellings, *([a.destination] if a.kind == 'destination' else [])])})" for a in ANCHORS) + ") k(anchor, w)) SELECT anchor, EXISTS (SELECT 1 FROM article_chunks, (SELECT unnest(w) AS v) WHERE contains(content, v)) AS covered FROM k")
def anchor_coverage(spark, d):
    """Whether any text reaches an anchor by its name, the name without its ending, or its destination; one pass with one flag for each anchor."""
    c = load(spark, d, "article_chunks")
    flags = c.agg(*[F.coalesce(F.max(a.covered(F.col("content"))), F.lit(False)).alias(f"c{i}") for i, a in enumerate(ANCHORS)])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(a.name).alias("anchor"), F.col(f"c{i}").alias("covered")) for i, a in enumerate(ANCHORS)])).alias("r")).select("r.*")


QUERIES, SQL = R.queries, R.sql
