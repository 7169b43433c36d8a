"""Subgraphs and graph writes; orders are read as days, line items as stops, customers as weeks, nations as months."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import graph as op, merge
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()
_STOPS = "s AS (SELECT l_orderkey AS id, l_linenumber AS no, l_partkey AS poi, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt, l_shipdate, l_quantity, l_suppkey FROM lineitem)"


def _joined(column: str, *fields: str):
    """An array of structs as text, for comparison."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",").alias(column)


@R.query(f"""WITH {_STOPS}, p AS (SELECT id, string_agg(x, ',' ORDER BY poi) AS pois FROM (SELECT DISTINCT id, poi, poi::VARCHAR AS x FROM s) GROUP BY 1),
  r AS (SELECT id, string_agg(x, ',' ORDER BY poi, nxt) AS routes FROM (SELECT DISTINCT id, poi, nxt, poi || ':' || nxt AS x FROM s WHERE nxt IS NOT NULL) GROUP BY 1),
  i AS (SELECT id, string_agg(x, ',' ORDER BY p_brand) AS insights FROM (SELECT DISTINCT id, p_brand, p_brand AS x FROM s JOIN part ON p_partkey = poi) GROUP BY 1),
  v AS (SELECT id, string_agg(x, ',' ORDER BY k) AS reviews FROM (SELECT DISTINCT id, l_suppkey AS k, l_suppkey::VARCHAR AS x FROM s WHERE l_quantity > 45) GROUP BY 1),
  c AS (SELECT id, string_agg(x, ',' ORDER BY m) AS climate FROM (SELECT DISTINCT id, month(l_shipdate) AS m, month(l_shipdate)::VARCHAR AS x FROM s) GROUP BY 1)
  SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(pois, '') AS pois, coalesce(routes, '') AS routes, coalesce(insights, '') AS insights, coalesce(reviews, '') AS reviews, coalesce(climate, '') AS climate
  FROM orders LEFT JOIN p ON p.id = o_orderkey LEFT JOIN r ON r.id = o_orderkey LEFT JOIN i ON i.id = o_orderkey LEFT JOIN v ON v.id = o_orderkey LEFT JOIN c ON c.id = o_orderkey""")
def day_subgraph(spark, d):
    """A day with its distinct stops, routes, insights, reviews and climate."""
    l = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "id")  # noqa: E741
    routes = op.Window.partitionBy("id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    branches = {
        "pois": l.select("id", F.col("l_partkey").alias("poi")),
        "routes": l.select("id", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(routes).alias("dst")).where("dst is not null"),
        "insights": l.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("id", "p_brand"),
        "reviews": l.where("l_quantity > 45").select("id", "l_suppkey"),
        "climate": l.select("id", F.month("l_shipdate").alias("month")),
    }
    days = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return op.subgraph(days, branches).select("id", "status", _joined("pois", "poi"), _joined("routes", "src", "dst"), _joined("insights", "p_brand"), _joined("reviews", "l_suppkey"), _joined("climate", "month"))


@R.query("""WITH x AS (SELECT o_custkey AS id, string_agg(strftime(o_orderdate, '%Y-%m-%d') || ':' || o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderdate::DATE, o_orderkey) AS days FROM orders GROUP BY 1),
  v AS (SELECT id, string_agg(p, ',' ORDER BY p) AS reviews FROM (SELECT DISTINCT o_custkey AS id, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)
  SELECT c_custkey AS id, coalesce(days, '') AS days, coalesce(reviews, '') AS reviews FROM customer LEFT JOIN x ON x.id = c_custkey LEFT JOIN v ON v.id = c_custkey""")
def week_subgraph(spark, d):
    """A week with its days and reviews."""
    o = load(spark, d, "orders").withColumnRenamed("o_custkey", "id")
    branches = {"days": o.select("id", F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus"), "reviews": o.where("o_orderstatus = 'F'").select("id", "o_orderpriority")}
    weeks = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return op.subgraph(weeks, branches).select("id", _joined("days", "day", "o_orderkey", "o_orderstatus"), _joined("reviews", "o_orderpriority"))


@R.query("""WITH m AS (SELECT n_regionkey AS id, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS months FROM nation GROUP BY 1),
  e AS (SELECT id, string_agg(s, ',' ORDER BY s) AS events FROM (SELECT DISTINCT n_regionkey AS id, c_mktsegment AS s FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000) GROUP BY 1)
  SELECT r_regionkey AS id, coalesce(months, '') AS months, coalesce(events, '') AS events FROM region LEFT JOIN m ON m.id = r_regionkey LEFT JOIN e ON e.id = r_regionkey""")
def phase_subgraph(spark, d):
    """A phase with its months and seasonal events."""
    n = load(spark, d, "nation")
    c = load(spark, d, "customer").where("c_acctbal > 9000").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    branches = {"months": n.select(F.col("n_regionkey").alias("id"), "n_nationkey", "n_name"), "events": c.select(F.col("n_regionkey").alias("id"), "c_mktsegment")}
    return op.subgraph(load(spark, d, "region").select(F.col("r_regionkey").alias("id")), branches).select("id", _joined("months", "n_nationkey", "n_name"), _joined("events", "c_mktsegment"))


def _nodes(spark, d):
    o = load(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"), F.create_map(F.lit("status"), "o_orderstatus", F.lit("year"), F.year("o_orderdate").cast("string")).alias("props"))


@R.query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND year(o_orderdate) = 1995")
def graph_scan(spark, d):
    """Nodes by label and properties."""
    return op.scan(_nodes(spark, d), "1-URGENT", status="F", year=1995).select("id")


@R.query("""SELECT 'c' || candidate_id AS src, trim(substr(run_id, 17)) AS dst, 'INSIGHT_BELONGS_TO' AS rel FROM zhihu_guide_candidates WHERE status = 'accepted' AND trim(substr(run_id, 17)) IN (SELECT trim(substr(run_id, 17)) FROM zhihu_guide_candidates WHERE batch_no <= 1)
  UNION ALL SELECT trim(substr(run_id, 17)), 'r' || candidate_id, 'REVIEWED_BY' FROM zhihu_guide_candidates WHERE status = 'review' AND trim(substr(run_id, 17)) IN (SELECT trim(substr(run_id, 17)) FROM zhihu_guide_candidates WHERE batch_no <= 1)""")
def graph_create(spark, d):
    """Insights and reviews created with their edges, where the trip exists; the trips are those of the first batch."""
    c = load(spark, d, "zhihu_guide_candidates").withColumn("trip", F.trim(F.expr("substring(run_id, 17)")))
    nodes = c.where("batch_no <= 1").select(F.col("trip").alias("id"), F.lit("trip").alias("label")).distinct()
    edges = spark.createDataFrame([], "src string, dst string, rel string")
    new = lambda p, s, label: c.where(F.col("status") == s).select(F.concat(F.lit(p), F.col("candidate_id")).alias("id"), F.lit(label).alias("label"), "trip")
    nodes2, edges = op.create(nodes, edges, new("c", "accepted", "insight"), "trip", "INSIGHT_BELONGS_TO")
    return op.create(nodes, edges, new("r", "review", "review"), "trip", "REVIEWED_BY", outgoing=False)[1]


@R.query("""WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, l_quantity AS q, l_orderkey AS o, l_linenumber AS n, l_shipdate AS t FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))
  SELECT 'p' || src AS src, 's' || dst AS dst, 'ROUTES_TO' AS rel, arg_max(q, (t, o, n)) AS distance FROM e GROUP BY 1, 2""")
def graph_merge_routes(spark, d):
    """Routes merged by their ends, the latest properties kept; routes of unknown stops are dropped."""
    l = load(spark, d, "lineitem")  # noqa: E741
    new = l.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("ROUTES_TO").alias("rel"), F.struct(F.col("l_quantity").alias("q")).alias("props"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    nodes = load(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("id")).union(load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey")))
    return op.merge_edges(new.drop("at").limit(0), new, nodes, "at").select("src", "dst", "rel", F.col("props.q").alias("distance"))


@R.query("""WITH n AS (SELECT * FROM orders WHERE o_orderstatus <> 'O') SELECT o_custkey AS k, o_orderkey AS id, TRUE AS old FROM orders WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
  UNION ALL SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)), FALSE FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""")
def merge_create_only(spark, d):
    """Known keys stay as they are, of new keys the first row is created."""
    o = load(spark, d, "orders")
    old = o.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("id")).withColumn("old", F.lit(True))
    new = o.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.lit(False).alias("old"), F.struct("o_orderdate", "o_orderkey").alias("at"))
    return op.merge_create_only(old, new, ["k"], "at")


@R.query("""SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'dimmed' END AS visibility, CASE WHEN o_orderstatus = 'P' THEN 'withdrawn' END AS reason, year(o_orderdate)::VARCHAR AS year FROM orders""")
def soft_delete(spark, d):
    """Nodes marked as rejected and dimmed, their other properties kept."""
    n = _nodes(spark, d)
    out = op.soft_delete(n, n.where("status = 'P'").select("id"), "2025-06-01T00:00:00Z", "withdrawn")
    return out.select("id", "status", F.col("props")["visibility"].alias("visibility"), F.col("props")["deleted_reason"].alias("reason"), F.col("props")["year"].alias("year"))


@R.query("SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, year(o_orderdate)::VARCHAR AS year, CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR END AS checked FROM orders")
def graph_patch(spark, d):
    """Properties overwritten key by key."""
    n = _nodes(spark, d)
    patches = n.where("status = 'F'").select("id", F.create_map(F.lit("status"), F.lit("done"), F.lit("checked"), "id").alias("props"))
    out = merge.patch(n, patches, "id")
    return out.select("id", F.col("props")["status"].alias("status"), F.col("props")["year"].alias("year"), F.col("props")["checked"].alias("checked"))


@R.query("""SELECT DISTINCT article_id AS src, chunk_id AS dst, 'HAS_CHILD' AS rel FROM article_chunks UNION ALL
  SELECT chunk_id, lead(chunk_id) OVER (PARTITION BY article_id ORDER BY created_at, chunk_id) AS dst, 'NEXT' FROM article_chunks QUALIFY dst IS NOT NULL""")
def content_graph(spark, d):
    """HAS_CHILD and NEXT edges of articles and chunks."""
    return op.content_edges(load(spark, d, "article_chunks"), ["created_at", "chunk_id"]).drop("weight")


@R.query("""WITH f AS (SELECT o_custkey AS trip, o_orderpriority AS place, min((o_orderdate, o_orderkey)) AS seen, bool_or(o_totalprice > 50000) AS located FROM orders GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY seen, place) AS r FROM f), k AS (SELECT * FROM r WHERE r <= 4 AND located)
  SELECT trip, row_number() OVER w AS no, place AS src, lead(place) OVER w AS dst FROM k WINDOW w AS (PARTITION BY trip ORDER BY r) QUALIFY dst IS NOT NULL""")
def macro_route(spark, d):
    """A trip's first distinct places, of these the located ones, connected in order."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("trip"), F.col("o_orderpriority").alias("place"), "o_orderdate", "o_orderkey", "o_totalprice")
    return op.macro_route(o, "trip", "place", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 50000, 4)


@R.query("""WITH s AS (SELECT l_orderkey AS run, (l_linenumber, l_partkey, l_suppkey) AS seq, l_returnflag AS status FROM lineitem)
  SELECT o_orderkey AS run, coalesce(arg_max(status, seq), o_orderstatus) AS status, count(seq) AS n_steps FROM orders LEFT JOIN s ON run = o_orderkey GROUP BY o_orderkey, o_orderstatus""")
def append_steps(spark, d):
    """Runs with the status of their last step and the number of steps."""
    runs = load(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    steps = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.col("l_returnflag").alias("status"))
    return merge.append_steps(runs, steps, "run", "seq", "status").select("run", "status", "n_steps")


@R.query("""WITH i AS (SELECT DISTINCT l_orderkey AS day, l_partkey AS poi, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey) % 3 AS o FROM lineitem), a AS (SELECT p_partkey AS poi, arg_min(s, pos) AS spot FROM
    (SELECT p_partkey, r.pos, p_size * r.pos AS s FROM part, (VALUES (1), (2), (3)) r(pos) WHERE p_size * r.pos % 4 <> 0) GROUP BY 1)
  SELECT day, poi, spot, row_number() OVER (PARTITION BY day ORDER BY CASE WHEN o <= 0 THEN 1 ELSE 0 END, o, poi)::INT AS visit_order FROM i JOIN a USING (poi)""")
def first_valid_lookup(spark, d):
    """Places with their first valid answer, in order of visit, a place without an order last, ties by name."""
    items = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("day"), F.col("l_partkey").alias("poi")).agg((F.min("l_linenumber") % 3).alias("o"))
    answers = load(spark, d, "part").select(F.col("p_partkey").alias("poi"), "p_size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pos")).select("poi", "pos", (F.col("p_size") * F.col("pos")).alias("spot"))
    return merge.first_valid_lookup(items, answers, "day", "poi", "o", F.col("spot") % 4 != 0)


@R.query()
def greedy_choice(spark, d):
    """For each spec of a group the best offer whose item isn't chosen yet; compared with brute force in the tests."""
    l = load(spark, d, "lineitem")  # noqa: E741
    offers = l.select(F.col("l_orderkey").alias("day"), F.col("l_linenumber").alias("spec"), F.col("l_suppkey").alias("item"), F.col("l_quantity").alias("score"))
    return merge.greedy_choice(offers.select("day", "spec").distinct(), offers, "day", "spec", "item", "score")


QUERIES, SQL = R.queries, R.sql
