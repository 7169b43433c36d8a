"""Hierarchy, interval and rule queries; the order tables are read as plan, phase, month, week and day."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayfold.operators import graph as op
from wayfold.plans.registry import Registry
from wayfold.runtime import load

R = Registry()


def edges(spark, d):
    n = load(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.lit("HAS_PHASE").alias("rel"))
    c = load(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("HAS_MONTH").alias("rel"))
    o = load(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("HAS_WEEK").alias("rel"))
    return n.union(c).union(o)


EDGE = """g AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'HAS_PHASE' AS rel FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HAS_MONTH' FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'HAS_WEEK' FROM orders)"""
WALK = EDGE + ", w AS (SELECT src AS root, dst AS id, 1 AS depth FROM g WHERE src LIKE 'r%' OR src LIKE 'n%' UNION ALL SELECT root, dst, depth + 1 FROM w JOIN g ON src = id WHERE depth < 6)"


@R.query(f"""WITH {EDGE}, k AS (SELECT src, dst, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM g JOIN orders ON dst = 'o' || o_orderkey)
  SELECT src, count(*) AS n_children, count(*) FILTER (status = 'done') AS done, string_agg(dst || ':' || status, ',' ORDER BY dst) FILTER (r <= 20) AS children FROM k GROUP BY 1""")
def children_summary(spark, d):
    """S22, F20."""
    nodes = load(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"))
    s = op.children_summary(edges(spark, d), nodes)
    return s.withColumn("children", F.array_join(F.transform("children", lambda x: F.concat(x["dst"], F.lit(":"), x["status"])), ","))


@R.query("SELECT o_custkey AS parent, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1")
def unplanned_children(spark, d):
    """children neither done nor reviewed."""
    return load(spark, d, "orders").where(~F.col("o_orderstatus").isin("F", "P")).groupBy(F.col("o_custkey").alias("parent")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def hierarchy_overview(spark, d):
    """A fixed-depth walk, each level aggregated before it is joined."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    c = load(spark, d, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"))
    n = load(spark, d, "nation").join(c, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("nations"), F.sum("customers").alias("customers"), F.sum("orders").alias("orders"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return load(spark, d, "region").join(n, "r_regionkey", "left").select("r_name", z("nations"), z("customers"), z("orders"))


@R.query(f"WITH RECURSIVE {WALK} SELECT root AS id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM w JOIN orders ON id = 'o' || o_orderkey GROUP BY 1")
def budget_rollup(spark, d):
    """Sums over all paths below a node."""
    v = load(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return op.roll_up(edges(spark, d), v).where(F.substring("id", 1, 1).isin("r", "n")).withColumn("total", F.round("total", 2))


@R.query(f"WITH RECURSIVE {WALK} SELECT root AS id, count(*) AS n FROM w JOIN orders ON id = 'o' || o_orderkey WHERE o_totalprice > 250000 GROUP BY 1")
def constraint_violations(spark, d):
    """Nodes below which a limit is exceeded, with the number of violations."""
    v = load(spark, d, "orders").where("o_totalprice > 250000").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return op.roll_up(edges(spark, d), v).where(F.substring("id", 1, 1).isin("r", "n")).select("id", "n")


@R.query(f"WITH RECURSIVE {WALK} SELECT root, depth, count(DISTINCT id) AS n FROM w WHERE root LIKE 'r%' AND depth <= 2 GROUP BY 1, 2")
def descendant_counts(spark, d):
    """Distinct nodes at each depth below the roots."""
    e = edges(spark, d)
    roots = load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return op.descendants(e, roots, 2).groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT o_custkey AS src, count(*) AS children, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(*) FILTER (o_orderstatus <> 'F') = 0 AS passed FROM orders GROUP BY 1")
def review_gate(spark, d):
    """A layer passes when every child has a passing review; a missing review fails."""
    o = load(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    reviews = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("passed"))
    return op.gate(e, reviews)


_SEASON = "s AS (SELECT * FROM (VALUES (0, 1, 3, 'low'), (1, 3, 8, 'high'), (2, 6, 9, 'mid'), (3, 10, 12, 'low'), (4, 2, 5, 'high')) t(region, lo, hi, risk))"


@R.query(f"WITH {_SEASON} SELECT n_name, risk, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN s ON region = n_regionkey AND month(o_orderdate) BETWEEN lo AND hi GROUP BY 1, 2")
def seasonal_range_join(spark, d):
    """Equal region and a range of months; orders are counted by nation and month before the range join."""
    season = spark.createDataFrame([(0, 1, 3, "low"), (1, 3, 8, "high"), (2, 6, 9, "mid"), (3, 10, 12, "low"), (4, 2, 5, "high")], "region int, lo int, hi int, risk string")
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = load(spark, d, "orders").join(c, "o_custkey").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    j = o.join(load(spark, d, "nation"), "n_nationkey").join(F.broadcast(season), (F.col("region") == F.col("n_regionkey")) & F.col("m").between(F.col("lo"), F.col("hi")))
    return j.groupBy("n_name", "risk").agg(F.sum("n").alias("n"))


@R.query("""WITH p AS (SELECT region, ('1995-01-01'::DATE + (i * 100)::INT) AS lo, ('1995-01-01'::DATE + (i * 100 + 99)::INT) AS hi, i FROM range(0, 3) r(i), (SELECT r_regionkey AS region FROM region))
  SELECT region, i::INT AS phase, count(*) AS days FROM p JOIN (SELECT DISTINCT n_regionkey, o_orderdate::DATE AS day FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) o ON n_regionkey = region AND day BETWEEN lo AND hi GROUP BY 1, 2""")
def interval_join_days(spark, d):
    """Days joined to the interval that holds them."""
    phases = load(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("phase")).withColumn("lo", F.expr("date_add(date '1995-01-01', phase * 100)")).withColumn("hi", F.date_add("lo", 99))
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    days = load(spark, d, "orders").where("o_orderdate >= '1995-01-01' and o_orderdate < '1996-01-01'").join(c, "o_custkey").join(load(spark, d, "nation"), "n_nationkey").select("n_regionkey", F.to_date("o_orderdate").alias("day")).distinct()
    return days.join(phases, "n_regionkey").where("day between lo and hi").groupBy(F.col("n_regionkey").alias("region"), "phase").agg(F.count(F.lit(1)).alias("days"))


@R.query("""WITH x AS (SELECT o_custkey AS trip, o_orderkey AS stop, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
  SELECT trip, stop AS src, lead(stop) OVER w AS dst, lead(day) OVER w <> day AS across FROM x WINDOW w AS (PARTITION BY trip ORDER BY n) QUALIFY dst IS NOT NULL""")
def route_pairs(spark, d):
    """Consecutive stops, also from a day's last to the next day's first."""
    w = Window.partitionBy("trip").orderBy("o_orderdate", "stop")
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("stop"), "o_orderdate")
    return o.select("trip", F.col("stop").alias("src"), F.lead("stop").over(w).alias("dst"), (F.lead(F.to_date("o_orderdate")).over(w) != F.to_date("o_orderdate")).alias("across")).where("dst is not null")


@R.query("""WITH o AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1),
  m AS (SELECT k, 'month' AS unit, row_number() OVER (PARTITION BY k ORDER BY x) AS no, greatest(x::DATE, lo) AS lo, least(last_day(x::DATE), hi) AS hi FROM o, unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)) t(x)),
  w AS (SELECT k, 'week' AS unit, row_number() OVER (PARTITION BY k ORDER BY x) AS no, x::DATE AS lo, least(x::DATE + 6, hi) AS hi FROM o, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY)) t(x))
  SELECT k, unit, no::INT AS no, lo, hi FROM m UNION ALL SELECT k, unit, no::INT, lo, hi FROM w""")
def date_split(spark, d):
    """Ranges cut into clipped months and weeks."""
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return op.date_split(o, "k", "a", "b", "month").withColumn("unit", F.lit("month")).unionByName(op.date_split(o, "k", "a", "b", "week").withColumn("unit", F.lit("week"))).select("k", "unit", "no", "lo", "hi")


@R.query("""WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type IN ('click', 'purchase')), y AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS i FROM x)
  SELECT user_id, min(day) AS lo, max(day) AS hi, count(*) AS n FROM y GROUP BY user_id, i HAVING count(*) >= 3""")
def high_intensity_streaks(spark, d):
    """Runs of at least three consecutive days."""
    return op.islands(load(spark, d, "events").where("event_type in ('click', 'purchase')"), "user_id", F.to_date("ts"), 3)


@R.query("""WITH x AS (SELECT n_nationkey AS k, sum(o_totalprice) AS v, count(DISTINCT o_orderdate::DATE) AS days FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1)
  SELECT k, round(v / sum(v) OVER (), 6) AS share, round(days / (sum(days) OVER ())::DOUBLE, 6) AS day_share, abs(v / sum(v) OVER () - days / (sum(days) OVER ())::DOUBLE) > 0.2 * days / (sum(days) OVER ())::DOUBLE AS deviates FROM x""")
def budget_share_deviation(spark, d):
    """A part's share of the whole against its share of days."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    x = load(spark, d, "orders").join(c, "o_custkey").groupBy("k").agg(F.sum("o_totalprice").alias("v"), F.count_distinct(F.to_date("o_orderdate")).alias("days"))
    t = x.agg(F.sum("v").alias("tv"), F.sum("days").alias("td"))
    s, ds = F.col("v") / F.col("tv"), F.col("days") / F.col("td")
    return x.crossJoin(t).select("k", F.round(s, 6).alias("share"), F.round(ds, 6).alias("day_share"), (F.abs(s - ds) > 0.2 * ds).alias("deviates"))


@R.query("""SELECT doc_id, word, pos FROM (SELECT doc_id, w AS word, instr(text, w) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY instr(text, w), length(w) DESC, w) AS r FROM documents, (VALUES ('湖心岛'), ('湖'), ('天文台'), ('古镇'), ('夜市')) k(w) WHERE contains(text, w)) WHERE r = 1""")
def first_keyword(spark, d):
    """The first keyword of a list in each text, the longest of those at one place."""
    return op.first_keyword(load(spark, d, "documents"), "doc_id", "text", ["湖心岛", "湖", "天文台", "古镇", "夜市"])


@R.query("""WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS n FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7), o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS r FROM orders)
  SELECT o_orderkey, p_partkey FROM o JOIN a ON n = r % 7""")
def modulo_assign(spark, d):
    """Anchors dealt to days in turn."""
    a = load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(7)
    a = a.agg(F.collect_list(F.struct((-F.col("p_retailprice")).alias("x"), "p_partkey")).alias("l")).select(F.posexplode(F.array_sort("l")).alias("n", "x")).select("n", "x.p_partkey")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return load(spark, d, "orders").withColumn("n", F.pmod(r, F.lit(7))).join(F.broadcast(a), "n").select("o_orderkey", "p_partkey")


@R.query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 180 AS lng, l_suppkey % 90 AS lat, lag(l_partkey % 180) OVER w AS plng, lag(l_suppkey % 90) OVER w AS plat FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
  SELECT l_orderkey, count(*) FILTER (2 * 6371 * asin(sqrt(least(1, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2)))) > 5000) AS far_hops FROM x GROUP BY 1""")
def far_hops(spark, d):
    """Consecutive stops farther apart than a limit."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lng, lat = F.col("l_partkey") % 180, F.col("l_suppkey") % 90
    x = load(spark, d, "lineitem").select("l_orderkey", lng.alias("lng"), lat.alias("lat"), F.lag(lng).over(w).alias("plng"), F.lag(lat).over(w).alias("plat"))
    km = op.haversine_km(F.col("plng"), F.col("plat"), F.col("lng"), F.col("lat"))
    return x.groupBy("l_orderkey").agg(F.count(F.when(km > 5000, 1)).alias("far_hops"))


QUERIES, SQL = R.queries, R.sql
