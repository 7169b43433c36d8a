"""Hierarchies and property graphs as node and edge tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from wayfold.runtime import materialize


def children_summary(edges: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(src, n_children, done, children): children over relations HAS_*, the first ``most`` as structs in order of id."""
    kids = edges.where(F.col("rel").startswith("HAS_")).join(nodes.withColumnRenamed("id", "dst"), "dst")
    r = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    kids = kids.withColumn("r", r)
    few = F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("dst", "status"))))
    return kids.groupBy("src").agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("status") == "done", 1)).alias("done"), few.alias("children"))


def roll_up(edges: DataFrame, values: DataFrame, depth: int = 6) -> DataFrame:
    """(id, n, total): the number and the sum of values over all paths of 1 to ``depth`` edges below each node.

    Values move up one level a step and are added before the next, so no path
    is listed; a node reached over two paths counts twice, as paths do.  Edges
    and levels are written, so that a level reads its links and the level
    below once, and the steps end with the first empty level.
    """
    links, levels = materialize(edges.select("src", "dst"), "links"), []
    level = values.select("id", F.lit(1).cast("bigint").alias("n"), F.col("value").alias("total"))
    for _ in range(depth):
        seen = Observation()
        up = links.join(level.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        level = materialize(up.observe(seen, F.count(F.lit(1)).alias("rows")), "level")
        levels.append(level)
        if not seen.get["rows"]:
            break
    return functools.reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def descendants(edges: DataFrame, roots: DataFrame, depth: int = 6) -> DataFrame:
    """(root, id, depth): distinct nodes within ``depth`` edges of the roots, each at its smallest depth."""
    links, level, out = edges.select(F.col("src").alias("id"), "dst"), roots.select(F.col("id").alias("root"), "id"), None
    for k in range(1, depth + 1):
        level = level.join(links, "id").select("root", F.col("dst").alias("id")).distinct()
        step = level.withColumn("depth", F.lit(k))
        out = step if out is None else out.unionByName(step)
    return out.groupBy("root", "id").agg(F.min("depth").alias("depth"))


def gate(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """(src, children, failed, passed): a child without a passing review fails."""
    ok = reviews.groupBy("id").agg(F.max(F.coalesce("passed", F.lit(False))).alias("ok")).withColumnRenamed("id", "dst")
    kids = edges.join(ok, "dst", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return kids.groupBy("src").agg(F.count(F.lit(1)).alias("children"), F.count(F.when(~F.col("ok"), 1)).alias("failed")).withColumn("passed", F.col("failed") == 0)


def date_split(df: DataFrame, key: str, start: str, end: str, unit: str) -> DataFrame:
    """(key, no, lo, hi): months on calendar boundaries clipped to the range, weeks of seven days from its start, or days."""
    lo, hi = F.to_date(start), F.to_date(end)
    if unit == "month":
        first = F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month"))
        parts = F.transform(first, lambda m: F.struct(F.greatest(m, lo).alias("lo"), F.least(F.last_day(m), hi).alias("hi")))
    else:
        step = {"week": 7, "day": 1}[unit]
        days = F.sequence(lo, hi, F.expr(f"interval {step} day"))
        parts = F.transform(days, lambda x: F.struct(x.alias("lo"), F.least(F.date_add(x, step - 1), hi).alias("hi")))
    return df.where(lo <= hi).select(key, F.posexplode(parts).alias("p", "x")).select(key, (F.col("p") + 1).alias("no"), "x.lo", "x.hi")


def islands(df: DataFrame, group: str, day: Column, least: int = 1) -> DataFrame:
    """(group, lo, hi, n): runs of consecutive days (A24); repeated days count once."""
    days = df.select(group, day.alias("day")).distinct()
    r = F.row_number().over(Window.partitionBy(group).orderBy("day"))
    return days.withColumn("island", F.date_sub("day", r)).groupBy(group, "island").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("island")


def first_keyword(df: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """(key, word, pos): of the words contained in the text the one that stands first, of these the longest.

    The words are a given list; the text is scanned for each inside the JVM.
    """
    hits = F.array(*[F.struct(F.instr(F.col(text), w).alias("pos"), F.lit(-len(w)).alias("l"), F.lit(w).alias("word")) for w in words])
    best = F.array_min(F.filter(hits, lambda h: h["pos"] > 0))
    return df.select(key, best.alias("b")).where("b is not null").select(key, "b.word", "b.pos")


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    r = F.radians
    a = F.pow(F.sin(r(lat2 - lat1) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin(r(lng2 - lng1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def subgraph(nodes: DataFrame, branches: dict[str, DataFrame]) -> DataFrame:
    """Nodes (id, ...) with one array for each branch (J14, J15, A20): the distinct rows (as structs, in order) that belong to the node.

    A branch has ``id``, the node, and any other columns.  Each branch is
    gathered by node before it is joined, so branches don't multiply each
    other; a node without rows of a branch has an empty array.
    """
    out = nodes
    for name, b in branches.items():
        item = F.struct(*[F.col(f"`{c}`") for c in b.columns if c != "id"])
        own = b.groupBy("id").agg(F.sort_array(F.collect_set(item)).alias(name))
        out = out.join(own, "id", "left")
    kinds = dict(out.dtypes)
    return out.select(*[F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) if c in branches else F.col(c) for c in out.columns])


def scan(nodes: DataFrame, label: str, **props) -> DataFrame:
    """Nodes (id, label, props map) of a label with the given properties (S19); the filters stand at the scan."""
    hit = F.col("label") == label
    for k, v in props.items():
        hit = hit & (F.col("props")[k] == F.lit(str(v)))
    return nodes.where(hit)


def create(nodes: DataFrame, edges: DataFrame, new: DataFrame, target: str, rel: str, outgoing: bool = True) -> tuple[DataFrame, DataFrame]:
    """The graph with new nodes (columns of nodes, and ``target``), each with an edge to its target, or from it; only where the target exists."""
    known = new.join(nodes.select(F.col("id").alias(target)).distinct(), target, "left_semi")
    ends = (F.col("id"), F.col(target)) if outgoing else (F.col(target), F.col("id"))
    made = known.select(ends[0].alias("src"), ends[1].alias("dst"), F.lit(rel).alias("rel"))
    return nodes.unionByName(known.select(*nodes.columns)), edges.unionByName(made, allowMissingColumns=True)


def merge_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Edges (src, dst, rel, props) after a merge of new ones (K15, K17): one edge for each (src, dst, rel), the properties of the latest by ``order``; new edges without both ends are dropped."""
    ids = nodes.select("id").distinct()
    whole = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    both = edges.withColumn("__o", F.lit(None).cast(new.schema[order].dataType)).unionByName(whole.withColumnRenamed(order, "__o").select("src", "dst", "rel", "props", "__o"))
    return both.groupBy("src", "dst", "rel").agg(F.max_by("props", F.struct(F.col("__o").isNotNull(), "__o")).alias("props"))


def merge_create_only(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows as they are, and of new keys the first row by ``order``."""
    rest = [c for c in old.columns if c not in keys]
    first = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("m"))
    return old.unionByName(first.select(*keys, *[F.col("m")[c].alias(c) for c in rest]))


def soft_delete(nodes: DataFrame, gone: DataFrame, at: str, reason: str) -> DataFrame:
    """Nodes (id, status, props map) of which the gone ones stay, rejected and dimmed."""
    marks = F.create_map(*[F.lit(x) for k, v in (("visibility", "dimmed"), ("deleted_at", at), ("deleted_reason", reason)) for x in (k, v)])
    hit = F.col("__g").isNotNull()
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("visibility", "deleted_at", "deleted_reason"))
    out = nodes.join(gone.select("id", F.lit(1).alias("__g")).distinct(), "id", "left")
    return out.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status"))).withColumn("props", F.when(hit, F.map_concat(kept, marks)).otherwise(F.col("props"))).drop("__g")


def content_edges(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Edges (src, dst, rel, weight) of articles and their chunks (K17): HAS_CHILD, and NEXT from each chunk to the next of its article."""
    child = chunks.select(F.col("article_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS_CHILD").alias("rel"), F.lit(1.0).alias("weight")).distinct()
    w = Window.partitionBy("article_id").orderBy(*order)
    follow = chunks.select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst"), F.lit("NEXT").alias("rel"), F.lit(1.0).alias("weight")).where("dst is not null")
    return child.unionByName(follow)


def macro_route(stops: DataFrame, trip: str, place: str, order: list[str], located, most: int = 12) -> DataFrame:
    """(trip, no, src, dst): the first ``most`` distinct places of each trip in order, of these the located ones, each connected with the next."""
    first = stops.groupBy(trip, place).agg(F.min(F.struct(*order)).alias("at"), F.max(located).alias("located"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy(trip).orderBy("at", place))).where((F.col("r") <= most) & F.col("located"))
    w = Window.partitionBy(trip).orderBy("r")
    return ranked.select(trip, F.row_number().over(w).alias("no"), F.col(place).alias("src"), F.lead(place).over(w).alias("dst")).where("dst is not null")
