"""Problem 10 by paragraphs: near-equal paragraphs clustered, all but one of a cluster marked for removal.

Method: paragraph MinHash banding.  Bands are tuned for high recall, colliding
paragraphs are joined, their exact Jaccard similarity is verified, and the
verified pairs are clustered by components.  It can't give the exact stretches
of ``p10_found``, which begin and end anywhere; README has its recall of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from wayfold.llm.minwise import MinwiseScheme
from wayfold.llm.near_duplicates import near_duplicate_classes
from wayfold.functions.text import strip
from wayfold.runtime import materialize

#: At a similarity of 0.8 two paragraphs meet in some of the 24 bands with a chance of 0.9999.
PARAGRAPH_SCHEME = MinwiseScheme(threshold=0.8, min_chars=80, lanes=120, bits=8, bands=24, rows=5)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b): the smallest node that can be reached.

    Every round takes the smallest label of a node and its neighbours, then
    the label of that label, so paths halve; a round is a few aggregations
    combined before the shuffle, and the rounds end when no label changes.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        moved = low.join(jump, "low", "left").select("node", F.least("low", "next").alias("component"), (F.least("low", "next") < F.col("old")).alias("moved"))
        seen = Observation()
        labels = materialize(moved.observe(seen, F.count(F.when(F.col("moved"), 1)).alias("n")), "labels").select("node", "component")
        if not seen.get["n"]:
            return labels


def paragraphs_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pid, t): the nonblank paragraphs of each text, between line feeds; pid is (id, no)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("no", "t")).where("id is not null")
    return rows.select(F.struct("id", "no").alias("pid"), strip(F.col("t")).alias("t")).where("t <> ''")


def clustered_paragraphs(df: DataFrame, id_col: str, text_col: str, scheme: MinwiseScheme = PARAGRAPH_SCHEME) -> DataFrame:
    """(id, no, cluster, copies, removed): paragraphs near-equal to others, by cluster.

    Paragraphs of at least ``min_chars`` characters (without white space) count;
    equal ones are one class before anything is compared.  In a cluster the
    first paragraph by (id, no) stays and the others are removed.  Null and
    empty texts have no paragraph; rows with a null id are left out; rows that
    repeat an id are one record; an empty table gives an empty one; other
    columns are not read.
    """
    members, links = near_duplicate_classes(paragraphs_of(df, id_col, text_col).distinct(), "pid", "t", scheme)
    members = materialize(members.distinct(), "p10-paragraphs")
    joined = members.join(components(links).withColumnRenamed("node", "cid"), "cid", "left").select("id", F.coalesce("component", "cid").alias("cluster"))
    size = joined.groupBy("cluster").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")).where("copies > 1")
    return joined.join(size, "cluster").select(F.col("id.id").alias(id_col), F.col("id.no").alias("no"), "cluster", "copies", (F.col("id") != F.col("first")).alias("removed"))


def paragraph_coverage(df: DataFrame, id_col: str, text_col: str, scheme: MinwiseScheme = PARAGRAPH_SCHEME) -> DataFrame:
    """(id, n_paragraphs, clustered, removed) of every record with a nonblank paragraph: how many it has, how many are near-equal to others, and how many of these are to go."""
    found = clustered_paragraphs(df, id_col, text_col, scheme)
    every = paragraphs_of(df, id_col, text_col).distinct().groupBy(F.col("pid.id").alias(id_col)).agg(F.count(F.lit(1)).alias("n_paragraphs"))
    mine = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("clustered"), F.count(F.when(F.col("removed"), 1)).alias("removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return every.join(mine, id_col, "left").select(id_col, "n_paragraphs", zero("clustered"), zero("removed"))
