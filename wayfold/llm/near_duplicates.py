"""Problem 5: records that share most of their content, found by b-bit MinHash.

Method: b-bit MinHash.  Only the low 8 bits of 152 minima are kept and packed
into 64-bit words; 60 bands of 5 lanes generate candidates; similarity is
estimated by XOR and bit counts, corrected for chance collisions; survivors of
the estimate are checked exactly on their distinct substrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayfold.functions.text import squeeze_out
from wayfold.llm.minwise import MinwiseScheme, candidate_pairs, classes_of, sign, verified_pairs

CHUNK_SCHEME = MinwiseScheme(threshold=0.6, min_chars=40)


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, scheme: MinwiseScheme = CHUNK_SCHEME) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each record, and similar pairs of classes.

    members has (id, cid): records of equal normal text (lower case, no white
    space) share a class; records with null or fewer than ``min_chars``
    characters, or a null id, have none and are left out.  links has (a, b), a < b, for every
    pair of classes whose similarity reaches the threshold.  Repeated rows are
    members of one class; an empty table gives two empty ones; other columns
    are not read.
    """
    text = F.lower(squeeze_out(F.col(f"`{text_col}`")))
    signed = sign(df, id_col, text, scheme, "p5-signed")
    classes = classes_of(signed)
    pairs = candidate_pairs(signed, scheme, "p5-candidates")
    links = verified_pairs(pairs, signed, df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t")), scheme, "p5-links")
    members = signed.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "cid")
    return members, links


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, scheme: MinwiseScheme = CHUNK_SCHEME) -> DataFrame:
    """All pairs of ids (``{id}_a`` < ``{id}_b``), copies expanded, one row per pair."""
    members, links = near_duplicate_classes(df, id_col, text_col, scheme)
    members = members.distinct()
    a, b = members.withColumnsRenamed({"id": "x", "cid": "a"}), members.withColumnsRenamed({"id": "y", "cid": "b"})
    across = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.where("x <> y").union(within).distinct().toDF(f"{id_col}_a", f"{id_col}_b")


def near_duplicate_summary(df: DataFrame, id_col: str, text_col: str, scheme: MinwiseScheme = CHUNK_SCHEME) -> DataFrame:
    """One row per record of a class: id, cid, copies (records of its class) and links (similar classes)."""
    members, links = near_duplicate_classes(df, id_col, text_col, scheme)
    members = members.distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(size, "cid").join(degree, "cid", "left").select(F.col("id").alias(id_col), "cid", "copies", F.coalesce("links", F.lit(0)).alias("links"))
