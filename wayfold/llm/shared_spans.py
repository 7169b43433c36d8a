"""Problem 10: stretches that stand word for word in more than one record.

The named method (MinHash of paragraphs, join, exact check, components) can't
give the required result: a shared stretch may begin and end anywhere, also
inside paragraphs that are otherwise different, and its ends must be exact.
This operator uses winnowed anchors instead.  In every 100 characters the
40-character substring with the smallest hash is the anchor; equal stretches
have equal anchors, so a stretch can be shared only if its anchor is.  An
occurrence of an anchor stands for all the stretches that it is the anchor of,
and is first compared as a whole, with the characters around it; only where
that differs, its stretches are compared one by one.  No pairs of records are
formed at any step: everything is a count of distinct records per hash, so a
passage that a third of all records repeat costs no more than another.  What
the hashes find is verified on the texts before it is reported.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wayfold.llm.minwise import _M1, _M2, FILTER_BUCKETS, mix64
from wayfold.runtime import materialize

MIN_CHARS, ANCHOR_CHARS = 100, 40
_B = np.uint64(0xD6E8FEB86659FD93)  # odd, hence invertible modulo 2**64
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


#: Code points hashed at a time; the place of an anchor takes the low bits of its sort key.
_BLOCK, _PLACE_BITS = 1 << 16, 32


class Rolling:
    """Hashes of any substring of some texts, laid end to end, by prefix sums modulo 2**64."""

    def __init__(self, texts: list[str]):
        x = mix64(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _M1 + _M2)
        self.n = len(x)
        self.up, down = np.full(self.n + 1, _B, np.uint64), np.full(self.n, _B_INV, np.uint64)
        self.up[0], down[:1] = 1, 1
        np.cumprod(self.up, out=self.up)
        np.cumprod(down, out=down)
        self.sum = np.zeros(self.n + 1, np.uint64)
        np.cumsum(x * down, out=self.sum[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix64((self.sum[start + length] - self.sum[start]) * self.up[start])


def anchors(texts: list[str], span: int, k: int):
    """Anchors of texts laid end to end, each of at least ``span`` characters.

    Returns the text's number, its offset, and of each anchor its hash, the
    hash of all that its stretches cover, and the first and the last start of
    the stretches that it is the anchor of (in the joined texts).
    """
    r = Rolling(texts)
    h = r.of(np.arange(r.n - k + 1), k)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    size, w = 1, span - k + 1
    while size < w:  # the smallest of each window of w, by doubling; of equal hashes the leftmost
        step = min(size, w - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    at = (low & place).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    fits = np.zeros(len(at), bool)
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]), ends):
        fits[lo : hi - span + 1] = True
    first = np.flatnonzero(fits & np.concatenate([[True], (at[1:] != at[:-1]) | ~fits[:-1]]))
    last = np.flatnonzero(fits & np.concatenate([(at[1:] != at[:-1]) | ~fits[1:], [True]]))
    a = h[at[first]]
    c = mix64(r.of(first, last - first + span) + (at[first] - first).astype(np.uint64) * _M1)
    number = np.searchsorted(ends, first, side="right")
    return number, (ends - [len(t) for t in texts])[number], a.view(np.int64), c.view(np.int64), first, last


def _blocks(texts: list[str]):
    """Runs (first, last + 1) of texts of about _BLOCK characters."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= _BLOCK:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def shared_spans(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS, anchor_chars: int = ANCHOR_CHARS) -> DataFrame:
    """(id, span_start, span_chars): the longest unbroken runs of characters shared with another record.

    A character is shared if it lies in a stretch of at least ``min_chars``
    characters that stands verbatim in the text of another id.  span_start
    counts characters from 1.  Null, empty and shorter texts share nothing, nor
    do rows with a null id; a stretch repeated only inside one id doesn't
    count; rows that repeat an id are texts of one record, each with its own
    spans.  An empty table gives an empty one; other columns are not read.
    """
    span, k = min_chars, anchor_chars
    id_type = df.schema[id_col].dataType
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).where(F.col("id").isNotNull() & (F.char_length("t") >= span))
    texts = texts.select("id", F.hash("t").alias("tk"), "t")

    schema = T.StructType([T.StructField("id", id_type), T.StructField("tk", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in "ac"), *(T.StructField(c, T.IntegerType()) for c in ("lo", "n"))])

    def find(batches):
        for b in batches:
            every = b.column("t").to_pylist()
            for lo, hi in _blocks(every):
                part = every[lo:hi]
                number, base, a, c, first, last = anchors(part, span, k)
                own = pa.array(number + lo)
                cols = [pa.array(a), pa.array(c), pa.array((first - base).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("tk").take(own), *cols], schema.names)

    found = materialize(texts.mapInArrow(find, schema), "p10-anchors")
    common = found.groupBy("a").agg(F.min("id").alias("i0"), F.max("id").alias("i1")).where("i0 < i1").select("a")
    near = materialize(found.join(common, "a", "left_semi"), "p10-common")
    at = F.struct("id", "tk", "lo", "n")
    contents = near.groupBy("a", "c").agg(F.min(at).alias("rep"), F.max(at).alias("far"))
    contents = materialize(contents.select("a", "c", (F.col("rep.id") < F.col("far.id")).alias("multi"), "rep", "far"), "p10-contents")
    marked = near.join(contents, ["a", "c"])
    other = lambda x, y: F.when(F.col(f"{x}.id") != F.col("id"), F.col(x)).otherwise(F.col(y)).alias("w")  # a copy in another record
    whole = marked.where("multi").select("id", "tk", "lo", (F.col("lo") + F.col("n") - 1 + span).alias("hi"), other("rep", "far")).select("id", "tk", "lo", "hi", "w.id", F.col("w.tk").alias("wtk"), F.col("w.lo").alias("wlo")).toDF(*_SPAN)

    # where the surroundings differ, stretch by stretch: those of one record only, and two copies of the others with the same anchor
    lone = contents.where("not multi").select("a").distinct()
    probes = marked.where("not multi").select("id", "tk", "lo", "n", F.lit(True).alias("probe"))
    bases = contents.where("multi").join(lone, "a", "left_semi").select(F.explode(F.array("rep", "far")).alias("x")).select("x.*", F.lit(False).alias("probe")).distinct()
    asked = probes.union(bases).groupBy("id", "tk").agg(F.collect_list(F.struct("lo", "n", "probe")).alias("q"))  # bounded by the text's length
    gram_schema = T.StructType([T.StructField("id", id_type), T.StructField("tk", T.IntegerType()), T.StructField("g", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("probe", T.BooleanType())])

    def grams(batches):
        for b in batches:
            for i, (t, q) in enumerate(zip(b.column("t").to_pylist(), b.column("q").to_pylist())):
                r = Rolling([t])
                start = np.concatenate([np.arange(x["lo"], x["lo"] + x["n"]) for x in q])
                probe = np.repeat([x["probe"] for x in q], [x["n"] for x in q])
                own = pa.array(np.full(len(start), i))
                yield pa.RecordBatch.from_arrays([b.column("id").take(own), b.column("tk").take(own), pa.array(r.of(start, span).view(np.int64)), pa.array(start.astype(np.int32)), pa.array(probe)], gram_schema.names)

    every = materialize(_texts_of(texts, asked).mapInArrow(grams, gram_schema), "p10-stretches")
    copy = F.struct("id", "tk", "lo")
    twice = every.groupBy("g").agg(F.min(copy).alias("rep"), F.max(copy).alias("far")).where("rep.id < far.id")
    single = every.where("probe").join(twice, "g").select("id", "tk", "lo", (F.col("lo") + span).alias("hi"), other("rep", "far")).select("id", "tk", "lo", "hi", "w.id", "w.tk", "w.lo").toDF(*_SPAN)

    spans = _verified(_segments(whole.union(single)), texts, id_type)
    # unite what overlaps or touches; a text's intervals are bounded by its length
    runs = _united(spans, ["id", "tk"])
    return runs.select(F.col("id").alias(id_col), (F.col("lo") + 1).cast("bigint").alias("span_start"), (F.col("hi") - F.col("lo")).cast("bigint").alias("span_chars"))


_SPAN = ["id", "tk", "lo", "hi", "wid", "wtk", "wlo"]


def _texts_of(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, tk, t, ...) of the texts (id, tk, t) that ``asked`` names; a broadcast of at most FILTER_BUCKETS hash buckets keeps the others out of the shuffle."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(FILTER_BUCKETS)).cast("int").alias("k")
    few = texts.withColumn("k", bucket).join(F.broadcast(asked.select(bucket).distinct()), "k", "left_semi").drop("k").dropDuplicates(["id", "tk"])
    return few.join(asked, ["id", "tk"]).select("id", "tk", "t", *[c for c in asked.columns if c not in ("id", "tk")])


def _united(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by..., lo, hi): intervals that overlap or touch, united."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    return opened.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def _segments(spans: DataFrame) -> DataFrame:
    """The written (id, tk, wid, wtk, shift, lo, hi): stretches of a text with the other text in which they stand, ``shift`` characters before; spans with the same one are united."""
    shifted = spans.select("id", "tk", "wid", "wtk", (F.col("lo") - F.col("wlo")).alias("shift"), "lo", "hi")
    return materialize(_united(shifted, ["id", "tk", "wid", "wtk", "shift"]), "p10-segments")


def _verified(segments: DataFrame, texts: DataFrame, id_type: T.DataType) -> DataFrame:
    """The (id, tk, lo, hi) of the segments whose characters are those of their other text.

    Both texts are looked at: each asked stretch is digested (128 bits of
    BLAKE2) in the task that holds its text, and only digests are joined, so
    that no text travels to its copies.
    """
    mine = segments.select("id", "tk", "lo", "hi")
    its = segments.select(F.col("wid").alias("id"), F.col("wtk").alias("tk"), (F.col("lo") - F.col("shift")).alias("lo"), (F.col("hi") - F.col("shift")).alias("hi"))
    asked = mine.union(its).distinct().groupBy("id", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("q"))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("tk", T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in ("lo", "hi")), *(T.StructField(c, T.LongType()) for c in ("d1", "d2"))])

    def digests(batches):
        for b in batches:
            own, rows = [], []
            for i, (t, q) in enumerate(zip(b.column("t").to_pylist(), b.column("q").to_pylist())):
                for x in q:
                    d = hashlib.blake2b(t[x["lo"] : x["hi"]].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    own.append(i)
                    rows.append((x["lo"], x["hi"], int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
            if rows:
                at = pa.array(own)
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("tk").take(at), *cols], schema.names)

    read = materialize(_texts_of(texts, asked).mapInArrow(digests, schema), "p10-digests")
    there = read.toDF("wid", "wtk", "wlo", "whi", "e1", "e2")
    both = segments.withColumns({"wlo": F.col("lo") - F.col("shift"), "whi": F.col("hi") - F.col("shift")}).join(there, ["wid", "wtk", "wlo", "whi"]).join(read, ["id", "tk", "lo", "hi"])
    return both.where("d1 = e1 and d2 = e2").select("id", "tk", "lo", "hi")


def shared_coverage(df: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, n_chars, n_spans, shared_chars, shared_ratio) of every id; its longest text counts if it has several."""
    spans = shared_spans(df, id_col, text_col, min_chars).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_spans"), F.sum("span_chars").alias("shared_chars"))
    size = df.groupBy(F.col(f"`{id_col}`").alias(id_col)).agg(F.max(F.coalesce(F.char_length(F.col(f"`{text_col}`")), F.lit(0))).cast("bigint").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = size.join(spans, id_col, "left").select(id_col, "n_chars", zero("n_spans"), zero("shared_chars"))
    return joined.withColumn("shared_ratio", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
