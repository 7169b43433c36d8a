"""Term search: BM25 over character bigrams, which need no word list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wayfold.runtime import materialize

#: What terms are made of, as first and last code points: digits, Latin letters, kana, Han signs.
SIGNS = [(0x30, 0x39), (0x61, 0x7A), (0x3040, 0x30FF), (0x4E00, 0x9FFF)]
#: So many distinct query terms are sent to the tasks, which then give out their counts only; more are joined.
MOST_TERMS = 1 << 18
#: Code points worked on at a time.
_BLOCK = 1 << 20


def _counted(texts: list[str], keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, count) of the terms of some texts, of those in ``keep`` if given, and the number of terms of each text.

    A term is the pair of neighbouring signs of a run, as one number, or the
    sign of a run of one.
    """
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sign = np.zeros(len(cp) + 2, bool)
    for lo, hi in SIGNS:
        sign[1:-1] |= (cp >= lo) & (cp <= hi)
    own = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(cp)]
    pair = np.flatnonzero(sign[1:-1] & sign[2:])
    lone = np.flatnonzero(sign[1:-1] & ~sign[:-2] & ~sign[2:])
    term = np.concatenate([(cp[pair] << 16) | cp[np.minimum(pair + 1, max(0, len(cp) - 1))], cp[lone]])
    doc = np.concatenate([own[pair], own[lone]])
    length = np.bincount(doc, minlength=len(texts))
    if keep is not None:
        hit = np.isin(term, keep)
        term, doc = term[hit], doc[hit]
    both, count = np.unique((doc << 32) | term, return_counts=True)
    return both >> 32, both & 0xFFFFFFFF, count, length


def term_counts(df: DataFrame, keep=None) -> DataFrame:
    """(id, term, n) of a table (id, text): how often each term stands in a text, and a row of term -1 with the number of all its terms, if it has any.

    ``keep`` is a broadcast array of the terms to give out.  Null texts have
    no term; letters count in lower case.
    """
    schema = T.StructType([df.schema["id"], T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        for b in batches:
            texts, lo = b.column("text").to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < _BLOCK):
                    size, hi = size + len(texts[hi]), hi + 1
                doc, term, n, length = _counted(texts[lo:hi], None if keep is None else keep.value)
                has = np.flatnonzero(length)
                at = pa.array(lo + np.concatenate([doc, has]))
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(np.concatenate([term, np.full(len(has), -1)])), pa.array(np.concatenate([n, length[has]]))], schema.names)
                lo = hi

    return df.where("text is not null").select("id", F.lower("text").alias("text")).mapInArrow(run, schema)


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank): the k documents (id, text) of highest BM25 score for each query (query_id, text), its own id left out, ties by id.

    Texts without a term count neither as documents nor as queries; repeated
    terms of a query count once; an empty table gives no hits.  While the
    queries have at most MOST_TERMS terms, the corpus is read once and only
    counts of their terms leave that pass; with more, all counts leave it and
    are joined.  Statistics cover all documents.
    """
    asked = materialize(term_counts(queries.select(F.col("query_id").alias("id"), "text")).where("term >= 0").select(F.col("id").alias("query_id"), "term"), "asked")
    terms = asked.select("term").distinct()
    few = terms.limit(MOST_TERMS + 1).toArrow().column("term").to_numpy()
    if len(few) <= MOST_TERMS:
        counts = term_counts(docs.select("id", "text"), docs.sparkSession.sparkContext.broadcast(few))
    else:
        counts = term_counts(docs.select("id", "text"))
        counts = counts.join(terms, "term", "left_semi").unionByName(counts.where("term = -1"))
    counts = materialize(counts, "counts")
    length = counts.where("term = -1").select("id", F.col("n").alias("length"))
    stats = length.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"))
    found = counts.where("term >= 0").select("id", "term", F.col("n").alias("tf"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = found.join(df, "term").join(length, "id").crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = weighted.select("id", "term", part.alias("s")).join(asked, "term").where("id <> query_id").groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
