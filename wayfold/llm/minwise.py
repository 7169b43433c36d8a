"""Packed min-wise signatures, band candidates, bit-count estimates and exact checks.

Shared by the near-duplicate operators.  A text's signature holds, for each of
``lanes`` hash functions, only the lowest ``bits`` bits of the minimum over its
character shingles.  Bands are groups of lanes; two texts become candidates if
all lanes of a band are equal.  A candidate's similarity is then estimated by
counting equal lanes with XOR and ``bit_count`` and correcting for lanes that
are equal by chance, and what the estimate can't rule out is checked on the
texts themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wayfold.runtime import materialize

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class MinwiseScheme:
    """Parameters of the signatures.

    ``lanes`` minima of ``bits`` (8 or 16) low bits each; ``bands`` bands of
    ``rows`` lanes.  When ``bands * rows`` exceeds ``lanes`` the further bands
    regroup the lanes by another permutation.  Two texts of similarity s meet
    in some band with a chance of about ``1 - (1 - s**rows)**bands``.
    """

    threshold: float
    min_chars: int
    shingle: int = 5
    lanes: int = 152
    bits: int = 8
    bands: int = 60
    rows: int = 5
    seed: int = 20240229

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(self.seed).integers(0, 2**32, self.lanes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def layout(self) -> np.ndarray:
        """bands x rows lane numbers."""
        rng, picks, per = np.random.default_rng(self.seed + 1), [], self.lanes // self.rows
        while sum(len(p) for p in picks) < self.bands:
            order = np.arange(self.lanes) if not picks else rng.permutation(self.lanes)
            picks.append(order[: per * self.rows].reshape(per, self.rows))
        return np.concatenate(picks)[: self.bands]

    @property
    def words(self) -> int:
        return self.lanes * self.bits // 64

    @property
    def chance(self) -> float:
        """The probability that unequal minima agree in their low bits."""
        return 2.0**-self.bits

    def floor(self) -> float:
        """Estimates below this rule a pair out: the threshold less four standard errors."""
        s = self.threshold
        return s - 4 * (s * (1 - s) / self.lanes) ** 0.5


def shingle_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all k-character substrings of all texts, and each text's offsets into them.

    The texts are hashed as one array of code points; substrings that would
    run over a text's end are cut out by the offsets (end = start + len - k + 1).
    """
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = mix64(data * _M1 + _M2)
    n = max(0, len(x) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= _M2
        h += x[j : n + j]
    h = (mix64(h) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return h, starts


def signatures_of(texts: list[str], scheme: MinwiseScheme) -> np.ndarray:
    """len(texts) x words packed signatures as int64; every text has at least ``shingle`` characters."""
    h, starts = shingle_hashes(texts, scheme.shingle)
    mult = scheme.multipliers()
    step = 128  # rows of the product at a time: it stays in the cache
    buf = np.empty((step, scheme.lanes), np.uint32)
    out = np.empty((len(texts), scheme.lanes), np.uint32)
    for i in range(len(texts)):
        g = h[starts[i] : starts[i + 1] - scheme.shingle + 1]
        best = out[i]
        best.fill(0xFFFFFFFF)
        for c in range(0, len(g), step):
            part = g[c : c + step]
            b = np.multiply(part[:, None], mult, out=buf[: len(part)])
            np.minimum(best, b.min(0), out=best)
    low = mix64(out.astype(np.uint64) + _M1)  # minima crowd near zero; their mixed bits don't
    kind = np.uint8 if scheme.bits == 8 else np.uint16
    return low.astype(kind).view(np.int64)


def band_keys(signatures: np.ndarray, scheme: MinwiseScheme) -> np.ndarray:
    """n x bands keys: the band's number above 44 bits of a hash of its lanes."""
    kind = np.uint8 if scheme.bits == 8 else np.uint16
    v = np.ascontiguousarray(signatures).view(kind)[:, scheme.layout()].astype(np.uint64)
    key = np.zeros(v.shape[:2], np.uint64)
    for r in range(scheme.rows):
        key = mix64(key * _M1 + v[:, :, r] + np.uint64(1))
    no = np.arange(scheme.bands, dtype=np.uint64) << np.uint64(44)
    return ((key >> np.uint64(20)) | no).view(np.int64)


def content_keys(text: Column) -> list[Column]:
    """A 128-bit content hash as two bigints of different seeds: equal texts have equal keys."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def sign(df: DataFrame, id_col: str, text: Column, scheme: MinwiseScheme, label: str) -> DataFrame:
    """The written table (mid, id, h1, h2, sig) of all rows whose normal text is long enough.

    ``mid`` numbers the rows of the table.  Rows with a null or too short text
    are left out, as they are similar to none; so are rows with a null id.
    """
    id_type = df.schema[id_col].dataType
    # lengths are looked at in Python: a filter on t would make the normal text a second time
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("t")).select("id", *content_keys(F.col("t")), "t")
    least = max(scheme.min_chars, scheme.shingle)
    schema = T.StructType([T.StructField("id", id_type), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sig", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            b = b.filter(pc.greater_equal(pc.utf8_length(b.column("t")), least))  # null for a null text, which goes too
            texts, cols = b.column("t").to_pylist(), [b.column(c) for c in ("id", "h1", "h2")]
            for lo in range(0, len(texts), 500):
                part = texts[lo : lo + 500]
                s = signatures_of(part, scheme)
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * scheme.words)
                sig = pa.ListArray.from_arrays(offsets, pa.array(s.reshape(-1)))
                yield pa.RecordBatch.from_arrays([c.slice(lo, len(part)) for c in cols] + [sig], ["id", "h1", "h2", "sig"])

    signed = rows.mapInArrow(run, schema)
    return materialize(signed.select(F.monotonically_increasing_id().alias("mid"), "*"), label)


def classes_of(signed: DataFrame) -> DataFrame:
    """One row (h1, h2, cid) for each distinct text; cid is the smallest mid of its copies."""
    return signed.groupBy("h1", "h2").agg(F.min("mid").alias("cid"))


def explode_bands(sigs: DataFrame, key: str, scheme: MinwiseScheme) -> DataFrame:
    """(key, band) rows of the signatures."""
    schema = T.StructType([T.StructField(key, sigs.schema[key].dataType), T.StructField("band", T.LongType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = b.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bands = band_keys(s, scheme)
                at = pa.array(np.repeat(np.arange(b.num_rows), scheme.bands))
                yield pa.RecordBatch.from_arrays([b.column(key).take(at), pa.array(bands.reshape(-1))], [key, "band"])

    return sigs.select(key, "sig").mapInArrow(run, schema)


def estimate(a: Column, b: Column, scheme: MinwiseScheme) -> Column:
    """Collision-corrected similarity: lanes that differ are counted by XOR, folding and bit_count."""
    low = int("01" * 8, 16) if scheme.bits == 8 else int("0001" * 4, 16)

    def differing(x: Column) -> Column:
        s = scheme.bits // 2
        while s:
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
            s //= 2
        return F.bit_count(x.bitwiseAND(F.lit(low))).cast("int")

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    agree = 1 - unequal / F.lit(float(scheme.lanes))
    return (agree - scheme.chance) / (1 - scheme.chance)


#: Members of a band that are paired with each other inside one record of work.
CELL = 256


def _pairs_of_runs(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each run of ``ids``, run lengths at most CELL."""
    left, right = [ids[:0]], [ids[:0]]
    for n in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(int(n), 1)
        at = starts[sizes == n][:, None]
        left.append(ids[at + i].ravel())
        right.append(ids[at + j].ravel())
    return np.concatenate(left), np.concatenate(right)


def meet(batches, cell: int = CELL):
    """Rows (band, mid) in order of band -> (a, b) pairs of bands of at most ``cell`` members, and (band, no, ids) cells of larger ones.

    A band is never held as a whole: at most ``cell`` of its members wait for
    their cell to fill.
    """
    names = ["a", "b", "band", "no", "ids"]

    def pairs(left, right):
        none = pa.nulls(len(left))
        return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.list_(pa.int64()))], names)

    def cells(rows):
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names)

    band, held, no = None, np.zeros(0, np.int64), 0  # the run that may go on in the next batch
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids = b.column("band").to_numpy(), b.column("mid").to_numpy()
        if band is not None:
            keys, ids = np.concatenate([np.full(len(held), band), keys]), np.concatenate([held, ids])
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        out = []
        if band is not None and keys[0] != band:  # the open run has ended; its rest is a cell of its own
            no = 0
        first_no, last = (no if band is not None and keys[0] == band else 0), len(starts) - 1
        closed = sizes[:-1]
        small = closed <= cell
        if first_no and len(closed):
            small[0] = False  # the end of a band whose earlier cells have gone out
        left, right = _pairs_of_runs(ids, starts[:-1][small], closed[small])
        if len(left):
            yield pairs(left, right)
        for r in np.flatnonzero(~small):
            base = first_no if r == 0 else 0
            for k, lo in enumerate(range(0, int(closed[r]), cell)):
                out.append((int(keys[starts[r]]), base + k, ids[starts[r] + lo : min(starts[r] + lo + cell, starts[r] + closed[r])]))
        base = first_no if last == 0 else 0
        band, held, no = int(keys[starts[last]]), ids[starts[last] :], base
        while len(held) > cell:
            out.append((band, no, held[:cell]))
            held, no = held[cell:], no + 1
        if out:
            yield cells(out)
    if band is not None and len(held):
        if no:
            yield cells([(band, no, held)])
        else:
            left, right = _pairs_of_runs(held, np.array([0]), np.array([len(held)]))
            if len(left):
                yield pairs(left, right)


MET_SQL = "a bigint, b bigint, band bigint, no int, ids array<bigint>"


def band_pairs(bands: DataFrame, label: str, cell: int = CELL) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the mids that share a band, of (mid, band) rows.

    The rows are shuffled and sorted once.  A band of more than ``cell``
    members leaves its task as cells of ``cell`` members, and each pair of
    cells is a record of its own that any task may take: exact, and no task
    pairs the members of a hot band alone.
    """
    laid = bands.select("band", "mid").repartition("band").sortWithinPartitions("band")
    return pairs_met(laid.mapInArrow(lambda it: meet(it, cell), MET_SQL), label)


def pairs_met(rows: DataFrame, label: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of what ``meet`` gives."""
    met = materialize(rows, label)
    hot = met.where("band is not null").select("band", "no", "ids")
    two = hot.join(hot.withColumnsRenamed({"no": "no2", "ids": "ids2"}), "band").where("no <= no2").select((F.col("no") == F.col("no2")).alias("same"), "ids", "ids2")

    def across(batches):
        for b in batches:
            for same, x, y in zip(b.column("same").to_pylist(), b.column("ids"), b.column("ids2")):
                x, y = (np.asarray(v.values, np.int64) for v in (x, y))
                i, j = np.triu_indices(len(x), 1) if same else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
                yield pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(y[j])], ["a", "b"])

    pairs = met.where("a is not null").select("a", "b").union(two.mapInArrow(across, "a bigint, b bigint"))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def representatives(signed: DataFrame) -> DataFrame:
    """(mid, sig) of the first copy of each distinct text."""
    return signed.groupBy("h1", "h2").agg(F.min(F.struct("mid", "sig")).alias("m")).select("m.mid", "m.sig")


def candidate_pairs(signed: DataFrame, scheme: MinwiseScheme, label: str) -> DataFrame:
    """The written table (a, b) with a < b of class ids whose estimate doesn't rule them out.

    Copies are collapsed before the bands meet, so a text that fills a third of
    the table takes part once.  Band rows hold two numbers; signatures are
    fetched for distinct candidates only.
    """
    reps = materialize(representatives(signed), f"{label}-classes")
    pairs = band_pairs(explode_bands(reps, "mid", scheme), f"{label}-met")
    with_a = pairs.join(reps.withColumnsRenamed({"mid": "a", "sig": "sa"}), "a")
    with_b = with_a.join(reps.withColumnsRenamed({"mid": "b", "sig": "sb"}), "b")
    return materialize(with_b.where(estimate(F.col("sa"), F.col("sb"), scheme) >= scheme.floor()).select("a", "b"), label)


def jaccard_at_least(left: list[str], right: list[str], k: int, threshold: float) -> list[bool]:
    """Exact test on the distinct k-character substrings of each pair."""
    out = []
    for x, y in zip(left, right):
        s, t = {x[i : i + k] for i in range(len(x) - k + 1)}, {y[i : i + k] for i in range(len(y) - k + 1)}
        both = len(s & t)
        out.append(both >= threshold * (len(s) + len(t) - both) - 1e-9 if s or t else False)
    return out


#: Hash buckets of the prefilter that keeps texts without a candidate out of the shuffle: its broadcast has at most so many rows.
FILTER_BUCKETS = 1 << 18


def verified_pairs(pairs: DataFrame, signed: DataFrame, source: DataFrame, scheme: MinwiseScheme, label: str) -> DataFrame:
    """The written table of those (a, b) of ``pairs`` whose texts are similar enough; ``source`` has (id, t).

    A broadcast of at most FILTER_BUCKETS hash buckets first drops the texts
    of no pair, then a text travels to its pairs by two joins.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("mid")).distinct().join(signed.select("mid", "id", "h1", "h2"), "mid")
    bucket = F.pmod(F.xxhash64("id"), F.lit(FILTER_BUCKETS)).cast("int").alias("k")
    near = source.select("id", "t", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "k", "left_semi")
    few = wanted.join(near.select("id", *content_keys(F.col("t")), "t"), ["id", "h1", "h2"]).groupBy("mid").agg(F.first("t").alias("t"))
    both = pairs.join(few.withColumnsRenamed({"mid": "a", "t": "ta"}), "a").join(few.withColumnsRenamed({"mid": "b", "t": "tb"}), "b")

    def run(batches):
        for b in batches:
            ok = jaccard_at_least(b.column("ta").to_pylist(), b.column("tb").to_pylist(), scheme.shingle, scheme.threshold)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), label)
