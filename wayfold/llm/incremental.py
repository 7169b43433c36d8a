"""Problem 2: new batches checked for duplicates against everything accepted before.

Method: bit-difference fingerprints kept in block tables.  A candidate's
fingerprint is cut into blocks, by one order of its lanes and then by rotated
orders; a block table holds (block key, candidate) rows, and the address is one
more block.  A new batch looks its own blocks up, the hits are verified by
their bit difference and then on the text, and the fingerprints and blocks of
the newly accepted are appended.  Neither texts nor fingerprints of the history
are read but for hits, and nothing of it is signed or compared again.

Plain SimHash bits can't serve the threshold of this data: texts that share
half of their substrings differ in a quarter of the bits, so that 99.7 % recall
takes 128 tables of 12-bit blocks, in which 3.6 % of all pairs meet.  The bits
of a block are therefore those of min-wise hashes (four 8-bit lanes each, 96
blocks), whose blocks unrelated texts hardly ever share.
"""

from __future__ import annotations

import functools
import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from wayfold.functions.text import squeeze_out, strip
from wayfold.llm.minwise import MET_SQL, MinwiseScheme, band_keys, content_keys, jaccard_at_least, meet, pairs_met, signatures_of
from wayfold.runtime import Files, discard, materialize

CANDIDATE_SCHEME = MinwiseScheme(threshold=0.5, min_chars=60, lanes=192, bits=8, bands=96, rows=4)
#: The packed block keys (8 bytes each) of so many rows are broadcast against the stored tables at once, each of the slices of a larger batch against its own parts of the tables; those of a batch of more than a slice for each of ``_SLOT_BITS`` are joined by a shuffle.
LOOKUP_ROWS = 1 << 15
#: At most so many hits travel to the stored fingerprints by a broadcast; more by a shuffle.
LOOKUP_HITS = 1 << 15
#: At most so many numbers of rows are broadcast to leave out the texts that nothing asks for.
LOOKUP_IDS = 1 << 18
#: A batch of at most so many rows is signed, compared and decided in order in one task; a larger one by distributed tables, with the same result.
TASK_ROWS = 1 << 12
#: So many (id, group) rows and links of a larger batch are decided in order in one task; more in rounds.
TASK_NODES = 1 << 19
#: Waiting batches are taken up together: up to FAN times the rows that came before, at most so many, or a sixteenth of those before if that is more.
TAKE_ROWS = 1 << 17
#: Bytes of a part of a block table, about.
PART_BYTES = 8 << 20
#: So many tables of one level are merged into one of the next.
FAN = 8
#: Tables of so many rows are merged no more: that would hold them twice on the disk.
MERGE_ROWS = 1 << 16

#: A block key is the block's number above so many bits of a hash; four lanes of 8 bits have no more.
_BLOCK_BITS = 32
#: Keys are divided into slots by their block and so many of their lowest bits.
_SLOT_BITS = 3
_PACKED_SQL = "slot int, base bigint, keys binary, ids binary"


def address_key(url_hash: Column) -> Column:
    """The url_hash without white space at its ends, in lower case; null when blank."""
    return F.nullif(F.lower(strip(url_hash)), F.lit(""))


def wording(title: Column, summary: Column) -> Column:
    """title followed by summary (null as empty), in lower case, all white space removed."""
    return F.lower(squeeze_out(F.concat(F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))))


def resolve_first_accepted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Which rows of an ordered stream are accepted, given groups and links between groups.

    nodes: (id, g), the groups g of each id, of which two ids match if they
    share a group or have linked groups.  links: (g, h) in both directions.
    Returns (id, first_id): first_id is null for an accepted id, else the
    smallest accepted id that it matches.

    An id is accepted once no smaller open id matches it, and a repeat once it
    matches a smaller accepted one.  A round takes up open ids only and works
    by minima per group; no pair inside a group is formed.  Every round settles
    the smallest open id of each component at least, so there are at most as
    many rounds as the longest chain of decisions.
    """
    unique = nodes.distinct()

    def around(values: DataFrame) -> DataFrame:
        """(g, id): the smallest id of each group and the groups linked to it."""
        low = values.groupBy("g").agg(F.min("id").alias("id"))
        return low.union(links.join(low, "g").select(F.col("h").alias("g"), "id")).groupBy("g").agg(F.min("id").alias("id"))

    open_nodes, taken = unique, []
    while True:
        low = around(open_nodes).withColumnRenamed("id", "low")
        first = open_nodes.join(low, "g").groupBy("id").agg(F.min("low").alias("low")).where("low = id").select("id")
        taken.append(materialize(open_nodes.join(first, "id", "left_semi"), "taken"))
        hit = around(taken[-1]).withColumnRenamed("id", "acc")
        settled = open_nodes.join(hit, "g").where("acc <= id").select("id").distinct()
        open_nodes = materialize(open_nodes.join(settled, "id", "left_anti"), "open")
        if not open_nodes.limit(1).count():
            break
    accepted = taken[0]
    for t in taken[1:]:
        accepted = accepted.union(t)
    best = around(accepted).withColumnRenamed("id", "acc")
    found = unique.join(best, "g").groupBy("id").agg(F.min("acc").alias("acc"))
    return found.select("id", F.when(F.col("acc") < F.col("id"), F.col("acc")).alias("first_id"))


def _same(x: np.ndarray, y: np.ndarray, left: list[str], right: list[str], s: MinwiseScheme) -> np.ndarray:
    """Which pairs agree: by the bit difference of their fingerprints (n x words), then on the texts."""
    lanes = (x ^ y).view(np.uint8 if s.bits == 8 else np.uint16).reshape(len(x), s.lanes)
    agree = 1 - (lanes != 0).sum(1) / s.lanes
    ok = (agree - s.chance) / (1 - s.chance) >= s.floor()
    at = np.flatnonzero(ok)
    ok[at] = jaccard_at_least([left[i] for i in at], [right[i] for i in at], s.shingle, s.threshold)
    return ok


def _words(column: pa.Array, s: MinwiseScheme) -> np.ndarray:
    """The fingerprints of a column without nulls, n x words."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, s.words)


def _decide(rows: list[tuple], links: list[tuple], s: MinwiseScheme) -> dict[int, int | None]:
    """id -> None if accepted, else the smallest accepted id that it matches: one pass in order of id.

    rows: (id, address or None, content key, wording, fingerprint or None);
    links: (of wordings, id, first half of the content key, accepted id of the
    history).  A row is compared
    with the accepted only, by its blocks, so copies and near copies of one
    text cost no more than others.
    """
    by_id: dict[int, list[tuple]] = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    old: dict[tuple, int] = {}
    for worded, a, h1, b in links:
        for r in by_id[a]:
            if r[2][0] == h1:
                g = ("w", r[2]) if worded else ("u", r[1])
                old[g] = min(b, old.get(g, b))
    signed = [r for r in rows if r[4] is not None]
    keys = dict(zip(((r[0], r[2]) for r in signed), band_keys(np.array([r[4] for r in signed], np.int64), s).tolist())) if signed else {}
    blocks: dict[int, list[tuple]] = {}
    taken: dict[tuple, int] = {}
    out: dict[int, int | None] = {}
    for i in sorted(by_id):
        hits = []
        for r in by_id[i]:
            groups = [("u", r[1])] * (r[1] is not None) + [("w", r[2])] * (r[4] is not None)
            hits += [d[g] for g in groups for d in (old, taken) if g in d]
        if not hits:
            for r in by_id[i]:
                if r[4] is None:
                    continue
                near = {id(o): o for k in keys[r[0], r[2]] for o in blocks.get(k, ())}
                if near:
                    others = list(near.values())
                    ok = _same(np.array([r[4]] * len(others), np.int64), np.array([o[4] for o in others], np.int64), [r[3]] * len(others), [o[3] for o in others], s)
                    hits += [o[0] for o, k in zip(others, ok) if k]
        out[i] = min(hits) if hits else None
        if not hits:
            for r in by_id[i]:
                if r[1] is not None:
                    taken["u", r[1]] = i
                if r[4] is not None:
                    taken["w", r[2]] = i
                    for k in keys[r[0], r[2]]:
                        blocks.setdefault(k, []).append(r)
    return out


def block_keys(signatures: np.ndarray, s: MinwiseScheme) -> np.ndarray:
    """n x bands keys of ``_BLOCK_BITS`` bits below the block's number."""
    return band_keys(signatures, s) >> (44 - _BLOCK_BITS)


def _packed(slots: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> list[tuple]:
    """(slot, base, keys, ids) for each slot: the low 32 bits of its keys in order, and their ids as differences to the smallest, in as few bytes as hold them."""
    order = np.argsort(slots.astype(np.int64) << 32 | keys & 0xFFFFFFFF)
    slots, low, ids = slots[order], keys[order].astype(np.uint32), ids[order]
    starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else []
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(slots)]):
        base = int(ids[lo:hi].min())
        far = ids[lo:hi].astype(np.uint64) - np.uint64(base & (2**64 - 1))  # wraps round, so that ids of any sign have a difference
        top = int(far.max())
        kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
        out.append((int(slots[lo]), base, low[lo:hi].tobytes(), far.astype(kind).tobytes()))
    return out


def _each(b: pa.RecordBatch, *names: str):
    """The values of packed rows, one row after the other and without copying their keys and ids."""
    value = lambda x: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py()
    cols = [b.column(n) for n in names]
    for i in range(b.num_rows):
        yield [value(c[i]) for c in cols]


def _unpacked(base: int, keys: pa.Buffer, ids: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """The low keys and the ids of a packed row."""
    low = np.frombuffer(keys, np.uint32)
    kind = {2: np.uint16, 4: np.uint32, 8: np.uint64}[ids.size // len(low)]
    return low, (np.frombuffer(ids, kind).astype(np.uint64) + np.uint64(base & (2**64 - 1))).view(np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys >> _BLOCK_BITS << _SLOT_BITS) | (keys & ((1 << _SLOT_BITS) - 1))).astype(np.int32)


def _whole(slot: int, low: np.ndarray) -> np.ndarray:
    """Keys by their slot and low bits."""
    return low.astype(np.int64) | ((slot >> _SLOT_BITS) << _BLOCK_BITS)


def _keyed(rows: DataFrame, id_col: str, s: MinwiseScheme, parts: int) -> DataFrame:
    """(part, slot, base, keys, ids) rows of the block keys of rows (``id_col``, h1, h2, address, sig), one for each part, slot and task.

    Of rows of a task that are equal in wording or address only the first has keys.
    """

    def run(batches):
        seen: set = set()
        for b in batches:
            if not b.num_rows:
                continue
            ids, address, has = b.column(id_col).to_numpy(), b.column("address").to_pylist(), pc.is_valid(b.column("sig")).to_pylist()
            new_text, new_address = [], []
            for i, (h, a, k) in enumerate(zip(zip(b.column("h1").to_pylist(), b.column("h2").to_pylist()), address, has)):
                if k and h not in seen:
                    seen.add(h)
                    new_text.append(i)
                if a is not None and a not in seen:
                    seen.add(a)
                    new_address.append(i)
            keys, of = [np.array([address[i] for i in new_address], np.int64)], [ids[new_address]]
            if new_text:
                keys.append(block_keys(_words(b.column("sig").take(pa.array(new_text)), s), s).reshape(-1))
                of.append(np.repeat(ids[new_text], s.bands))
            yield from _rows(np.concatenate(keys), np.concatenate(of), parts)

    return rows.select(id_col, "h1", "h2", "address", "sig").mapInArrow(run, f"part int, {_PACKED_SQL}")


def _rows(keys: np.ndarray, ids: np.ndarray, parts: int):
    """The packed rows of keys and their ids by part."""
    slots, part = _slots(keys).astype(np.int64), keys & (parts - 1)
    if out := _packed(part * _SPAN + slots, keys, ids):
        both, *rest = zip(*out)
        cols = [[n // _SPAN for n in both], [n % _SPAN for n in both], *rest]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "slot", "base", "keys", "ids"])


#: More than there are slots.
_SPAN = 1 << 10
#: About so many rows' keys are packed together by one task.
_TASK_KEYED = 1 << 13
_FIRST_SQL = "id bigint, first_id bigint"


def _repeats(first: dict[int, int | None]) -> pa.RecordBatch:
    found = [(i, f) for i, f in first.items() if f is not None]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["id", "first_id"])


def _decide_groups(batches):
    """The repeats (id, first_id) of rows (kind, x, y): 0, an id and a group of it; 1, two linked groups; 2, a group and the accepted id of the history that it matches."""
    of, linked, old, taken, out = {}, {}, {}, {}, {}
    for b in batches:
        for kind, x, y in zip(*(c.to_pylist() for c in b.columns)):
            if kind == 2:
                old[x] = min(y, old.get(x, y))
            else:
                (linked if kind else of).setdefault(x, []).append(y)
    for i in sorted(of):
        hits = [old[g] for g in of[i] if g in old]
        hits += [taken[h] for g in of[i] for h in (g, *linked.get(g, ())) if h in taken]
        out[i] = min(hits) if hits else None
        if not hits:
            taken |= dict.fromkeys(of[i], i)
    yield _repeats(out)


def _pieces(batches) -> tuple[np.ndarray, np.ndarray]:
    """All keys and ids of packed rows."""
    keys, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        for slot, *row in _each(b, "slot", "base", "keys", "ids"):
            low, i = _unpacked(*row)
            keys.append(_whole(slot, low))
            ids.append(i)
    return np.concatenate(keys), np.concatenate(ids)


def _repacked(packed: DataFrame, parts: int) -> DataFrame:
    """Packed rows divided into ``parts``."""

    def run(batches):
        for b in batches:
            yield from _rows(*_pieces([b]), parts)

    return packed.select("slot", "base", "keys", "ids").mapInArrow(run, f"part int, {_PACKED_SQL}")


def _gathered(packed: DataFrame, tasks: int, parts: int) -> DataFrame:
    """Packed rows, one for each part and slot, of those of several tasks or tables; divided by part, or by slot if there is one part."""
    laid = packed.repartition(tasks, "part" if parts > 1 else "slot")
    return laid.select("slot", "base", "keys", "ids").mapInArrow(lambda batches: _rows(*_pieces(batches), parts), f"part int, {_PACKED_SQL}")


def _looked_up(stored: DataFrame, mine: DataFrame) -> DataFrame:
    """(slot, a, b) of equal keys in the packed rows of ``mine`` (a) and of the stored tables (b)."""

    def run(batches):
        for b in batches:
            out = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for slot, *row in _each(b, "slot", "base", "keys", "ids", "base2", "keys2", "ids2"):
                (x, xi), (y, yi) = _unpacked(*row[:3]), _unpacked(*row[3:])
                lo = np.searchsorted(x, y)
                at = np.flatnonzero(x[np.minimum(lo, len(x) - 1)] == y)
                if len(at):
                    lo = lo[at]
                    n = np.searchsorted(x, y[at], "right") - lo
                    j = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())  # lo, lo + 1, ... of each
                    out.append((np.full(len(j), slot, np.int32), np.repeat(yi[at], n), xi[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["slot", "a", "b"])

    both = stored.join(mine.select("slot", F.col("base").alias("base2"), F.col("keys").alias("keys2"), F.col("ids").alias("ids2")), "slot")
    return both.select("slot", "base", "keys", "ids", "base2", "keys2", "ids2").mapInArrow(run, "slot int, a bigint, b bigint")


def _met(blocks: DataFrame, s: MinwiseScheme, label: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the rows whose wordings share a block, of packed rows that hold their slots whole."""

    def run(batches):
        def ordered():
            for b in batches:
                for slot, *row in _each(b, "slot", "base", "keys", "ids"):
                    low, ids = _unpacked(*row)
                    more = np.flatnonzero(low[1:] == low[:-1])
                    at = np.union1d(more, more + 1)  # keys that occur twice at least
                    yield pa.RecordBatch.from_arrays([pa.array(_whole(slot, low[at])), pa.array(ids[at])], ["band", "mid"])

        return meet(ordered())

    met = blocks.where(F.col("slot") < s.bands << _SLOT_BITS).select("slot", "base", "keys", "ids").mapInArrow(run, MET_SQL)
    return pairs_met(met, label)


class IncrementalDeduper:
    """Everything accepted so far, in a folder: fingerprints by candidate and block tables by key.

    ``commits/<no>`` is the marker of a batch and names the tables that stand
    after it; tables without a marker are not read, so a batch that was broken
    off and is repeated changes nothing, and a batch that was committed is not
    applied again: its decisions are returned.  Tables are divided into parts
    by key, as many as their size asks for, and a batch reads only the parts
    that its keys fall into.  ``fan`` tables of one level are merged into one
    of the next, up to ``MERGE_ROWS``, so that there are few tables however many
    batches came.  Block keys are stored packed, a row for each slot of a part.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, scheme: MinwiseScheme = CANDIDATE_SCHEME, part_bytes: int = PART_BYTES, fan: int = FAN, task_rows: int = TASK_ROWS, task_nodes: int = TASK_NODES):
        self.spark, self.folder, self.scheme, self.part_bytes, self.fan, self.task_rows, self.task_nodes = spark, folder.rstrip("/"), scheme, part_bytes, fan, task_rows, task_nodes
        self.files = Files(spark, folder)
        self.commits = [json.loads(self.files.read(f"{self.folder}/commits/{n}")) for n in self.files.names(f"{self.folder}/commits") if n.endswith(".json")]

    # -- tables

    def _tables(self) -> list[dict]:
        return self.commits[-1]["tables"] if self.commits else []

    def _commit(self, name: str | None, tables: list[dict], **notes) -> None:
        c = {"batch": name, "tables": tables, "holds": []} | notes
        self.files.write(f"{self.folder}/commits/{len(self.commits):09d}.json", json.dumps(c))
        self.commits.append(c)

    def _listed(self, path: str, parts: int, level: int, n: int) -> dict:
        """What a marker says of a table: its folder, the parts that exist and the rows of its batches."""
        at = lambda kind: [int(n[5:]) for n in self.files.names(f"{path}/kind={kind}") if n.startswith("part=")]
        return {"path": path, "level": level, "n": n, "parts": parts, "rows": at("rows"), "blocks": at("blocks")}

    def _paths(self, kind: str, hit: set[int] | None, most: int) -> list[str]:
        """The folders of the parts that ``hit``, numbers modulo ``most``, falls into; of all parts for None."""
        out = []
        for t in self._tables():
            want = None if hit is None else {h % t["parts"] for h in hit}
            out += [f"{t['path']}/kind={kind}/part={p}" for p in t[kind] if want is None or p in want]
        return out

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def decisions(self, names: list[str] | None = None) -> DataFrame:
        """(candidate_id, first_id) of the named batches, or of all; first_id is null for the accepted."""
        paths = [c["decisions"] for c in self.commits if c["batch"] is not None and (names is None or not {c["batch"], *c["holds"]}.isdisjoint(names))]
        return self._read([p for p in paths if p], "candidate_id bigint, first_id bigint").distinct()

    # -- a batch

    def _signed(self, batch: DataFrame) -> tuple[DataFrame, int, int]:
        """The written rows (id, u, t, h1, h2, p, address, sig, mid) of a batch, their number and the largest mid.

        sig is null for a wording that agrees with none; mid numbers the rows.
        """
        s, address = self.scheme, F.shiftrightunsigned(F.xxhash64("u"), 64 - _BLOCK_BITS).bitwiseOR(F.lit(self.scheme.bands << _BLOCK_BITS))
        rows = batch.where(F.col("candidate_id").isNotNull()).select(F.col("candidate_id").cast("bigint").alias("id"), address_key(F.col("url_hash")).alias("u"), wording(F.col("title"), F.col("summary")).alias("t"))
        rows = rows.select("id", "u", "t", *content_keys(F.col("t")), F.xxhash64("id").alias("p"), F.when(F.col("u").isNotNull(), address).alias("address"))

        def run(batches):
            for b in batches:
                texts = b.column("t").to_pylist()
                own = np.array([len(t) >= max(s.min_chars, s.shingle) for t in texts], bool)
                at = np.flatnonzero(own)
                sig = [signatures_of([texts[i] for i in at[lo : lo + 500]], s) for lo in range(0, len(at), 500)]
                ends = np.concatenate([[0], np.cumsum(own) * s.words]).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros((0, s.words), np.int64), *sig]).reshape(-1)), mask=pa.array(~own))
                yield pa.RecordBatch.from_arrays([*b.columns, sigs], [*b.schema.names, "sig"])

        seen = Observation()
        signed = rows.mapInArrow(run, "id bigint, u string, t string, h1 bigint, h2 bigint, p bigint, address bigint, sig array<bigint>").withColumn("mid", F.monotonically_increasing_id())
        return materialize(signed.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.max("mid"), F.lit(0)).alias("top")), "p2-batch"), seen.get["n"], seen.get["top"]

    def _history(self, signed: DataFrame, blocks: DataFrame, n: int, spare: list[DataFrame]) -> tuple[DataFrame | None, DataFrame | None, int]:
        """The links (worded, a, h1, b) of rows (a, h1) of a batch with accepted candidates b, None without any; the written hits that they are made of; and the bytes of the parts read."""
        s, most = self.scheme, max((t["parts"] for t in self._tables()), default=1)
        hit = None
        if most > 1 and n * (s.bands + 1) < 8 * most:  # more keys fall into every part

            def run(batches):
                for b in batches:
                    at = [_whole(slot, _unpacked(*row)[0]) % most for slot, *row in _each(b, "slot", "base", "keys", "ids")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *at])))], ["part"])

            hit = {r[0] for r in blocks.select("slot", "base", "keys", "ids").mapInArrow(run, "part bigint").distinct().collect()}
        paths = self._paths("blocks", hit, most)
        if not paths:
            return None, None, 0
        looked = sum(self.files.size(p) for p in paths)
        find = lambda paths, mine: _looked_up(self._read(paths, _PACKED_SQL), mine).select((F.col("slot") < s.bands << _SLOT_BITS).alias("worded"), F.col("a").alias("mid"), "b").distinct()
        slices = 1 << (max(1, n) - 1 >> LOOKUP_ROWS.bit_length() - 1).bit_length()
        if slices > 1 << _SLOT_BITS:
            met = find(paths, blocks)
        elif slices == 1:
            met = find(paths, F.broadcast(blocks))
        else:  # the lowest bits of a slot are those of its keys, which number the parts
            some = [materialize(find(self._paths("blocks", set(range(i, max(most, slices), slices)), most), F.broadcast(blocks.where(F.col("slot") % slices == i))), "p2-looked") for i in range(slices)]
            spare += some
            met = functools.reduce(DataFrame.union, some).distinct()
        seen = Observation()
        met = materialize(met.observe(seen, F.count(F.lit(1)).alias("n")), "p2-hits")
        if not (n_met := seen.get["n"]):
            return None, met, looked
        # the stored rows of hits only
        few = lambda d: F.broadcast(d) if n_met <= LOOKUP_IDS else d
        hit = {r[0] for r in met.select(F.pmod(F.xxhash64("b"), F.lit(most)).cast("int")).distinct().collect()} if most > 1 else None
        paths = self._paths("rows", hit, most)
        looked += sum(self.files.size(p) for p in paths)
        others = self._read(paths, "id bigint, u string, t string, sig array<bigint>").toDF("b", "ub", "tb", "sb")
        asked = signed.select("mid", F.col("id").alias("a"), "h1", F.col("u").alias("ua"), F.col("t").alias("ta"), F.col("sig").alias("sa")).join(few(met), "mid")
        both = others.join(F.broadcast(asked), "b") if n_met <= LOOKUP_HITS else others.join(few(met.select("b").distinct()), "b", "left_semi").join(asked, "b")
        return self._verified(both), met, looked

    def _verified(self, both: DataFrame) -> DataFrame:
        """The (worded, a, h1, b) of rows (worded, a, h1, b, ua, ub, ta, tb, sa, sb) that agree in their wording or are equal in their address."""
        s = self.scheme

        def verify(batches):
            for b in batches:
                worded = b.column("worded").to_numpy(zero_copy_only=False)
                ok = pc.fill_null(pc.equal(b.column("ua"), b.column("ub")), False).to_numpy(zero_copy_only=False) & ~worded
                ready = worded & pc.and_(pc.is_valid(b.column("sa")), pc.is_valid(b.column("sb"))).to_numpy(zero_copy_only=False)
                c = b.filter(pa.array(ready))
                ok[np.flatnonzero(ready)] = _same(_words(c.column("sa"), s), _words(c.column("sb"), s), c.column("ta").to_pylist(), c.column("tb").to_pylist(), s)
                yield b.select(["worded", "a", "h1", "b"]).filter(pa.array(ok))

        return both.select("worded", "a", "h1", "b", "ua", "ub", "ta", "tb", "sa", "sb").mapInArrow(verify, "worded boolean, a bigint, h1 bigint, b bigint")

    def add_batch(self, batch: DataFrame, name: str | None = None, holds: list[str] | None = None) -> DataFrame:
        """Check a batch (candidate_id, title, summary, url_hash) against everything accepted and against itself, and append what it accepts.

        Returns (candidate_id, first_id): first_id is null for an accepted
        candidate, else the smallest accepted one that it matches.  Within the
        batch candidates are taken by rising id.  Null title or summary counts
        as empty, a null or blank url_hash matches none, a wording below
        ``min_chars`` agrees with none; rows with a null id are left out; a
        repeated id counts once, with the wordings and addresses of all its
        rows; an empty batch is committed like any other.  ``holds``: the names
        of batches of which this one is made.
        """
        name = name or uuid.uuid4().hex
        if any(c["batch"] == name for c in self.commits):
            return self.decisions([name])
        signed, n, top = self._signed(batch)
        spare, bits = [signed], (top >> 33).bit_length()
        # the task's number below the row's: mids that differ little take fewer bytes
        signed = signed.withColumn("mid", F.shiftleft(F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)), bits).bitwiseOR(F.shiftright("mid", 33)))
        blocks = _gathered(_keyed(signed, "mid", self.scheme, 1), 1 + n // _TASK_KEYED, 1)
        if n > self.task_rows:
            spare.append(blocks := materialize(blocks, "p2-blocks"))
        links, met, looked = self._history(signed, blocks, n, spare)
        first = self._in_task(signed, links) if n <= self.task_rows else self._at_large(signed, blocks, links, spare)
        seen = Observation()
        first = materialize(first.observe(seen, F.count(F.lit(1)).alias("n")), "p2-first")
        self._append(name, holds or [], signed, n, F.broadcast(first) if seen.get["n"] <= LOOKUP_IDS else first, looked)
        for t in (first, met, *spare):
            if t is not None:
                discard(t)
        return self.decisions([name])

    def _in_task(self, signed: DataFrame, links: DataFrame | None) -> DataFrame:
        """The repeats (id, first_id) among at most ``task_rows`` rows."""
        s = self.scheme
        rows = signed.select("id", "u", "t", "h1", "h2", "sig", F.lit(None).cast("boolean").alias("worded"), F.lit(None).cast("bigint").alias("b"))
        if links is not None:
            rows = rows.unionByName(links.select(F.col("a").alias("id"), "h1", "worded", "b"), allowMissingColumns=True)

        def run(batches):
            batches = [b for b in batches if b.num_rows]
            if not batches:
                return
            every = pa.Table.from_batches(batches)
            link = pc.is_valid(every.column("worded"))
            mine, k = every.filter(pc.invert(link)), every.filter(link)
            at = lambda t, *names: zip(*(t.column(c).to_pylist() for c in names))
            rows = [(i, u, (h1, h2), t, g) for i, u, h1, h2, t, g in at(mine, "id", "u", "h1", "h2", "t", "sig")]
            yield _repeats(_decide(rows, list(at(k, "worded", "id", "h1", "b")), s))

        return (rows.coalesce(1) if links is None else rows.repartition(1)).mapInArrow(run, _FIRST_SQL)

    def _at_large(self, signed: DataFrame, blocks: DataFrame, links: DataFrame | None, spare: list[DataFrame]) -> DataFrame:
        """The same for batches of any size; what it writes is added to ``spare``."""
        s = self.scheme

        def keep(df: DataFrame, label: str) -> DataFrame:
            spare.append(materialize(df, f"p2-{label}"))
            return spare[-1]

        def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
            seen = Observation()
            return keep(df.observe(seen, F.count(F.lit(1)).alias("n")), label), seen.get["n"]

        worded = signed.where("sig is not null").groupBy("h1", "h2").agg(F.min("mid").alias("cid"))
        addressed = signed.where("u is not null").groupBy("u").agg(F.min("mid").alias("aid"))
        named = signed.select("mid", "id", "u", "h1", "h2").join(worded, ["h1", "h2"], "left").join(addressed, "u", "left")
        # a group is a wording or an address: a number that is even or odd
        named = keep(named.select("mid", "id", "h1", (F.col("cid") * 2).alias("w"), (F.col("aid") * 2 + 1).alias("u")), "named")
        nodes = named.select("id", F.explode(F.filter(F.array("w", "u"), lambda g: g.isNotNull())).alias("g")).distinct()
        pairs, n_pairs = counted(_met(blocks, s, "p2-met"), "pairs")
        few = lambda d: F.broadcast(d) if 2 * n_pairs <= LOOKUP_IDS else d
        asked = signed.join(few(pairs.select(F.explode(F.array("a", "b")).alias("mid")).distinct()), "mid", "left_semi")
        side = lambda c: asked.select(F.col("mid").alias(c), F.lit(None).cast("string").alias(f"u{c}"), F.col("t").alias(f"t{c}"), F.col("sig").alias(f"s{c}"))
        same = self._verified(pairs.select(F.lit(True).alias("worded"), "a", F.lit(0).cast("bigint").alias("h1"), "b").join(side("a"), "a").join(side("b"), "b"))
        group = lambda c, g: named.select(F.col("mid").alias(c), F.col("w").alias(g))
        inner = same.select("a", "b").join(group("a", "g"), "a").join(group("b", "h"), "b").where("g <> h").select("g", "h")
        inner, n_inner = counted(inner.union(inner.select("h", "g")).distinct(), "inner")
        old = self.spark.createDataFrame([], "g bigint, b bigint")
        if links is not None:
            old = links.join(named.withColumnRenamed("id", "a"), ["a", "h1"]).select(F.when(F.col("worded"), F.col("w")).otherwise(F.col("u")).alias("g"), "b").groupBy("g").agg(F.min("b").alias("b"))
        old, n_old = counted(old, "old")
        # only groups of several ids, with links or with a match in the history decide anything
        busy = nodes.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("g").union(inner.select("g")).union(old.select("g")).distinct()
        nodes, n_nodes = counted(nodes.join(busy, "g", "left_semi").select("id", "g"), "nodes")
        if n_nodes + n_inner + n_old <= self.task_nodes:
            every = [d.select(F.lit(k).alias("kind"), F.col(d.columns[0]).alias("x"), F.col(d.columns[1]).alias("y")) for k, d in enumerate((nodes, inner, old))]
            return every[0].union(every[1]).union(every[2]).repartition(1).mapInArrow(_decide_groups, _FIRST_SQL)
        against = keep(nodes.join(old, "g").groupBy("id").agg(F.min("b").alias("acc")), "against")
        fresh = keep(nodes.join(against, "id", "left_anti"), "fresh")
        among = resolve_first_accepted(fresh, inner)
        # a repeat of the history may also match a smaller one that this batch accepted
        taken = fresh.join(among.where("first_id is null").select("id"), "id", "left_semi").groupBy("g").agg(F.min("id").alias("acc"))
        taken = taken.union(inner.join(taken, "g").select(F.col("h").alias("g"), "acc"))
        late = nodes.join(against.select("id"), "id", "left_semi").join(taken, "g").where("acc < id").groupBy("id").agg(F.min("acc").alias("own"))
        settled = against.join(late, "id", "left").select("id", F.least("acc", "own").alias("first_id")).union(among)
        return settled.where("first_id is not null")

    def _append(self, name: str, holds: list[str], signed: DataFrame, n: int, first: DataFrame, looked: int) -> None:
        """Write a batch's decisions and the fingerprints and blocks of what it accepts, then its marker."""
        path, parts = f"{self.folder}/tables/{name}", self._parts(n * (self.scheme.bands + 1) * 8)
        write = lambda df, kind, *by: df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{path}/kind={kind}")
        write(signed.select(F.col("id").alias("candidate_id")).join(first.withColumnRenamed("id", "candidate_id"), "candidate_id", "left"), "decisions")
        kept = signed.join(first, "id", "left_anti")
        rows = kept.select("id", "u", "t", "sig", F.pmod("p", F.lit(parts)).cast("int").alias("part"))
        write(rows.repartition(parts, "part") if parts > 1 else rows, "rows", "part")
        write(_gathered(_keyed(kept, "id", self.scheme, parts), max(1 + n // _TASK_KEYED, parts), parts), "blocks", "part")
        new = self._listed(path, parts, 0, n)
        self._commit(name, [*self._tables(), new], holds=holds, rows=n, decisions=f"{path}/kind=decisions", bytes_read=looked, bytes_held=sum(self.files.size(p) for k in ("blocks", "rows") for p in self._paths(k, None, 1)))
        self._merge()

    def _parts(self, size: int) -> int:
        return 1 << max(0, (max(1, size) - 1) // self.part_bytes).bit_length()

    def _merge(self) -> None:
        """Merge the tables of a level once there are ``fan`` of them; a commit of its own."""
        levels: dict[int, list[dict]] = {}
        for t in self._tables():
            if t["n"] < MERGE_ROWS:
                levels.setdefault(t["level"], []).append(t)
        for level, group in sorted(levels.items()):
            if len(group) < self.fan:
                continue
            path = f"{self.folder}/tables/merged-{uuid.uuid4().hex}"
            sources = {k: [f"{t['path']}/kind={k}/part={p}" for t in group for p in t[k]] for k in ("blocks", "rows")}
            size = sum(self.files.size(p) for p in sources["blocks"])
            parts = self._parts(size)
            if sources["rows"]:
                laid = self._read(sources["rows"], "id bigint, u string, t string, sig array<bigint>").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
                laid.repartition(parts, "part").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/kind=rows")
            if sources["blocks"]:
                laid = self._read(sources["blocks"], _PACKED_SQL)
                if parts > 1:  # packed again by the new parts before they leave their task
                    laid = _repacked(laid, parts)
                _gathered(laid, max(1 + size // (8 * 97 * _TASK_KEYED), parts), parts).write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/kind=blocks")
            merged = self._listed(path, parts, level + 1, sum(t["n"] for t in group))
            self._commit(None, [t for t in self._tables() if t not in group] + [merged])
            for t in group:  # no marker in force names them any more
                for k in sources:
                    self.files.delete(f"{t['path']}/kind={k}")
            return self._merge()


def dedup_in_batches(df: DataFrame, batch_col: str, store: IncrementalDeduper) -> DataFrame:
    """(candidate_id, first_id) of all rows, added to ``store`` batch by batch.

    Batches come in order of ``batch_col``, rows without a batch number first;
    see ``IncrementalDeduper.add_batch`` for all else.  Batches that wait are
    taken up together, as many as the store's size allows, if their ids rise
    from one to the next: the result is the same, as candidates are taken by
    rising id.  The driver gathers a row for each batch; an empty table has no
    batch and gives an empty result.
    """
    spark, ids = store.spark, F.col("candidate_id").cast("bigint")
    waiting = df.groupBy(F.col(batch_col).alias("no")).agg(F.count(ids).alias("n"), F.min(ids).alias("lo"), F.max(ids).alias("hi")).orderBy(F.col("no").asc_nulls_first()).collect()
    names = [f"batch-{r.no}" for r in waiting]
    held = {x for c in store.commits for x in (c["batch"], *c.get("holds", []))}
    waiting = [r for r in waiting if f"batch-{r.no}" not in held]
    before = sum(c.get("rows", 0) for c in store.commits)
    while waiting:
        most, take, n, hi = max(min(store.fan * before, TAKE_ROWS), before // 16), [], 0, None
        while waiting and (not take or take[0].no is not None and n + waiting[0].n <= most and (None in (hi, waiting[0].lo) or hi < waiting[0].lo)):
            take.append(waiting.pop(0))
            n, hi = n + take[-1].n, hi if take[-1].hi is None else take[-1].hi
        first, last = take[0].no, take[-1].no
        mine = df.where(F.col(batch_col).isNull() if first is None else F.col(batch_col) == first if first == last else F.col(batch_col).isin([r.no for r in take]))
        store.add_batch(mine, f"batch-{first}" if len(take) == 1 else f"batches-{first}-{last}", [f"batch-{r.no}" for r in take])
        before += n
        spark.sparkContext._jvm.System.gc()  # shuffle files are deleted once the driver has collected what refers to them
    out = store.decisions(names)
    if any(not set(c["holds"]) <= set(names) for c in store.commits if c["batch"] is not None and not set(c["holds"]).isdisjoint(names)):
        out = out.join(df.select(ids.alias("candidate_id")).distinct(), "candidate_id", "left_semi")
    return out
