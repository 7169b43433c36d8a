"""Problem 9: items of varying length in containers of fixed capacity.

Method: linear grouping.  Sizes are whole tokens, so the corpus is described
by a histogram of at most ``capacity`` counts, however many texts there are.
The plan is made from that histogram alone: large sizes are divided into groups
of equal cardinality and rounded up to the largest of their group; a linear
programme over few sizes, solved by column generation, chooses configurations;
actual items take the rounded places in order of size; small items are placed
best-fit into what is left.  The plan is a table of intervals (size, first and
last rank, container of the first, place), and every item finds its container
from its size and its rank among the items of that size.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wayfold.llm.tokens import DEFAULT_TOKENIZER, token_count
from wayfold.operators.ranking import distributed_rank
from wayfold.runtime import materialize

CAPACITY = 2048
#: A plan of at most so many intervals (40 bytes each) is sent to every task; a longer one is joined.
PLAN_ROWS = 1 << 20
#: Ranks of one size that the join of a long plan keeps together, as a power of two.
_RANK_BITS = 10


def _linear_groups(counts: np.ndarray, smallest: int, groups: int) -> list[tuple[int, int]]:
    """(rounded size, cardinality) from large to small; groups of about equal cardinality, or one for each size if these are few."""
    sizes = [s for s in range(len(counts) - 1, smallest - 1, -1) if counts[s]]
    if len(sizes) <= groups:
        return [(s, int(counts[s])) for s in sizes]
    total = int(sum(counts[s] for s in sizes))
    per, out = max(1, -(-total // groups)), []
    top, held = 0, 0
    for s in sizes:
        c = int(counts[s])
        while c:
            if not held:
                top = s
            take = min(c, per - held)
            held, c = held + take, c - take
            if held == per:
                out.append((top, held))
                held = 0
    if held:
        out.append((top, held))
    merged: list[list[int]] = []
    for s, n in out:
        if merged and merged[-1][0] == s:
            merged[-1][1] += n
        else:
            merged.append([s, n])
    return [(s, n) for s, n in merged]


def _best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration of highest total value: an unbounded knapsack over the capacity."""
    best, chosen = np.zeros(capacity + 1), []
    use = [i for i in range(len(sizes)) if value[i] > 1e-12]
    for i in use:
        s, before, number = sizes[i], best, np.zeros(capacity + 1, np.int32)
        best = before.copy()
        for k in range(1, capacity // s + 1):
            got, now = before[: capacity + 1 - k * s] + k * value[i], best[k * s :]
            more = got > now + 1e-12
            now[more] = got[more]
            number[k * s :][more] = k
        chosen.append(number)
    pattern, w = [0] * len(sizes), capacity
    for i, number in zip(reversed(use), reversed(chosen)):
        pattern[i] = int(number[w])
        w -= pattern[i] * sizes[i]
    return float(best[capacity]), pattern


def configurations(demand: list[tuple[int, int]], capacity: int, max_rounds: int = 300) -> list[tuple[list[int], int]]:
    """(items of each size, multiplicity): the programme's solution rounded down, the rest first-fit from large to small.

    Revised simplex with column generation; ``max_rounds`` bounds the columns
    beside one for each size.
    """
    sizes, need = [s for s, _ in demand], np.array([n for _, n in demand], float)
    k = len(sizes)
    if not k:
        return []
    columns = [[capacity // sizes[i] if j == i else 0 for j in range(k)] for i in range(k)]
    basis = np.array(columns, float).T
    for _ in range(max_rounds):
        inv = np.linalg.inv(basis)
        x, price = inv @ need, inv.sum(0)
        value, pattern = _best_pattern(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        d = inv @ np.array(pattern, float)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern  # its entry d[out] is positive, so the basis stays regular
    x = np.linalg.solve(basis, need)
    left, plan = need.astype(np.int64), []
    for j in np.argsort(-x):
        p = basis[:, j].astype(np.int64)
        n = int(max(0, np.floor(x[j] + 1e-6)))
        n = min([n, *(int(left[i] // p[i]) for i in range(k) if p[i])])
        if n:
            plan.append((p.tolist(), n))
            left -= p * n
    while left.any():  # whole configurations at a time: each pass ends a size
        p, room = [0] * k, capacity
        for i in range(k):
            p[i] = int(min(left[i], room // sizes[i]))
            room -= p[i] * sizes[i]
        n = min(int(left[i] // p[i]) for i in range(k) if p[i])
        plan.append((p, n))
        left -= np.array(p) * n
    return plan


def plan_containers(counts: np.ndarray, capacity: int = CAPACITY, small: float = 0.12, groups: int = 100) -> list[tuple[int, int, int, int, int]]:
    """Intervals (size, first rank, number, first container, offset): rank r is in container first + r - first rank.

    counts[s] is the number of items of s tokens, s from 1 to capacity; ranks
    count from 0 in each size.  Depends on the histogram only, as its length
    does on the capacity, never on the number of items.
    """
    smallest = max(1, int(capacity * small))
    demand = _linear_groups(counts, smallest, groups)
    # actual items in order of size: group i's places are taken by a run of (size, first rank, number)
    supply: list[list[list[int]]] = []
    order, used = [s for s in range(capacity, smallest - 1, -1) if counts[s]], {}
    for _, n in demand:
        run = []
        while n:
            s = order[0]
            free = int(counts[s]) - used.get(s, 0)
            take = min(free, n)
            run.append([s, used.get(s, 0), take])
            used[s], n = used.get(s, 0) + take, n - take
            if take == free:
                order.pop(0)
        supply.append(run)
    out: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[list[int]]] = {}  # room left: runs of containers (first, number)
    container = 0
    for pattern, times in configurations(demand, capacity):
        slots = [i for i, p in enumerate(pattern) for _ in range(p)]
        # each slot takes ``times`` items in order; where any slot's size changes, the run of containers is divided
        took = []
        for i in slots:
            mine, n = [], times
            while n:
                s, first, have = supply[i][0]
                t = min(have, n)
                mine.append((s, first, t))
                n -= t
                if t == have:
                    supply[i].pop(0)
                else:
                    supply[i][0] = [s, first + t, have - t]
            took.append(mine)
        cuts = sorted({0, times, *(c for mine in took for c in np.cumsum([t for _, _, t in mine]).tolist())})
        at = [[0, 0] for _ in took]  # the piece in use, and how much of it is used
        for lo, hi in zip(cuts, cuts[1:]):
            offset = 0
            for j, mine in enumerate(took):
                s, first, t = mine[at[j][0]]
                out.append((s, first + at[j][1], hi - lo, container + lo, offset))
                offset += s
                at[j][1] += hi - lo
                if at[j][1] == t:
                    at[j] = [at[j][0] + 1, 0]
            if capacity - offset:
                free.setdefault(capacity - offset, []).append([container + lo, hi - lo])
        container += times
    rooms = sorted(free)
    for s in range(smallest - 1, 0, -1):
        rank, n = 0, int(counts[s]) if s < len(counts) else 0
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):  # fresh containers, filled with as many of this size as they hold
                per = capacity // s
                whole, rest = divmod(n, per)
                for k in range(per if whole else 0):
                    out.append((s, rank + k * whole, whole, container, k * s))
                if whole and capacity - per * s:
                    free.setdefault(capacity - per * s, []).append([container, whole])
                container, rank = container + whole, rank + per * whole
                for k in range(rest):
                    out.append((s, rank + k, 1, container, k * s))
                if rest:
                    free.setdefault(capacity - rest * s, []).append([container, 1])
                    container += 1
                rooms, n = sorted(free), 0
                continue
            room = rooms[i]
            run = free[room][-1]
            t = min(run[1], n)
            out.append((s, rank, t, run[0], capacity - room))
            rank, n = rank + t, n - t
            if room - s:
                if room - s not in free:
                    bisect.insort(rooms, room - s)
                free.setdefault(room - s, []).append([run[0], t])
            run[0], run[1] = run[0] + t, run[1] - t
            if not run[1]:
                free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.remove(room)
    return out


def _placed_by_broadcast(ranked: DataFrame, plan: list[tuple]) -> DataFrame:
    """Ranked items with container and token_offset: every task has the whole plan, of at most PLAN_ROWS intervals."""
    key = np.array([(p[0], p[1]) for p in plan], np.int64).reshape(-1, 2)
    code = (key[:, 0] << 40) + key[:, 1]
    first, box, offset = (np.array([p[i] for p in plan], np.int64) for i in (1, 3, 4))
    shared = ranked.sparkSession.sparkContext.broadcast((code, first, box, offset))

    def run(batches):
        code, first, box, offset = shared.value
        for b in batches:
            size, r = b.column("size").to_numpy(), b.column("r").to_numpy() - 1
            if not len(code):
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, none, none.cast(pa.int32())], [*b.schema.names, "container", "token_offset"])
                continue
            at = np.maximum(np.searchsorted(code, (size.astype(np.int64) << 40) + r, side="right") - 1, 0)
            has = size > 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(box[at] + r - first[at], mask=~has), pa.array(offset[at].astype(np.int32), mask=~has)], [*b.schema.names, "container", "token_offset"])

    return ranked.mapInArrow(run, ranked.schema.simpleString()[7:-1].replace(":", " ") + ", container bigint, token_offset int")


def _placed_by_join(ranked: DataFrame, plan: list[tuple]) -> DataFrame:
    """The same with a longer plan: joined by size and block of ranks, so that items of one size are spread over many tasks."""
    cols = np.array(plan, np.int64).reshape(-1, 5)
    table = pa.table({n: cols[:, i] for i, n in enumerate(("size", "first", "n", "box", "offset"))})
    block = lambda c: F.shiftright(c, _RANK_BITS)
    spread = ranked.sparkSession.createDataFrame(table).withColumn("block", F.explode(F.sequence(block("first"), block(F.col("first") + F.col("n") - 1))))
    items = ranked.withColumn("block", block(F.col("r") - 1))
    within = (items["size"] == spread["size"]) & (items["block"] == spread["block"]) & (F.col("r") - 1 >= F.col("first")) & (F.col("r") - 1 < F.col("first") + F.col("n"))
    return items.join(spread, within, "left").select(*[items[c] for c in ranked.columns], (F.col("box") + F.col("r") - 1 - F.col("first")).alias("container"), F.col("offset").cast("int").alias("token_offset"))


def pack(sizes: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, container, place, token_offset, n_tokens, token_start) of every item with tokens.

    An item of more than ``capacity`` tokens fills containers of its own and
    its rest is an item like others; token_start is a piece's place in its
    item.  place counts the items of a container from 1, token_offset tokens
    from 0.  Items of size null or 0 need no room: their container and place
    are null.  Ids may repeat or be null: each row is an item.  An empty table
    gives an empty one.  The histogram gathered by the driver has at most
    ``capacity`` rows.
    """
    rows = sizes.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint").alias("n"))
    cut = rows.select("id", "n", F.floor(F.col("n") / capacity).cast("int").alias("whole"), (F.col("n") % capacity).cast("int").alias("rest"))
    fulls = cut.where("whole > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("whole"))).alias("piece_no"), F.lit(capacity).alias("size"))
    rests = cut.select("id", (F.col("whole") + 1).alias("piece_no"), F.col("rest").alias("size")).where("size > 0 or piece_no = 1")
    items = fulls.union(rests)
    ranked = distributed_rank(items, ["size"], [F.col("id").asc_nulls_first(), F.col("piece_no")], "r")
    ranked = materialize(ranked, "p9-ranked")
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in ranked.where("size > 0").groupBy("size").agg(F.max("r")).collect():  # at most ``capacity`` rows
        counts[s] = n
    plan = sorted(plan_containers(counts, capacity))
    placed = _placed_by_broadcast(ranked, plan) if len(plan) <= PLAN_ROWS else _placed_by_join(ranked, plan)
    # a container holds at most ``capacity`` items; items without one, perhaps a third of all, are spread
    own = F.coalesce("container", -1 - F.pmod(F.xxhash64("id", "piece_no", "r"), F.lit(1 << 40)))
    place = F.row_number().over(Window.partitionBy(own).orderBy("token_offset"))
    return placed.select(
        F.col("id").alias(id_col), "piece_no", "container", F.when(F.col("container").isNotNull(), place).alias("place"), "token_offset", F.col("size").alias("n_tokens"), ((F.col("piece_no") - 1) * F.lit(capacity)).cast("bigint").alias("token_start")
    )


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """Containers of the texts, measured in tokens; null and empty texts need no room."""
    sized = df.select(F.col(f"`{id_col}`").alias(id_col), token_count(F.col(f"`{text_col}`"), tokenizer, folder).alias("n"))
    return pack(materialize(sized, "p9-sizes"), id_col, "n", capacity)
