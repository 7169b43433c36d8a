"""Every corpus operator against brute force on small tables with nulls, ties, repeats, long texts and clashing names."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.llm import capping, incremental, near_duplicates, packing, shared_spans, splitting, tokens, topn
from wayfold.llm.minwise import MinwiseScheme

WS = "\t\n\r \u00a0\u3000"
rng = random.Random(11)
WORDS = ["湖心岛", "天文台", "夜市", "古镇", "teapot", "cabin", "预算", "路线", "渡口", "harbour ", "豆花", "风衣", "，", "。", "12", "345"]


def prose(n, r=rng):
    out = ""
    while len(out) < n:
        out += r.choice(WORDS) + chr(0x4E00 + r.randrange(3000))
    return out[:n]


def grams(t, k=5):
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0


def edited(t, share, r=rng):
    chars = list(t)
    for _ in range(int(len(t) * share)):
        chars[r.randrange(len(chars))] = chr(0x4E00 + r.randrange(3000))
    return "".join(chars)


# ---- problem 1


def pieces_of(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, h2 string, content string, piece string, start int, body string, `head` string")
    return splitting.split_items(df, "chunk_id", "content", "h2").orderBy("chunk_id", "piece_no").collect()


def test_split_pieces(spark):
    texts = {"a": ("标题", prose(5000)), "b": (None, "x" * 3000), "c": (" \n", None), "d": ("h", ""), "e": ("长" * 500, prose(50)), "f": ("t", "短"), "g": ("看", "https://img.example/" + "a" * 200 + " " + prose(400)), "h": (None, "👩‍👩‍👧" * 200), "i": (None, prose(320)), "j": (None, prose(321)), "k": ("头" * 200, prose(119)), "l": ("头" * 200, prose(120)), "m": ("头" * 319, ""), "n": ("头" * 320, None), "o": (None, "![" + "图" * 300 + "](https://img.example/a?b,c) " + prose(300))}
    rows = [(k, h, c, "clash", 1, "clash", "clash") for k, (h, c) in texts.items()]
    by = {}
    for r in pieces_of(spark, rows):
        by.setdefault(r.chunk_id, []).append(r)
    assert by.keys() == texts.keys()
    for k, (h, c) in texts.items():
        head, body = (h or "").strip(WS), (c or "").strip(WS)
        item = f"{head}\n{body}" if head else body
        lead = f"{head}\n" if head else ""
        if len(head) + 1 > 160 and len(item) > 320:
            lead, body = f"{head[:159]}\n", f"{head[159:]}\n{body}"
        got = by[k]
        assert [g.piece_no for g in got] == list(range(1, len(got) + 1)) and got[0].n_pieces == len(got)
        assert all(len(g.piece) <= 320 for g in got), k
        assert (len(got) > 1) == (len(item) > 320), k
        assert "".join(body[g.core_start : g.core_start + g.core_chars] for g in got) == body
        assert all(g.piece.startswith(lead) for g in got), k
        for p, g in zip(got, got[1:]):
            assert g.piece.startswith(lead) and p.piece[-40:] == g.piece[len(lead) :][:40]
    assert len(by["h"]) > 1 and all(not g.piece.startswith("‍") for g in by["h"][:1])


def test_split_prefers_strong_boundaries():
    text = prose(150).replace("。", "") + "\n\n" + prose(150).replace("。", "")
    assert splitting.bisect_cuts(text, 280, 40)[0] == text.index("\n\n") + 2
    url = "https://img.example/" + "b" * 60 + "?x=1,2;3"
    t = "字" * 120 + url + "字" * 130
    cut = splitting.bisect_cuts(t, 280, 40)[0]
    assert not 120 < cut < 120 + len(url)


def test_split_signs_that_never_close():
    """Many openings without an end take no more than linear time."""
    import time

    t = time.perf_counter()
    for text in ("[" * 100_000, "[a](" * 25_000, "![" + "x" * 100_000):
        splitting.boundary_strengths(text)
    assert time.perf_counter() - t < 5
    assert not splitting.boundary_strengths("![" + "图" * 300 + "](https://img.example/a?b,c)")[5:320].max() > 1


def test_split_empty_and_repeated(spark):
    df = spark.createDataFrame([], "chunk_id string, h2 string, content string")
    assert splitting.split_items(df, "chunk_id", "content", "h2").count() == 0
    two = spark.createDataFrame([("a", None, prose(400))] * 2, df.schema)
    assert splitting.split_items(two, "chunk_id", "content", "h2").where("piece_no = 2").count() == 2


# ---- problem 2


def candidates(n=60):
    r = random.Random(3)
    base = [prose(150, r) for _ in range(12)]
    out = []
    for i in range(1, n + 1):
        t = base[r.randrange(12)]
        t = edited(t, r.choice([0, 0.02, 0.05, 0.08, 0.12]), r)
        title, summary = (t[:30], t[30:]) if i % 5 else (None, t)
        u = r.choice([None, "", " 　", f"AB{r.randrange(40)} ", f"ab{r.randrange(40)}"])
        out.append((i, 1 + i // 20, title, summary if i % 11 else None, u, "clash", i, "clash"))
    return out


def accepted_by_force(rows, threshold=0.5, least=60):
    kept, out = [], {}
    for i, _, title, summary, u, *_ in sorted(rows):
        w = re.sub(f"[{WS}]", "", ((title or "") + (summary or "")).lower())
        u = (u or "").strip(WS).lower()
        hits = [k for k, v, a in kept if (u and a == u) or (len(w) >= least and len(v) >= least and jaccard(w, v) >= threshold)]
        out[i] = min(hits) if hits else None
        if not hits:
            kept.append((i, w, u))
    return out


CANDIDATE = "candidate_id long, batch_no int, title string, summary string, url_hash string, sig string, id long, t string"


def decisions(df):
    return {r.candidate_id: r.first_id for r in df.collect()}


@pytest.mark.parametrize("task_rows", [0, 1 << 14])
def test_a_repeated_id_with_two_wordings(spark, tmp_path, task_rows):
    """What one wording of an id matches isn't matched by another id of its other wording."""
    r = random.Random(2)
    x, y = prose(150, r), prose(150, r)
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store", task_rows=task_rows)
    row = lambda i, t: (i, 1, None, t, None, "", i, "")
    store.add_batch(spark.createDataFrame([row(1, x)], CANDIDATE), "1")
    assert decisions(store.add_batch(spark.createDataFrame([row(2, x), row(2, y), row(3, y), row(4, x), row(5, y)], CANDIDATE), "2")) == {2: 1, 3: None, 4: 1, 5: 3}


@pytest.mark.parametrize("options", [{}, {"part_bytes": 4000, "fan": 2}, {"task_rows": 0}], ids=["plain", "parts and merges", "rounds"])
def test_batches_equal_brute_force(spark, tmp_path, options):
    rows = candidates(60)
    df = spark.createDataFrame(rows, CANDIDATE)
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store", **options)
    assert decisions(incremental.dedup_in_batches(df, "batch_no", store)) == accepted_by_force(rows)
    if "fan" in options:
        assert max(t["level"] for t in store._tables()) > 0 and any(t["parts"] > 1 for t in store._tables())


@pytest.mark.parametrize("options", [{}, {"task_rows": 0, "part_bytes": 4000}, {"task_rows": 0, "task_nodes": 0}], ids=["task", "groups in a task", "rounds"])
def test_waiting_batches_are_taken_up_together(spark, tmp_path, monkeypatch, options):
    """30 batches: three takes, the last looked up in slices, with the decisions of batches taken one by one; what is taken up once isn't again."""
    monkeypatch.setattr(incremental, "LOOKUP_ROWS", 32)
    rows = [(i, 1 + i // 4, *x) for i, _, *x in candidates(120)]
    df = spark.createDataFrame(rows, CANDIDATE)
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store", **options)
    want = accepted_by_force(rows)
    assert decisions(incremental.dedup_in_batches(df.where("batch_no <= 20"), "batch_no", store)) == {i: f for i, f in want.items() if 1 + i // 4 <= 20}
    assert decisions(incremental.dedup_in_batches(df, "batch_no", store)) == want
    assert sum(c["batch"] is not None for c in store.commits) == 4
    few = df.where("batch_no in (3, 25)")
    assert decisions(incremental.dedup_in_batches(few, "batch_no", store)) == {i: f for i, f in want.items() if 1 + i // 4 in (3, 25)}


def test_batches_whose_ids_fall_are_not_taken_up_together(spark, tmp_path):
    rows = [(i, 9 - b, t, s, u, *x) for i, b, t, s, u, *x in candidates(60)]
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store")
    got = decisions(incremental.dedup_in_batches(spark.createDataFrame(rows, CANDIDATE), "batch_no", store))
    turned = {i: k for k, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    first = accepted_by_force([(turned[i], *x) for i, *x in rows])
    assert {i for i, f in got.items() if f is None} == {i for i in got if first[turned[i]] is None}
    assert sum(c["batch"] is not None for c in store.commits) == 4


@pytest.mark.parametrize("top", [10, 1 << 20, 1 << 40, 1 << 62])
def test_packed_keys(top):
    import numpy as np
    import pyarrow as pa

    r = random.Random(top)
    keys = np.array([r.randrange(97) << 32 | r.randrange(1 << 32) for _ in range(500)], np.int64)
    ids = np.array([r.randrange(-top, top) for _ in range(498)] + [-top - 1, top], np.int64)
    for parts in (1, 16):
        got = set()
        for b in incremental._rows(keys, ids, parts):
            for part, slot, *row in incremental._each(b, "part", "slot", "base", "keys", "ids"):
                low, i = incremental._unpacked(*row)
                whole = incremental._whole(slot, low)
                assert (whole % parts == part).all() and (np.diff(low.astype(np.int64)) >= 0).all()
                got |= set(zip(whole.tolist(), i.tolist()))
        assert got == set(zip(keys.tolist(), ids.tolist()))
    assert not list(incremental._rows(keys[:0], ids[:0], 4))


def test_one_batch_with_repeated_rows(spark, tmp_path):
    rows = candidates(40)
    df = spark.createDataFrame([(None, *rows[0][1:]), *rows, *rows[:5]], CANDIDATE)
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store")
    assert decisions(store.add_batch(df)) == accepted_by_force(rows)


def test_a_batch_that_is_broken_off_or_repeated_changes_nothing(spark, tmp_path, monkeypatch):
    rows = candidates(45)
    df = spark.createDataFrame(rows, CANDIDATE)
    part = lambda b: df.where(f"batch_no = {b}")
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store")
    store.add_batch(part(1), "1")

    def fail(*a, **k):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.files, "write", fail)
        with pytest.raises(OSError):
            store.add_batch(part(2), "2")
    again = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store")  # a new process reads the markers
    got = {}
    for b in (1, 2, 2, 3, 1):
        got |= decisions(again.add_batch(part(b), str(b)))
    assert got == accepted_by_force(rows) and len(again.commits) == 3


def test_a_small_batch_reads_few_parts(spark, tmp_path):
    """One candidate's lookup reads a share of the block tables that falls as the history grows."""
    r, shares = random.Random(8), []
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store", part_bytes=4000)
    row = lambda i: (i, 1, prose(20, r), prose(120, r), f"u{i}", "", i, "")
    for n, (lo, hi) in enumerate([(0, 60), (60, 1000)]):
        store.add_batch(spark.createDataFrame([row(i) for i in range(lo, hi)], CANDIDATE), f"history {n}")
        out = decisions(store.add_batch(spark.createDataFrame([(2000 + n, 1, None, None, f"U{lo} ", "", 0, "")], CANDIDATE), f"probe {n}"))
        assert out == {2000 + n: lo}
        shares.append(store.commits[-1]["bytes_read"] / store.commits[-1]["bytes_held"])
    assert shares[1] < shares[0] / 4


def test_no_candidates(spark, tmp_path):
    empty = spark.createDataFrame([], CANDIDATE)
    store = incremental.IncrementalDeduper(spark, f"file://{tmp_path}/store")
    assert store.add_batch(empty, "1").count() == 0
    assert incremental.dedup_in_batches(empty, "batch_no", store).count() == 0
    assert decisions(store.add_batch(spark.createDataFrame([(1, None, None, None, " ", "", 1, ""), (2, None, "短", None, None, "", 1, "")], CANDIDATE), "2")) == {1: None, 2: None}


@pytest.mark.parametrize("cell", [2, 3, 256])
def test_band_pairs_of_hot_bands(spark, cell):
    import itertools

    from wayfold.llm import minwise

    r = random.Random(cell)
    rows = [(i, b) for i in range(60) for b in {0, 1 + i % 2, r.randrange(100, 140), r.randrange(100, 140)} if b or i < 40]
    by = {}
    for i, b in rows:
        by.setdefault(b, []).append(i)
    want = {p for v in by.values() for p in itertools.combinations(sorted(v), 2)}
    got = [tuple(x) for x in minwise.band_pairs(spark.createDataFrame(rows, "mid long, band long"), "test", cell).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert minwise.band_pairs(spark.createDataFrame([], "mid long, band long"), "test", cell).count() == 0


def test_meet_over_small_batches():
    """Runs that go on over Arrow batches are the runs of one batch."""
    import itertools

    import pyarrow as pa

    from wayfold.llm import minwise

    r = random.Random(4)
    rows = sorted((r.randrange(25), i) for i in range(160))
    for step in (1, 2, 7, 160):
        for cell in (2, 5, 50):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + step])], ["band", "mid"]) for k in range(0, 160, step)]
            pairs, cells = set(), {}
            for out in minwise.meet(iter(batches), cell):
                for a, b, band, no, ids in zip(*(c.to_pylist() for c in out.columns)):
                    if a is not None:
                        pairs.add((a, b))
                    else:
                        assert len(ids) <= cell and no == len(cells.setdefault(band, []))
                        cells[band].append(ids)
            for v in cells.values():
                pairs |= set(itertools.combinations([i for ids in v for i in ids], 2))
            by = {}
            for band, i in rows:
                by.setdefault(band, []).append(i)
            assert pairs == {p for v in by.values() for p in itertools.combinations(v, 2)}, (step, cell)


def test_a_chain_of_decisions(spark):
    """a-b-c-d, each like its neighbours only: a and c are accepted."""
    nodes = spark.createDataFrame([(i, f"g{i}") for i in range(1, 7)], "id long, g string")
    links = [(f"g{i}", f"g{i + 1}") for i in range(1, 6)]
    got = incremental.resolve_first_accepted(nodes, spark.createDataFrame(links + [(b, a) for a, b in links], "g string, h string"))
    assert {r.id: r.first_id for r in got.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: 5}


# ---- problem 4


def test_caps(spark):
    names = ["Ａnna", "anna ", "AN NA", "ﾊﾞﾗ", "バラ", None, " 　", "bob"]
    rows = [(i, i % 2 if i % 13 else None, rng.choice(names), rng.choice([None, float("nan"), 1.0, 2.0, 3.5]), "clash", 1) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:1], "candidate_id long, batch_no int, author_name string, score double, who string, `rank` int")
    for share in (50, 10, 3):
        got = sorted(r.candidate_id for r in capping.cap_contributors(df, "candidate_id", capping.author_key(F.col("author_name")), "score", "batch_no", share=share).where("not kept").collect())
        want, by, size = [], {}, {}
        for i, b, a, s, *_ in rows + rows[:1]:
            size[b] = size.get(b, 0) + 1
            if (k := capping.fold_name(a)) is not None:
                by.setdefault((b, k), []).append((s is None or math.isnan(s), -(s or 0) if s is not None and not math.isnan(s) else 0, i))
        for (b, _), v in by.items():
            want += [x[2] for x in sorted(v)[-(-size[b] // share) :]]
        assert got == sorted(want)
    assert capping.fold_name("Ａnna") == capping.fold_name(" AN NA") and capping.fold_name("ﾊﾞﾗ") == capping.fold_name("バラ")


def test_sampled_caps_prefer_quality(spark):
    df = spark.range(4000).select(F.col("id").alias("candidate_id"), F.lit(1).alias("batch_no"), F.lit("x").alias("a"), (F.col("id") % 2 * 20).cast("double").alias("score"))
    out = capping.cap_contributors(df, "candidate_id", F.col("a"), "score", "batch_no", share=40, scale=10.0)
    kept = [r.candidate_id for r in out.where("kept").collect()]
    assert len(kept) == 100 and 0.75 < sum(i % 2 for i in kept) / 100 < 0.99
    assert capping.cap_contributors(df.limit(0), "candidate_id", F.col("a"), "score", "batch_no").count() == 0


# ---- problem 5


def test_near_duplicate_pairs(spark):
    r = random.Random(5)
    base = [prose(200, r) for _ in range(10)]
    texts = [edited(base[i % 10], (i // 10) * 0.012, r) for i in range(80)] + [base[0].upper()] * 3 + ["  " + base[1][:100] + " \n" + base[1][100:], None, "", "短", prose(39, r), prose(60_000, r)]
    rows = [(f"c{i:03}", t, i, "clash", [1]) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(None, base[0], 0, "clash", None), *rows], "chunk_id string, content string, mid int, id string, sig array<int>")
    norm = {i: re.sub(f"[{WS}]", "", (t or "").lower()) for i, t, *_ in rows}
    ids = [i for i in norm if len(norm[i]) >= 40]
    want = {(a, b) for a in ids for b in ids if a < b and jaccard(norm[a], norm[b]) >= 0.6}
    got = {tuple(x) for x in near_duplicates.near_duplicate_pairs(df, "chunk_id", "content").collect()}
    assert not got - want and len(want - got) <= 0.01 * len(want)
    s = {x.chunk_id: x for x in near_duplicates.near_duplicate_summary(df, "chunk_id", "content").collect()}
    assert s.keys() == set(ids) and s["c000"].copies == 4
    assert near_duplicates.near_duplicate_pairs(df.limit(0), "chunk_id", "content").count() == 0


def test_repeated_rows_are_no_pairs(spark):
    df = spark.createDataFrame([("a", prose(100))] * 3, "chunk_id string, content string")
    assert near_duplicates.near_duplicate_pairs(df, "chunk_id", "content").count() == 0


def test_estimates_follow_similarity():
    import numpy as np

    from wayfold.llm.minwise import signatures_of

    s = MinwiseScheme(0.6, 40, lanes=512, bits=8, bands=4)
    a = prose(400, random.Random(1))
    for share in (0.02, 0.05, 0.1):
        b = edited(a, share, random.Random(2))
        x, y = signatures_of([a, b], s).view(np.uint8)
        agree = (x == y).mean()
        assert abs((agree - 1 / 256) / (1 - 1 / 256) - jaccard(a, b)) < 0.09


# ---- problem 7


@pytest.mark.parametrize("n", [1, 3, 10])
def test_top_n(spark, n):
    r = random.Random(n)
    rows = [(r.choice(["u1", "u2", None]), r.choice(["P", " p", None]), f"a{r.randrange(40):02}" if r.random() > 0.02 else None, r.choice([None, float("nan"), 0.1, 0.2, 0.2, 0.9]), r.randrange(5) if r.random() > 0.1 else None, "clash", 1) for _ in range(1500)]
    df = spark.createDataFrame(rows, "user_id string, pool string, article_id string, score float, v int, g0 string, run int").repartition(7)
    got = topn.top_n_per_group(df, [F.col("user_id"), F.lower(F.trim("pool"))], ["user_id", "pool"], F.col("article_id"), "article_id", F.col("score"), F.col("v"), n)
    import numpy as np

    latest = {}
    for u, p, a, s, v, *_ in rows:
        s = None if s is None or math.isnan(s) else float(np.float32(s))
        k, rank = (u, p and p.strip().lower(), a), (v is not None, v or 0, s is not None, s or 0)
        if k not in latest or rank > latest[k][0]:
            latest[k] = (rank, s)
    pools = {}
    for (u, p, a), (_, s) in latest.items():
        pools.setdefault((u, p), []).append((s is None, -(s or 0), a is None, a or ""))
    want = {(u, p, i, None if x[2] else x[3]) for (u, p), v in pools.items() for i, x in enumerate(sorted(v)[:n], 1)}
    assert {tuple(x) for x in got.collect()} == want
    assert topn.top_n_per_group(df.limit(0), [F.col("user_id")], ["user_id"], F.col("article_id"), "article_id", F.col("score"), F.col("v"), n).count() == 0


def test_loser_tree():
    for k in range(8):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(topn.LoserTree(runs)) == sorted(sum(runs, []))
        assert topn.merge_top(runs, 5) == sorted(sum(runs, []))[:5]


# ---- problem 8


def test_token_ids(spark):
    texts = [None, "", " ", "hello world", prose(30_000), "a" * 5000, "👩‍👩‍👧 é́\x00", " \n\n  x's 1234", "　中 文"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(3, "hello world", [1])], "doc_id long, text string, ids array<int>")
    rows = tokens.encode_column(df, "doc_id", "text").collect()
    assert len(rows) == len(texts) + 1
    path = tokens.rank_file()
    for r in rows:
        assert tokens.decode(r.ids, path) == (texts[r.doc_id] or "")
        assert r.ids == (tokens.encoding(path).encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
    assert tokens.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_other_library_agrees(data):
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [x or "" for x in pq.read_table(f"{data}/documents.parquet", columns=["text"]).column(0).to_pylist()] + ["<|endoftext|>", "don't  stop"]
    path = tokens.rank_file()
    assert [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] == [tokens.encode(x, path) for x in texts]


def test_parts_change_nothing():
    path, enc = tokens.rank_file(), tokens.encoding(tokens.rank_file())
    for seed in range(30):
        r = random.Random(seed)
        t = "".join(r.choice(["中文", " ", "\n", "  ", "abc", "'s", "'", "12", "!?", "\t", " \n ", "é", "。", "　"]) for _ in range(400))
        for size in (1, 7, 50):
            parts = tokens.safe_parts(t, size)
            assert "".join(parts) == t and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t), (seed, size)
    assert tokens.encode("", path) == []


# ---- problem 9


def check_packing(rows, sizes, capacity):
    need, used = {}, {}
    for r in rows:
        need[r.id] = need.get(r.id, 0) + r.n_tokens
        if r.container is not None:
            used.setdefault(r.container, []).append(r)
        else:
            assert r.n_tokens == 0
    for v in used.values():
        at = 0
        for i, r in enumerate(sorted(v, key=lambda r: r.place), 1):
            assert (r.place, r.token_offset) == (i, at)
            at += r.n_tokens
        assert at <= capacity
    assert need == {i: s or 0 for i, s in sizes}
    for i, s in sizes:
        mine = [r for r in rows if r.id == i]
        assert len(mine) == max(1, -(-(s or 0) // capacity))
    return len(used)


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    r = random.Random(seed)
    sizes = [(i, r.choice([None, 0, 1, r.randrange(1, 60), r.randrange(1, 60), r.randrange(60, 600), 100, 250, 251])) for i in range(600)]
    df = spark.createDataFrame(sizes, "id long, n int").withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1))
    rows = packing.pack(df, "id", "n", 256).collect()
    boxes = check_packing(rows, sizes, 256)
    total = sum(s or 0 for _, s in sizes)
    assert boxes <= 1.03 * total / 256 + 3


def test_packing_edges(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert packing.pack(df, "id", "n", 64).count() == 0
    same = [(i, 1) for i in range(300)]
    assert check_packing(packing.pack(spark.createDataFrame(same, df.schema), "id", "n", 64).collect(), same, 64) == 5
    full = [(i, 64) for i in range(9)]
    assert check_packing(packing.pack(spark.createDataFrame(full, df.schema), "id", "n", 64).collect(), full, 64) == 9
    none = [(1, 0), (2, None)]
    assert check_packing(packing.pack(spark.createDataFrame(none, df.schema), "id", "n", 64).collect(), none, 64) == 0
    texts = spark.createDataFrame([(1, prose(4000)), (2, None), (2, "a"), (3, ""), (None, "b")], "doc_id long, text string")
    assert packing.pack_texts(texts, "doc_id", "text").where("doc_id = 1").count() >= 2


def test_plan_covers_every_rank():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(20):
        counts = np.zeros(129, np.int64)
        for s in r.integers(1, 129, 30):
            counts[s] = r.integers(1, 300)
        plan = packing.plan_containers(counts, 128)
        for s in range(1, 129):
            mine = sorted((f, n) for z, f, n, _, _ in plan if z == s)
            assert sum(n for _, n in mine) == counts[s] and all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:]))
        last = max(c + n for _, _, n, c, _ in plan)
        load = np.zeros(last, np.int64)
        for s, _, n, c, _ in plan:
            load[c : c + n] += s
        bins = []  # first fit from large to small
        for s in range(128, 0, -1):
            for _ in range(counts[s]):
                i = next((i for i, b in enumerate(bins) if b >= s), None)
                if i is None:
                    bins.append(128 - s)
                else:
                    bins[i] -= s
        assert load.max() <= 128 and last <= 1.01 * len(bins) + 8


# ---- problem 10


def spans_by_force(rows, span=100):
    own = {}
    for i, t in rows:
        for p in range(len(t or "") - span + 1):
            own.setdefault(t[p : p + span], set()).add(i)
    out = set()
    for i, t in rows:
        mark = [False] * (len(t or "") + 1)
        for p in range(len(t or "") - span + 1):
            if len(own[t[p : p + span]]) > 1:
                mark[p : p + span] = [True] * span
        p = 0
        while p < len(mark):
            if mark[p]:
                q = p
                while mark[q]:
                    q += 1
                out.add((i, p + 1, q - p))
                p = q
            p += 1
    return out


@pytest.mark.parametrize("seed", range(2))
def test_shared_spans(spark, seed):
    r = random.Random(seed)
    passages = [prose(n, r) for n in (99, 100, 101, 130, 250, 700)] + ["啊" * 150, "ab" * 80]
    rows = [(i, "".join(r.choice([prose(r.randrange(5, 200), r), r.choice(passages), r.choice(passages)[r.randrange(60) :]]) for _ in range(5))) for i in range(1, 60)]
    rows += [(100 + i, rows[0][1]) for i in range(12)] + [(200, None), (201, ""), (202, "短" * 99), (203, prose(1, r) + "啊" * 400), (204, passages[5] + prose(40_000, r) + passages[4])]
    df = spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], "doc_id long, text string, a string, lo int, tk int")
    assert {tuple(x) for x in shared_spans.shared_spans(df, "doc_id", "text").collect()} == spans_by_force(rows)


def test_shared_spans_edges(spark):
    schema = "doc_id long, text string"
    assert shared_spans.shared_spans(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    t = prose(300)
    one = spark.createDataFrame([(1, t + t), (1, t), (None, t)], schema)
    assert shared_spans.shared_spans(one, "doc_id", "text").count() == 0
    c = {x.doc_id: x for x in shared_spans.shared_coverage(spark.createDataFrame([(1, t), (2, t + "x"), (3, None)], schema), "doc_id", "text").collect()}
    assert c[1].shared_ratio == 1.0 and c[2].shared_chars == 300 and c[3].n_chars == 0


# ---- problem 10 by paragraphs


def test_components(spark):
    from wayfold.llm import paragraphs

    r = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7)] + [(500, 500 + i) for i in range(1, 30)] + [(r.randrange(1000, 1040), r.randrange(1000, 1040)) for _ in range(30)]
    links = [(a, b) for a, b in links if a != b]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    assert {r.node: r.component for r in paragraphs.components(spark.createDataFrame(links, "a long, b long")).collect()} == {x: root(x) for x in up}
    assert paragraphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_equal_paragraphs(spark):
    from wayfold.llm import paragraphs

    r = random.Random(9)
    base = [prose(200, r) for _ in range(4)]
    texts = {1: base[0] + "\n\n" + base[1], 2: edited(base[0], 0.01, r) + "\n短", 3: base[2] + "\n  " + base[0] + " ", 4: None, 5: "", 6: base[3], 7: base[1].upper() + "\r\n" + prose(3000, r)}
    df = spark.createDataFrame([*((i, t, "clash") for i, t in texts.items()), (None, base[3], ""), (6, base[3], "again")], "doc_id long, text string, pid string")
    got = {(x.doc_id, x.no): (x.copies, x.removed) for x in paragraphs.clustered_paragraphs(df, "doc_id", "text").collect()}
    assert got == {(1, 0): (3, False), (2, 0): (3, True), (3, 1): (3, True), (1, 2): (2, False), (7, 0): (2, True)}
    cover = {x.doc_id: (x.n_paragraphs, x.clustered, x.removed) for x in paragraphs.paragraph_coverage(df, "doc_id", "text").collect()}
    assert cover == {1: (2, 2, 0), 2: (2, 1, 1), 3: (2, 1, 1), 6: (1, 0, 0), 7: (2, 1, 1)}
    assert paragraphs.clustered_paragraphs(df.limit(0), "doc_id", "text").count() == 0


def test_spans_that_a_hash_alone_would_share_are_dropped(spark, monkeypatch):
    """With a hash that is the same for all stretches, the texts decide."""
    df = spark.createDataFrame([(1, 0, 2, 0, 0, 0, 100), (3, 0, 2, 0, 5, 5, 120)], "id long, tk int, wid long, wtk int, shift int, lo int, hi int")
    a, b = prose(150, random.Random(1)), prose(150, random.Random(2))
    texts = spark.createDataFrame([(1, 0, a), (2, 0, b), (3, 0, "x" * 5 + b)], "id long, tk int, t string")
    from pyspark.sql import types as T

    assert [tuple(r) for r in shared_spans._verified(df, texts, T.LongType()).collect()] == [(3, 0, 5, 120)]


def test_a_long_plan_is_joined(spark, monkeypatch):
    r = random.Random(12)
    df = spark.createDataFrame([(i, r.choice([0, 1, 7, 40, 40, 40, 63, 64, 200, None])) for i in range(3000)], "id long, n int")
    want = {tuple(x) for x in packing.pack(df, "id", "n", 64).collect()}
    monkeypatch.setattr(packing, "PLAN_ROWS", 0)
    monkeypatch.setattr(packing, "_RANK_BITS", 3)
    assert {tuple(x) for x in packing.pack(df, "id", "n", 64).collect()} == want


def test_group_changes():
    import pyarrow as pa

    a, b = pa.array([None, None, "x", "x", None, "y"]), pa.array([1, 1, 1, 2, 2, 2])
    assert topn.group_changes([a, b]).tolist() == [False, True, True, True, True] and topn.group_changes([a.slice(0, 1)]).tolist() == []
