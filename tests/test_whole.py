"""Queries over all rows: their SQL has no subset of keys, or brute force."""

import datetime
import math
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wayfold.operators import features, fusion, graph, lexical, vectors
from test_catalog import duck, plain  # noqa: F401

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def same(spark, duck, data, name, sql):
    """The query's rows are the SQL's; returns them."""
    df = QUERIES[name](spark, data)
    got = duck.execute(sql)
    cols = [c[0] for c in got.description]
    rows = df.collect()
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(map(plain, r)) for r in got.fetchall()), key=repr)
    return rows


def test_date_split_of_every_customer(spark, duck, data):
    rows = same(spark, duck, data, "date_split", SQL["date_split"])
    days = dict((k, (lo, hi)) for k, lo, hi in duck.execute("SELECT o_custkey, min(o_orderdate)::DATE, max(o_orderdate)::DATE FROM orders GROUP BY 1").fetchall())
    assert {r.k for r in rows} == days.keys() and any(k % 25 for k in days)
    for unit in ("month", "week"):
        parts = {}
        for r in rows:
            if r.unit == unit:
                parts.setdefault(r.k, []).append((r.no, r.lo, r.hi))
        for k, (lo, hi) in days.items():
            p = sorted(parts[k])
            assert [x[0] for x in p] == list(range(1, len(p) + 1)) and (p[0][1], p[-1][2]) == (lo, hi)
            assert all(b[1] - a[2] == datetime.timedelta(1) for a, b in zip(p, p[1:]))


def test_similar_edges_of_every_vector(spark, duck, data):
    rows = same(spark, duck, data, "similar_edges", SQL["similar_edges"])
    assert any(r.query_id % 50 for r in rows)


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_similar_pairs_by_brute_force(spark, block):
    rng = np.random.default_rng(1)
    x = {i: [float(v) for v in rng.integers(-2, 3, 4)] for i in range(90)} | {90: None, 91: [], 92: [0.0] * 4, 93: [1.0]}
    df = spark.createDataFrame(list(x.items()), "id long, vec array<float>")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in x.items() if v and len(v) == 4 and any(v)}
    want = set()
    for a in unit:
        near = sorted((-round(float(unit[a] @ unit[b]), 9), b) for b in unit if b != a)
        want |= {(a, b, -s, i + 1) for i, (s, b) in enumerate(near[:5]) if -s >= 0.5}
    assert {(r.query_id, r.id, r.score, r.rank) for r in vectors.similar_pairs(df, 5, 4, 0.5, block).collect()} == want


def test_coarse_fine_recall(spark, duck, data):
    rows = same(spark, duck, data, "coarse_fine_recall", SQL["coarse_fine_recall"])
    assert rows and all(r.content.strip() for r in rows)


def test_fine_recall_stays_in_the_coarse_groups(spark):
    angle = {0: (0, 0), 1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (40, 1), 5: (50, 2), 6: (60, 1)}  # id: degrees, group
    s = spark.createDataFrame([(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))], g) for i, (a, g) in angle.items()], "id long, vec array<float>, g long")
    got = vectors.coarse_fine(s.where("id = 0"), s, "g", 2, 4, 2).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 4, 3), (0, 5, 4)]  # 3 is near, but of no recalled group


def test_cosine_of_every_pair(spark, duck, data):
    rows = same(spark, duck, data, "cosine", SQL["cosine"])
    assert any(r.a % 50 for r in rows)


def test_cosine_edges_at_any_id(spark, tmp_path):
    x = {1: [1.0, 0.0], 2: None, 3: [1.0, 1.0], 4: [0.0, 0.0], 5: [2.0, 0.0], 6: [1.0], 7: [2.0], 9: [1.0]}
    spark.createDataFrame([(i, v, 0) for i, v in x.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.cosine for r in QUERIES["cosine"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2): 0.0, (2, 3): 0.0, (3, 4): 0.0, (4, 5): 0.0, (5, 6): 0.0, (6, 7): 1.0}


def test_hybrid_search_of_every_query(spark, duck, data):
    rows = same(spark, duck, data, "hybrid_search", SQL["hybrid_search"])
    assert len({r.query_id for r in rows}) == 10


def test_hybrid_keeps_weak_and_lone_hits(spark):
    rows = "query_id long, id long, score double"
    dense = spark.createDataFrame([(0, 1, 1.0), (0, 2, 0.1), (0, 3, -1.0)], rows)
    sparse = spark.createDataFrame([(0, 2, 4.0), (0, 9, 1e-9)], rows)
    got = [(r.id, r.score) for r in vectors.hybrid(dense, sparse, 9).orderBy("rank").collect()]
    assert got == [(2, round(0.275 + np.arctan(4) / np.pi, 6)), (1, 0.5), (3, 0.0), (9, 0.0)]


def test_bm25_by_brute_force(spark, monkeypatch):
    texts = {1: "湖心岛 看湖", 2: "湖心岛,湖心岛!湖心岛", 3: None, 4: "  ", 5: "Lake view 7", 6: "x", 7: "夜市与湖心", 8: "湖心岛 看湖"}
    asked = {1: "湖心岛 湖心岛", 3: "LAKE", 4: None, 9: "x 夜市"}

    def terms(t):
        runs = [r for r in re.split(r"[^0-9a-z\u4e00-\u9fff]+", (t or "").lower()) if r]
        return [r if len(r) == 1 else r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]

    bags = {i: terms(t) for i, t in texts.items() if terms(t)}
    mean, want = sum(map(len, bags.values())) / len(bags), []
    for q, t in asked.items():
        hits = []
        for i, b in bags.items():
            s = 0
            for x in set(terms(t)):
                tf, df = b.count(x), sum(x in o for o in bags.values())
                s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / mean))
            if s and i != q:
                hits.append((-round(s, 9), i))
        want += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(hits)[:3], 1)]
    frames = spark.createDataFrame(list(texts.items()), "id long, text string"), spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for most, block in ((1 << 18, 1 << 20), (1, 4)):  # also with more terms than are sent, and in small blocks
        monkeypatch.setattr(lexical, "MOST_TERMS", most)
        monkeypatch.setattr(lexical, "_BLOCK", block)
        assert {tuple(r) for r in lexical.bm25(*frames, 3).collect()} == set(want)
    assert lexical.bm25(spark.createDataFrame([], "id long, text string"), spark.createDataFrame([(1, "x")], "query_id long, text string"), 3).count() == 0


def test_matrix_of_odd_vectors():
    x = pa.array([[3.0, 4.0], None, [1.0], [None, 1.0], [0.0, 0.0], [0.0, 2.0]], pa.list_(pa.float32()))
    assert vectors._matrix(x, 2).tolist() == [[0.6, 0.8], [0, 0], [0, 0], [0, 0], [0, 0], [0, 1]]
    assert vectors._matrix(x.slice(5), 2).tolist() == [[0, 1]] and vectors._matrix(x.slice(0, 0), 2).shape == (0, 2)


def test_index_reads_a_falling_share(spark):
    """Lists grow with the square root of the rows; a hot list is searched in blocks; all probes are exact."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(400, 8)), rng.normal(size=(200, 8)) * 0.01 + 1])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    index, q = vectors.InvertedFile.fit(df, 8), df.where("id % 50 = 0")
    assert len(index.centres) == round(600**0.5)
    exact = {tuple(r) for r in vectors.top_k(q, df, 5, 8).collect()}
    assert {tuple(r) for r in index.search(q, df, 5, len(index.centres)).collect()} == exact
    few = {(r.query_id, r.id) for r in index.search(q, df, 5, 8).collect()}
    assert len(few & {(a, b) for a, b, *_ in exact}) / len(exact) > 0.8


def test_round_robin_takes_clusters_by_their_first_rows(spark):
    df = spark.createDataFrame([("a", 9, 1), ("a", 2, 2), ("b", 8, 3), ("b", 7, 4), (None, 5, 5), (None, 6, 6)], "g string, s int, id int")
    got = [(r.g, r.s, r.turn) for r in fusion.round_robin(df, "g", [F.desc("s"), F.col("id").asc()], 5).orderBy("turn", F.desc("s")).collect()]
    assert got == [("a", 9, 1), ("b", 8, 1), (None, 6, 1), ("b", 7, 2), ("a", 2, 2)]


def test_roll_up_stops_with_the_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    got = {r.id: (r.n, r.total) for r in graph.roll_up(edges, spark.createDataFrame([("d", 2.0), ("b", 1.0)], "id string, value double")).collect()}
    assert got == {"a": (3, 5.0), "b": (1, 2.0), "c": (1, 2.0)}
    assert graph.roll_up(edges, spark.createDataFrame([], "id string, value double")).count() == 0


def test_few_scans(spark, data):
    """The summary and the roll-up read their tables a bounded number of times; a window's bound reaches the scan; a block of features reads its own folder."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(QUERIES["reco_summary"](spark, data)).count("FileScan") <= 6  # two of them of the written cells
    assert plan(QUERIES["budget_rollup"](spark, data)).count("FileScan") <= 4  # one of each written level
    assert "GreaterThanOrEqual(ts" in plan(QUERIES["windowed_metrics"](spark, data))
    p6 = plan(QUERIES["p6_found"](spark, data))
    assert p6.count("FileScan") <= 8 and p6.count("PartitionFilters: [isnotnull(block") == 7 and p6.count("Exchange hashpartitioning") <= 2


def test_more_types_than_listed_are_refused(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_TYPES", 3)
    h = spark.createDataFrame([("u", "a", "2025-01-01", True, 0.4)], "user_id string, article_id string, ts string, clicked boolean, preference double").withColumn("ts", F.col("ts").cast("timestamp"))
    t = lambda n: spark.createDataFrame([(f"t{i}", True, i) for i in range(n)], "event_type string, clicked boolean, pref_tenths int")
    for f in (features.feature_table, features.feature_rows):
        assert f(h, t(3)).count() <= 1
        with pytest.raises(ValueError, match="event types"):
            f(h, t(5))


def test_decisions_match_the_whole_pool(spark, duck, data):
    rows = same(spark, duck, data, "decision_match", SQL["decision_match"])
    assert any(r.candidate_id % 3 == 0 for r in rows)
