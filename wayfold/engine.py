"""The engine's entry points: ingest, search, recommendation, evaluation, run history and the tool registry (2.12, U1-U3)."""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wayfold.functions import strings as fx
from wayfold.functions.content import WINDOWS, history_id
from wayfold.operators import evaluation, fusion, graph, lexical, merge, search, vectors
from wayfold.sources import services, tables

def parse_window(text: str, default: str = "24h") -> int:
    return WINDOWS.get(text.strip().lower(), WINDOWS[default])


def format_window(seconds: int) -> str:
    return f"{seconds // 86_400}d" if seconds % 86_400 == 0 and seconds > 86_400 else f"{seconds // 3600}h"


@dataclass
class Engine:
    """Functions over a set of tables; nothing is computed before an action on a result."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    embedder: services.Embedder = field(default_factory=services.HashingEmbedder)

    def ingest(self, docs: DataFrame) -> dict[str, DataFrame]:
        """New versions of the tables after documents were added or replaced."""
        new = tables.ingest(docs, self.embedder)
        ids = new["articles"].select("article_id")
        out = dict(self.tables)
        for name, rows in new.items():
            old = self.tables.get(name)
            rows = rows if old is None else rows.select(*[c for c in old.columns if c in rows.columns])
            out[name] = rows if old is None else merge.cascade_delete([old], "article_id", ids)[0].unionByName(rows, allowMissingColumns=True)
        return out

    def delete(self, ids: DataFrame) -> dict[str, DataFrame]:
        """The tables without some articles and all that depends on them (K8)."""
        return {n: merge.cascade_delete([t], "article_id", ids)[0] if "article_id" in t.columns else t for n, t in self.tables.items()}

    def title_search(self, query: str, limit: int = 10) -> DataFrame:
        """Articles by title in order of match."""
        a = self.tables["articles"]
        rank = search.match_rank(F.col("title"), query)
        return a.withColumn("match_rank", rank).where("match_rank is not null").orderBy("match_rank", F.desc_nulls_last("score"), F.desc("created_at"), F.desc("article_id")).limit(search.clamp_limit(limit, 10, 50)).select("article_id", "title", "match_rank", "score")

    def author_search(self, query: str, limit: int = 10) -> DataFrame:
        """Authors (users: author_id, author_name) by name with the number of their articles and the latest (A9, J2, O5); authors without any are left out."""
        a = self.tables["articles"].select("author_id", "article_id", "title", "created_at")
        latest = search.latest_per_group(a, "author_id", ["created_at", "article_id"], ["created_at", "article_id", "title"])
        hit = self.tables["users"].withColumn("match_rank", search.match_rank(F.col("author_name"), query)).where("match_rank is not null")
        out = hit.join(latest, "author_id").orderBy("match_rank", F.desc("n"), F.desc("created_at"), "author_id").limit(search.clamp_limit(limit, 10, 50))
        return out.select("author_id", "author_name", "match_rank", F.col("n").alias("article_count"), F.col("article_id").alias("latest_article_id"), F.col("title").alias("latest_article_title"))

    def health(self) -> DataFrame:
        """(name, n_rows): the tables and their sizes, for scraping."""
        one = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, t in sorted(self.tables.items())]
        return functools.reduce(DataFrame.union, one)

    def keyword_search(self, query: str, limit: int = 10) -> DataFrame:
        return search.keyword_search(self.tables["articles"], self.tables["article_chunks"], query, limit)

    def content_search(self, queries: DataFrame, coarse: int = 80, articles: int = 20, per_query: int = 10, min_rerank: float = 0.0) -> DataFrame:
        """Coarse recall, keyword boost, fine recall inside the articles found, rerank and fusion, for a table of queries (query_id, query).

        One plan for many queries: (query_id, article_id, chunk_id, score, rank).
        Fine recall reads the chunks of recalled articles only.
        """
        w, width = Window.partitionBy("query_id"), self.embedder.width
        q = queries.select("query_id", "query", services.embed_column(F.col("query"), self.embedder).alias("vec"), fx.signals(F.col("query")).alias("sig"))
        found = vectors.top_k(q.select(F.col("query_id").alias("id"), "vec"), self.tables["recall_coarse"].select("id", F.col("vector").alias("vec")), coarse, width, exclude_self=False)
        found = found.withColumnRenamed("id", "article_id").join(self.tables["articles"].select("article_id", "tags"), "article_id").join(q, "query_id")
        boosted = F.col("score") + 0.1 * fx.keyword_signal_score(F.col("sig"), F.col("tags"))
        picked = found.withColumn("cr", F.row_number().over(w.orderBy(boosted.desc(), "article_id"))).where(F.col("cr") <= articles)
        fine = picked.select("query_id", "query", "vec", "article_id", "cr").join(self.tables["recall_fine"].select("article_id", "chunk_id", "vector", "document"), "article_id")
        hits = fine.withColumn("fine", vectors.cosine(F.col("vec"), F.col("vector"))).withColumn("rr", services.lexical_rerank(F.col("query"), F.col("document"))).where(F.col("rr") >= min_rerank)
        hits = hits.withColumn("fr", F.row_number().over(w.orderBy(F.desc("fine"), "chunk_id"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("support", F.count(F.lit(1)).over(Window.partitionBy("query_id", "article_id")))
        score = fusion.fuse(hits, fusion.rank_score(F.col("cr"), F.lit(articles)), fusion.rank_score(F.col("fr"), F.col("n")), F.col("rr"), F.col("support"))
        best = hits.withColumn("score", F.round(score, 6)).groupBy("query_id", "article_id").agg(F.max_by("chunk_id", F.struct("score", "chunk_id")).alias("chunk_id"), F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "article_id"))).where(F.col("rank") <= per_query)

    def recommend(self, users: DataFrame, n: int = 10, dislike_below: float = 1.0) -> DataFrame:
        """The n best pool items of each user (user_id), without disliked articles; users without any get the fallback list.

        (user_id, article_id, score, rank, source): one plan for all users.
        """
        h = self.tables["user_rec_history"].where(F.col("preference") < dislike_below).select("user_id", "article_id").distinct()
        pool = self.tables["user_pool_items"].join(users.select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id", "article_id").agg(F.max("remark_score").cast("double").alias("score"))
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "article_id"))
        own = pool.join(h, ["user_id", "article_id"], "left_anti").withColumn("rank", rank).where(F.col("rank") <= n).withColumn("source", F.lit("pool"))
        top = self.tables["articles"].orderBy(F.desc_nulls_last("score"), F.desc("created_at"), F.desc("article_id")).limit(n)
        ranked = top.agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "created_at", "article_id")), asc=False).alias("l"))
        fallback = ranked.select(F.posexplode("l").alias("p", "x")).select("x.article_id", "x.score", (F.col("p") + 1).alias("rank"))  # n rows
        cold = users.select("user_id").distinct().join(own.select("user_id").distinct(), "user_id", "left_anti").crossJoin(fallback).withColumn("source", F.lit("fallback"))
        return own.select("user_id", "article_id", "score", "rank", "source").unionByName(cold)

    def record_events(self, events: DataFrame) -> DataFrame:
        """The accepted ones of new events (K5)."""
        return evaluation.clean_events(events)

    def evaluation_summary(self, surface: str, window: str, as_of: str) -> DataFrame:
        """Nine metrics of a surface over the window before ``as_of``."""
        on = F.col("surface") == (surface.strip() or "dashboard_recommend")
        seconds = parse_window(window)
        events = evaluation.since(self.tables["reco_event_logs"].where(on), as_of, seconds).withColumnRenamed("id", "event_id")
        requests = evaluation.since(self.tables["reco_request_logs"].where(on), as_of, seconds, "created_at")
        return evaluation.summary(events, requests, self.tables["articles"])

    def pools_to_refill(self, least: int = 10) -> DataFrame:
        """Pools with fewer items than wanted."""
        return self.tables["user_pool_items"].groupBy("user_id", "pool_type", "period_bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)

    def runs(self, cursor: str | tuple | None = None, limit: int = 20) -> DataFrame:
        """A page of runs (run_id, updated_at), newest first; the cursor is the last row's (updated_at, run_id)."""
        return search.keyset_page(self.tables["runs"], "updated_at", "run_id", cursor, limit)

    def run_messages(self, run_id: str) -> DataFrame:
        """A run's steps (run_id, seq, text, delta), deltas joined."""
        return merge.coalesce_runs(self.tables["steps"].where(F.col("run_id") == run_id), "run_id", "seq", F.col("text"), F.col("delta"))

    def run_snapshot(self, run_id: str) -> DataFrame:
        """The last state of each item of a run's events (run_id, kind, item, seq, payload)."""
        return merge.snapshot_fold(self.tables["run_events"].where(F.col("run_id") == run_id), "run_id", "kind", "item", "seq", ["payload"])


class Tools:
    """Named functions over JSON parameters that return DataFrames."""

    def __init__(self):
        self._tools: dict[str, tuple[Callable[..., DataFrame], str, dict[str, str]]] = {}
        self.calls: list[tuple[str, str, float]] = []

    def register(self, name: str, run: Callable[..., DataFrame], description: str, parameters: dict[str, str]) -> None:
        if name in self._tools:
            raise ValueError(f"{name} is registered already")
        self._tools[name] = (run, description, parameters)

    def names(self) -> list[str]:
        return sorted(self._tools)

    def schema(self) -> list[dict]:
        """Name, description and JSON schema of every tool, by name."""
        return [{"name": n, "description": self._tools[n][1], "parameters": {"type": "object", "properties": {k: {"type": t} for k, t in self._tools[n][2].items()}, "required": list(self._tools[n][2])}} for n in self.names()]

    def invoke(self, name: str, arguments: str = "{}") -> DataFrame:
        """Runs a tool and notes its name, status and seconds of planning; unknown names and parameters fail."""
        t, status = time.perf_counter(), "error"
        try:
            run, _, parameters = self._tools[name]
            args = json.loads(arguments or "{}")
            if unknown := args.keys() - parameters.keys():
                raise KeyError(f"{name} has no {', '.join(sorted(unknown))}")
            out = run(**args)
            status = "ok"
            return out
        finally:
            self.calls.append((name, status, time.perf_counter() - t))


def default_tools(e: Engine) -> Tools:
    """The reference's data tools over an engine."""
    t, tab = Tools(), e.tables
    pool = lambda user_id, pool_type, period_bucket: tab["user_pool_items"].where((F.col("user_id") == user_id) & (F.col("pool_type") == pool_type) & (F.coalesce("period_bucket", F.lit("")) == period_bucket))
    key = {"user_id": "string", "pool_type": "string", "period_bucket": "string"}
    one_query = lambda query: e.spark.createDataFrame([(0, query)], "query_id bigint, query string")
    t.register("vector_search", lambda query, top_k: e.content_search(one_query(query), per_query=top_k), "articles for a text", {"query": "string", "top_k": "integer"})
    t.register("pool_get_size", lambda **k: pool(**k).agg(F.count(F.lit(1)).alias("n")), "items in a pool", key)
    t.register("pool_pop_topk", lambda k, **p: pool(**p).orderBy(F.desc_nulls_last("remark_score"), "inserted_at", "article_id").limit(k), "the best items of a pool", key | {"k": "integer"})
    t.register("user_history_recent", lambda user_id, n: tab["user_rec_history"].where(F.col("user_id") == user_id).orderBy(F.desc("ts"), "article_id").limit(n), "a user's newest history", {"user_id": "string", "n": "integer"})
    memory = lambda user_id, memory_type, period_bucket: tab["user_memory"].where((F.col("user_id") == user_id) & (F.col("memory_type") == memory_type) & (F.coalesce("period_bucket", F.lit("")) == period_bucket))
    mkey = {"user_id": "string", "memory_type": "string", "period_bucket": "string"}

    def upserted(user_id, memory_type, period_bucket, content, updated_at):
        new = e.spark.createDataFrame([(user_id, memory_type, period_bucket, content, updated_at)], "user_id string, memory_type string, period_bucket string, content string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp"))
        return merge.upsert(tab["user_memory"], new, ["user_id", "memory_type", "period_bucket"], "updated_at")

    def added(user_id, article_id, clicked, preference, ts):
        new = e.spark.createDataFrame([(user_id, article_id, clicked, float(preference), ts)], "user_id string, article_id string, clicked boolean, preference double, ts string").withColumns({"ts": F.col("ts").cast("timestamp"), "preference": F.col("preference").cast("float")})
        return tab["user_rec_history"].unionByName(new.withColumn("history_id", history_id(F.col("user_id"), F.col("ts"), F.col("article_id"))))

    def similar(user_id, query, n):
        h = tab["user_rec_history"].where(F.col("user_id") == user_id).join(tab["articles"].select("article_id", "title"), "article_id")
        return h.withColumn("score", vectors.cosine(services.embed_column(F.col("title"), e.embedder), services.embed_column(F.lit(query), e.embedder))).orderBy(F.desc("score"), F.desc("ts"), "article_id").limit(search.clamp_limit(n, 10, 50))

    def hybrid_memory(user_id, memory_type, period_bucket, query, top_k):
        rows = vectors.latest_version(tab["user_memory_chunks"].where((F.col("user_id") == user_id) & (F.col("memory_type") == memory_type) & (F.coalesce("period_bucket", F.lit("")) == period_bucket)), ["user_id", "memory_type"], "updated_at")
        rows = rows.select(F.col("chunk_index").cast("bigint").alias("id"), F.col("content").alias("text"))
        q = e.spark.createDataFrame([(-1, query)], "query_id bigint, text string")
        dense = vectors.top_k(q.select(F.col("query_id").alias("id"), services.embed_column(F.col("text"), e.embedder).alias("vec")), rows.select("id", services.embed_column(F.col("text"), e.embedder).alias("vec")), top_k, e.embedder.width)
        return vectors.hybrid(dense.select("query_id", "id", "score"), lexical.bm25(rows, q, top_k).select("query_id", "id", "score"), top_k).join(rows, "id").select("id", "score", "rank", F.col("text").alias("content"))

    t.register("user_memory_get", lambda **k: memory(**k), "a user's memory", mkey)
    t.register("user_memory_upsert", upserted, "the memories with one added or replaced", mkey | {"content": "string", "updated_at": "string"})
    t.register("user_memory_hybrid_search", hybrid_memory, "chunks of the newest memory by meaning and terms", mkey | {"query": "string", "top_k": "integer"})
    t.register("user_history_add", added, "the history with one row more", {"user_id": "string", "article_id": "string", "clicked": "boolean", "preference": "number", "ts": "string"})
    t.register("user_history_similar", similar, "a user's history by likeness to a text", {"user_id": "string", "query": "string", "n": "integer"})
    t.register("doc_ingest", lambda article_id, title, markdown: e.ingest(e.spark.createDataFrame([(article_id, title, markdown)], "article_id string, title string, markdown string").withColumns({"tags": F.lit(""), "created_at": F.current_timestamp()}))["articles"], "the articles with a document added or replaced", {"article_id": "string", "title": "string", "markdown": "string"})
    t.register("keyword_search", lambda query, limit: e.keyword_search(query, limit), "articles that contain a text", {"query": "string", "limit": "integer"})
    t.register("title_search", lambda query, limit: e.title_search(query, limit), "articles by title", {"query": "string", "limit": "integer"})
    t.register("pools_to_refill", lambda least: e.pools_to_refill(least), "pools below a size", {"least": "integer"})
    t.register("text_rerank", lambda query, limit: tab["article_chunks"].withColumn("score", services.lexical_rerank(F.lit(query), F.col("content"))).orderBy(F.desc("score"), "chunk_id").limit(search.clamp_limit(limit, 10, 100)), "chunks by lexical score", {"query": "string", "limit": "integer"})
    return t


def graph_tools(nodes: DataFrame, edges: DataFrame) -> Tools:
    """Tools over a graph (U4): reads return rows, writes the changed table.

    nodes: id, label, name, status, seq, value, props (map); edges: src, dst,
    rel, props (map).  Children are those over relations HAS_*.
    """
    t, spark = Tools(), nodes.sparkSession
    text = lambda *names: dict.fromkeys(names, "string")
    has = edges.where(F.col("rel").startswith("HAS_"))
    below = lambda parent: has.where(F.col("src") == parent).select(F.col("dst").alias("id")).join(nodes, "id")
    reviews = edges.where("rel = 'REVIEWED_BY'").join(nodes.select(F.col("id").alias("dst"), (F.col("status") == "passed").alias("passed")), "dst").select(F.col("src").alias("id"), "passed")
    one = lambda schema, *row: spark.createDataFrame([row], schema)
    node_of = lambda id, label, name, status: one("id string, label string, name string, status string", id, label, name, status).withColumns({"seq": F.lit(None).cast("int"), "value": F.lit(None).cast("double"), "props": F.create_map().cast("map<string,string>")})
    as_map = lambda props: F.from_json(F.lit(props), "map<string,string>")

    def created(label, rel, outgoing):
        def run(id, target, name, status):
            n, e = graph.create(nodes, edges, node_of(id, label, name, status).withColumn("target", F.lit(target)).select(*nodes.columns, "target"), "target", rel, outgoing)
            return e.where((F.col("src") == id) | (F.col("dst") == id)).select("src", "dst", "rel")

        return run

    def merged(src, dst, rel, props):
        new = one("src string, dst string, rel string", src, dst, rel).withColumns({"props": as_map(props), "at": F.lit(1)})
        return graph.merge_edges(edges.select("src", "dst", "rel", "props").where(F.col("rel") == rel), new, nodes, "at")

    def children_added(parent, count):
        numbers = F.explode(F.sequence(F.lit(1), F.lit(int(count))))
        return nodes.where(F.col("id") == parent).select(F.col("id").alias("parent"), numbers.alias("seq")).select(F.concat_ws("-", "parent", "seq").alias("id"), "seq", F.lit("outlined").alias("status"))

    def around(node):
        return graph.subgraph(nodes.where(F.col("id") == node).select("id", "name", "status"), {"children": has.select(F.col("src").alias("id"), F.col("dst").alias("child")), "routes": edges.where("rel = 'ROUTES_TO'").select(F.col("src").alias("id"), "dst"), "reviews": reviews})

    t.register("get_node", lambda id: nodes.where(F.col("id") == id), "a node", text("id"))
    t.register("find_nodes", lambda label, key, value: graph.scan(nodes, label, **{key: value}), "nodes by label and property", text("label", "key", "value"))
    t.register("children", lambda parent: below(parent).orderBy("seq", "id"), "a node's children in order", text("parent"))
    t.register("children_summary", lambda parent: graph.children_summary(has.where(F.col("src") == parent), nodes.select("id", "status")), "a node's children counted", text("parent"))
    t.register("unplanned_children", lambda parent: below(parent).where(~F.col("status").isin("done", "reviewed")), "children still to plan", text("parent"))
    t.register("subgraph", around, "a node with its children, routes and reviews", text("node"))
    t.register("descendants", lambda root, depth: graph.descendants(has, one("id string", root), int(depth)), "nodes below a node", text("root") | {"depth": "integer"})
    t.register("budget_summary", lambda node: graph.roll_up(has, nodes.where("value is not null").select("id", "value")).where(F.col("id") == node), "the sum of values below a node", text("node"))
    t.register("constraint_violations", lambda root: reviews.where("not passed").join(graph.descendants(has, one("id string", root)).select("id").union(one("id string", root)).distinct(), "id", "left_semi"), "failed reviews at and below a node", text("root"))
    t.register("layer_review", lambda parent: graph.gate(has.where(F.col("src") == parent).select("src", "dst"), reviews), "whether all children have a passing review", text("parent"))
    t.register("create_insight", created("insight", "INSIGHT_BELONGS_TO", True), "an insight of a trip", text("id", "target", "name", "status"))
    t.register("create_review", created("review", "REVIEWED_BY", False), "a review of a node", text("id", "target", "name", "status"))
    t.register("merge_route", lambda src, dst, props: merged(src, dst, "ROUTES_TO", props), "routes with one added or changed", text("src", "dst", "props"))
    t.register("link", lambda src, dst, rel: merged(src, dst, rel, "{}"), "edges of a relation with one more", text("src", "dst", "rel"))
    t.register("patch_node", lambda id, props: merge.patch(nodes, one("id string", id).withColumn("props", as_map(props)), "id"), "nodes with some properties set", text("id", "props"))
    t.register("soft_delete", lambda id, at, reason: graph.soft_delete(nodes, one("id string", id), at, reason), "nodes with one rejected and dimmed", text("id", "at", "reason"))
    t.register("add_children", children_added, "numbered children of a node", text("parent") | {"count": "integer"})
    t.register("sequence_children", lambda parent: merge.next_edges(below(parent).withColumn("parent", F.lit(parent)), "parent", "id", ["seq", "id"]), "NEXT edges along a node's children", text("parent"))
    return t
