"""Approximate nearest neighbours: a navigable small-world graph for each shard, results merged.

Equal vectors are one node: of each distinct vector the smallest ids that a query could ask for are kept,
so thousands of copies neither fill a graph nor hide one another. Distinct vectors are dealt to shards of
bounded size by hash. A shard's graph is hierarchical (HNSW): each node is on level 0 and, with falling
probability, on higher ones; a search descends greedily and ends with a best-first search of width `wide`
on level 0. Neighbour lists are flat integer arrays. Nodes enter in batches, each batch searching the graph
so far, and all searches of a batch run in step, so numpy works on many nodes at a time. The neighbours
kept are those that no closer kept one is nearer to.

Nearness is the largest inner product. A graph needs a metric, so a vector gets one more component that
makes all norms equal (the largest of the shard) and is then compared by angle; queries get 0 there. Scores
that are returned are computed anew, in double precision, from the original vectors.

Queries, in blocks of bounded size, meet every shard; each shard returns its nearest, which are merged by a
ranking that starts inside the tasks. Vectors that are null, all zero, or have null or non-finite
components take no part, nor do rows without an id. Vectors of different lengths are different spaces and
never meet. Repeated rows (same id and vector) count once. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import cut_lineage


@dataclass(frozen=True)
class Settings:
    nearest: int = 20
    shard: int = 4_096  # distinct vectors of a graph, about
    block: int = 2_048  # queries that a shard answers at a time, about
    links: int = 16  # of a node on an upper level; twice as many on level 0
    build_wide: int = 48
    wide: int = 128
    seed: int = 7


class Graph:
    """points: rows of unit length. links: for each level a flat array, -1 where a node has fewer."""

    def __init__(self, points: np.ndarray, settings: Settings):
        n = len(points)
        self.points, self.settings = points.astype(np.float32), settings
        rng = np.random.default_rng(settings.seed)
        level = np.minimum(-np.log(1 - rng.random(n)) / math.log(settings.links), 12).astype(int)
        level[:1] = level.max(initial=0)  # the first node is on every level and all searches begin there
        self.links = [
            np.full((n, settings.links * (2 if k == 0 else 1)), -1, np.int32) for k in range(level.max(initial=0) + 1)
        ]
        done, step = 1, 1
        while done < n:
            batch = np.arange(done, min(n, done + step))
            self._insert(batch, level)
            done, step = batch[-1] + 1, min(2 * step, 512)

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        entry = np.zeros((len(batch), 1), np.int32)
        for k in range(len(self.links) - 1, -1, -1):
            here = level[batch] >= k
            wide = self.settings.build_wide if here.any() else 1
            found, near = self._search(self.points[batch], entry, k, wide)
            entry = found[:, : max(1, min(wide, 8))]
            who = batch[here]
            if not len(who):
                continue
            # members of the batch are new to the graph: each also sees the others on this level
            among = self.points[who] @ self.points[who].T
            np.fill_diagonal(among, -np.inf)
            most = min(self.settings.links, len(who) - 1)
            if most > 0:
                other = np.argpartition(-among, most - 1, axis=1)[:, :most]
                found = np.concatenate([found[here], who[other].astype(np.int32)], axis=1)
                near = np.concatenate([near[here], np.take_along_axis(among, other, 1)], axis=1)
            else:
                found, near = found[here], near[here]
            kept = self._choose(found, near, self.links[k].shape[1] if k else self.settings.links)
            self.links[k][who, : kept.shape[1]] = kept
            self._link_back(k, who, kept)

    def _choose(self, found: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the node than to any chosen before."""
        order = np.argsort(-near, axis=1, kind="stable")
        found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        valid = found >= 0
        vectors = self.points[np.maximum(found, 0)]
        pairs = np.einsum("nid,njd->nij", vectors, vectors)
        chosen = np.zeros(found.shape, bool)
        closest = np.full(found.shape, -np.inf, np.float32)  # to a chosen one
        for j in range(found.shape[1]):
            take = valid[:, j] & (near[:, j] >= closest[:, j]) & (chosen.sum(1) < most)
            chosen[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, pairs[:, :, j]), closest)
        # free places go to the nearest of the rest
        rank = np.where(chosen, 0, 1) * found.shape[1] + np.arange(found.shape[1]) + np.where(valid, 0, 10**6)
        best = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(valid, best, 1), np.take_along_axis(found, best, 1), -1)

    def _link_back(self, k: int, who: np.ndarray, kept: np.ndarray) -> None:
        source, target = np.repeat(who, kept.shape[1]), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, number = np.unique(target, return_index=True, return_counts=True)
        width = self.links[k].shape[1]
        added = np.full((len(nodes), number.max(initial=0)), -1, np.int32)
        row = np.repeat(np.arange(len(nodes)), number)
        added[row, np.arange(len(target)) - np.repeat(first, number)] = source
        both = np.concatenate([self.links[k][nodes], added], axis=1)
        # a node listed twice counts once
        ranked = np.sort(both, axis=1)[:, ::-1]
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
        full = (ranked >= 0).sum(1)
        ranked = np.sort(ranked, axis=1)[:, ::-1]
        fits = full <= width
        span = min(width, ranked.shape[1])
        self.links[k][nodes[fits]] = -1
        self.links[k][nodes[fits], :span] = ranked[fits][:, :span]
        for at in range(0, len(nodes), 256):
            over = np.flatnonzero(~fits[at : at + 256]) + at
            if len(over):
                lists = ranked[over][:, : full[over].max()]
                near = np.einsum("nd,nkd->nk", self.points[nodes[over]], self.points[np.maximum(lists, 0)])
                near = np.where(lists >= 0, near, -np.inf)
                self.links[k][nodes[over]] = self._choose(lists, near, width)

    def _search(self, queries: np.ndarray, entry: np.ndarray, k: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes that each query meets on level k, nearest first, and their nearness; all in step."""
        links, n, q = self.links[k], len(self.points), len(queries)
        seen = np.zeros((q, n), bool)
        width = max(wide, entry.shape[1])
        best = np.full((q, width), -1, np.int32)
        near = np.full((q, width), -np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        valid = entry >= 0
        best[:, : entry.shape[1]] = entry
        near[:, : entry.shape[1]] = np.where(
            valid, np.einsum("qd,qkd->qk", queries, self.points[np.maximum(entry, 0)]), -np.inf
        )
        open_[:, : entry.shape[1]] = valid
        rows, columns = np.nonzero(valid)
        seen[rows, entry[rows, columns]] = True
        live = np.arange(q)
        while len(live):
            score = np.where(open_[live], near[live], -np.inf)
            at = score.argmax(1)
            going = score[np.arange(len(live)), at] > -np.inf
            live, at = live[going], at[going]
            if not len(live):
                break
            open_[live, at] = False
            next_ = links[best[live, at]]
            fresh = (next_ >= 0) & ~seen[live[:, None], np.maximum(next_, 0)]
            rows, columns = np.nonzero(fresh)
            seen[live[rows], next_[rows, columns]] = True
            value = np.full(next_.shape, -np.inf, np.float32)
            value[rows, columns] = np.einsum("kd,kd->k", queries[live[rows]], self.points[next_[rows, columns]])
            all_near = np.concatenate([near[live], value], axis=1)
            keep = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            near[live] = np.take_along_axis(all_near, keep, 1)
            best[live] = np.take_along_axis(np.concatenate([best[live], next_], axis=1), keep, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, 1)
        best[near == -np.inf] = -1
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)

    def nearest(self, queries: np.ndarray, wide: int) -> np.ndarray:
        entry = np.zeros((len(queries), 1), np.int32)
        for k in range(len(self.links) - 1, 0, -1):
            entry = self._search(queries, entry, k, 1)[0][:, :1]
        return self._search(queries.astype(np.float32), entry, 0, wide)[0]


def usable(vector: Column) -> Column:
    """Whether every component is a finite number and one isn't 0."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """vector and its `keep` smallest ids. The limit holds inside the tasks already."""
    order = Window.partitionBy("vector").orderBy("id")
    few = vectors.distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


GRAPH = "space int, shard int, ids array<array<bigint>>, vectors binary, levels int, links binary"
HITS = "query_id bigint, vec_id bigint, score double"


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors whose angles to a query order its inner products with the originals."""
    norms = (vectors**2).sum(1)
    top = norms.max() or 1.0
    return np.hstack([vectors, np.sqrt(np.maximum(top - norms, 0))[:, None]]) / np.sqrt(top)


def build(rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """One shard's graph as flat arrays."""
    rows = rows.sort_values("ids", key=lambda ids: ids.map(lambda x: x[0]))
    vectors = np.array(rows["vector"].tolist(), np.float64)
    graph = Graph(_lifted(vectors), settings)
    links = np.concatenate([x.ravel() for x in graph.links])
    return pd.DataFrame(
        {
            "space": rows["space"].iloc[:1],
            "shard": rows["shard"].iloc[:1],
            "ids": [[list(x) for x in rows["ids"]]],
            "vectors": [vectors.tobytes()],
            "levels": [len(graph.links)],
            "links": [links.astype(np.int32).tobytes()],
        }
    )


def _loaded(row: pd.Series, settings: Settings) -> tuple[Graph, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(row["ids"]), -1)
    graph = Graph.__new__(Graph)
    graph.points, graph.settings, graph.links, at = _lifted(vectors).astype(np.float32), settings, [], 0
    flat = np.frombuffer(row["links"], np.int32)
    for k in range(row["levels"]):
        width = settings.links * (2 if k == 0 else 1)
        graph.links.append(flat[at : at + len(vectors) * width].reshape(len(vectors), width))
        at += len(vectors) * width
    return graph, vectors


def answer(queries: pd.DataFrame, graphs: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """The nearest ids of one shard for a block of queries."""
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if not len(queries) or not len(graphs):
        return empty
    row = graphs.iloc[0]
    graph, vectors = _loaded(row, settings)
    asked = np.array(queries["vector"].tolist(), np.float64)
    flat = np.hstack([asked, np.zeros((len(asked), 1))]) / np.linalg.norm(asked, axis=1, keepdims=True)
    out = []
    for at in range(0, len(asked), 256):
        found = graph.nearest(flat[at : at + 256], settings.wide)
        for q, nodes in enumerate(found, at):
            nodes = nodes[nodes >= 0]
            # summed in order of components, as anybody would who checks the score
            scores = np.cumsum(vectors[nodes] * asked[q], axis=1)[:, -1]
            mine = queries["id"].iloc[q]
            hits = [(-s, v) for s, node in zip(scores.tolist(), nodes, strict=True) for v in row["ids"][node] if v != mine]
            out += [(mine, v, -s) for s, v in sorted(hits)[: settings.nearest]]
    return pd.DataFrame(out, columns=list(empty)) if out else empty


def index(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The graphs: one row for each shard. vectors: id, vector (array<double>)."""
    distinct = cut_lineage(_distinct(vectors, settings.nearest + 1).withColumn("space", F.size("vector")))
    shards = max(1, math.ceil(distinct.count() / settings.shard))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    return cut_lineage(
        dealt.repartition(shards, "space", "shard")
        .groupBy("space", "shard")
        .applyInPandas(lambda rows: build(rows, settings), GRAPH)
    )


def search(embeddings: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows, its own left out."""
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    graphs = index(rows.select("id", "vector"), settings)
    asked = cut_lineage(rows.where("asks").select("id", "vector").distinct().withColumn("space", F.size("vector")))
    blocks = max(1, math.ceil(asked.count() / settings.block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # every block meets every shard of its space: blocks and shards are of bounded size
    shards = graphs.select((F.col("space") + 0).alias("space"), (F.col("shard") + 0).alias("shard"))
    asked = asked.join(shards, "space")
    numbered = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["space", "shard", "block"]
    hits = (
        asked.groupBy(*keys)
        .cogroup(numbered.groupBy(*keys))
        .applyInPandas(lambda a, b: answer(a, b, settings), HITS)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= settings.nearest)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
