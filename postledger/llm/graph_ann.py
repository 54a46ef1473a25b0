"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt over shards of bounded size. In each shard a directed graph
grows in batches: a greedy beam search over the graph so far proposes
neighbours, relaxed distance pruning keeps an edge only if no kept edge leads
`alpha` times closer to its end (so edges stay diverse), and back edges are
pruned the same way. A query runs a beam search in every shard; the shards'
best are merged. The graphs are written to the shared folder once and read by
as many query blocks as there are.

The largest inner product becomes the smallest distance by one more component
sqrt(M^2 - |v|^2), 0 for queries. Equal vectors are indexed once with their k + 1
smallest ids: no further copy can be among a query's k best.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows with a null id; rows with
equal ids count once (the smallest vector); vectors of different lengths have
no product, so each length is searched on its own; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.common import cut
from postledger.llm.exact_topk import by_length, valid_vectors

SHARD = 8192
QUERY_BLOCK = 2048
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
#: Nodes that a search step expands, and queries that go together.
EXPAND, TOGETHER = 4, 512


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of each query's beam, nearest first; -1 and inf where the beam is not full."""
    m, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((m, len(x) + 1), bool)  # the last column stands for "no neighbour"
    seen[:, [entry, len(x)]] = True
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, ((q - x[entry]) ** 2).sum(1), False
    norms = (x * x).sum(1)
    while True:
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            return ids, dist
        r = rows[: len(live)]
        first = np.argsort(np.where(done[live], np.inf, dist[live]), 1, kind="stable")[:, :EXPAND]
        usable = ~done[live[:, None], first]
        done[live[:, None], first] = True
        nodes = np.where(usable, ids[live[:, None], first], -1)
        new = np.where(nodes[:, :, None] >= 0, graph[nodes], len(x)).reshape(len(live), -1)
        new = np.where(seen[live[:, None], new], len(x), new)
        new.sort(1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = len(x)
        seen[live[:, None], new] = True
        fresh = new < len(x)
        at = np.where(fresh, new, 0)
        ql = q[live]
        d = norms[at] - 2 * np.matmul(x[at], ql[:, :, None])[:, :, 0] + (ql * ql).sum(1)[:, None]
        d = np.where(fresh, np.maximum(d, 0), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_d, keep, 1), 1, kind="stable"), 1)
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, new, -1)], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), keep, 1)
        del r


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each p among its candidates (-1: none), at most `degree`, -1 filled."""
    c = np.where(cand == p[:, None], -1, cand)
    c.sort(1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    y = x[np.maximum(c, 0)]
    d = ((y - x[p][:, None, :]) ** 2).sum(2)
    d[c < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    y = np.take_along_axis(y, order[:, :, None], 1)
    out = np.full((len(p), degree), -1, np.int64)
    rows = np.arange(len(p))
    open_ = np.isfinite(d)
    for k in range(degree):
        any_ = open_.any(1)
        if not any_.any():
            break
        pick = open_.argmax(1)
        out[any_, k] = c[any_, pick[any_]]
        to = ((y - y[rows, pick][:, None, :]) ** 2).sum(2)
        open_ &= ~(alpha * alpha * to <= d)
        open_[rows, pick] = False
        open_ &= any_[:, None]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours by node, entry node)."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int64)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.r_[entry, order[order != entry]]
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        found, _ = beam_search(x, np.where(graph < 0, n, graph), entry, x[batch], beam)
        graph[batch] = robust_prune(x, batch, found, degree, alpha)
        end, start = graph[batch].ravel(), np.repeat(batch, degree)
        end, start = end[end >= 0], start[end >= 0]
        by = np.argsort(end, kind="stable")
        end, start = end[by], start[by]
        nodes, first, count = np.unique(end, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 256):
            part, f, c = nodes[lo : lo + 256], first[lo : lo + 256], count[lo : lo + 256]
            back = np.full((len(part), c.max()), -1, np.int64)
            inside = np.arange(c.max())[None, :] < c[:, None]
            back[inside] = start[f[0] : f[-1] + c[-1]]
            cand = np.concatenate([graph[part], back], 1)
            few = (cand >= 0).sum(1) <= degree
            if few.any():
                graph[part[few]] = -np.sort(-cand[few], 1)[:, :degree]
            if (~few).any():
                graph[part[~few]] = robust_prune(x, part[~few], cand[~few], degree, alpha)
        at += size
        size = min(2 * size, 512)
    return graph, entry


def _lifted(v: np.ndarray) -> np.ndarray:
    norm = (v * v).sum(1)
    return np.c_[v, np.sqrt(np.maximum(norm.max() - norm, 0))].astype(np.float32)


def _index(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("first_id", ignore_index=True)
    graph, entry = build_graph(_lifted(np.array(shard["v"].tolist())))
    return pd.DataFrame({"shard": shard["shard"], "node": range(len(shard)), "ids": shard["ids"], "v": shard["v"], "edges": list(graph), "entry": entry})


def _search(k: int, beam: int):
    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(index) and len(asked):
            index = index.sort_values("node", ignore_index=True)
            v = np.array(index["v"].tolist())
            x, n = _lifted(v), len(v)
            graph = np.array(index["edges"].tolist())
            graph[graph < 0] = n
            ids = index["ids"].tolist()
            for lo in range(0, len(asked), TOGETHER):
                part = asked.iloc[lo : lo + TOGETHER]
                q = np.array(part["v"].tolist())
                near, _ = beam_search(x, graph, int(index["entry"][0]), np.c_[q, np.zeros(len(q))].astype(np.float32), max(beam, k + 1))
                score = np.einsum("bkd,bd->bk", v[np.maximum(near, 0)], q)
                for own, nodes, s in zip(part["vec_id"].tolist(), near, score, strict=True):
                    pairs = [(-a, i) for node, a in zip(nodes.tolist(), s.tolist(), strict=True) if node >= 0 for i in ids[node] if i != own]
                    found.extend((own, i, -a) for a, i in sorted(pairs)[:k])
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM, shard_rows: int = SHARD
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row whose id is divisible by `every`."""
    rows = cut(valid_vectors(vectors, id_col, vec_col, zero=False))
    found = [_nearest_of_length(part, every, k, beam, shard_rows) for part, _ in by_length(rows)]
    return reduce(DataFrame.unionByName, found) if found else rows.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0D AS score")


def _nearest_of_length(rows: DataFrame, every: int, k: int, beam: int, shard_rows: int) -> DataFrame:
    # the k + 1 smallest ids of equal vectors, first within salted parts of a group
    ranked = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (["v", "salt"], ["v"]):
        ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = cut(ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("first_id", F.col("ids")[0]))
    shards = max(1, -(-distinct.count() // shard_rows))
    index = cut(
        distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInPandas(_index, "shard int, node int, ids array<long>, v array<double>, edges array<long>, entry int")
    )
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    found = (
        index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .groupBy("shard", "block")
        .cogroup(queries.groupBy("shard", "block"))
        .applyInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
