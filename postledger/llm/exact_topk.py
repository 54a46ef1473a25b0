"""Exact top-k by integer inner product over a pivot-distance index.

Components become floor(1024 * x). Every vector is keyed by its nearest pivot
and its distance from it; a cell of the index is a run of vectors of one
pivot in order of that distance. With |v|^2 <= M in a cell, an inner product
is (|q|^2 + |v|^2 - |q - v|^2) / 2, and the triangle inequality bounds
|q - v| from below by |d(q, pivot) - d(v, pivot)|: outside an annulus around
d(q, pivot) no vector can reach the k-th best score known so far. A query
starts in the cells whose annuli promise most and stops in a cell where the
bound falls below its k-th best. Pivots are a bounded sample (they decide
speed only); every vector is indexed. Doubles only choose candidates: what may
be among the k best within the error of their sums is summed again in 64-bit
integers, whose overflows cancel out wherever the sum itself fits, and ranked
by that. So scores are exact up to 63 bits; a product beyond them is cut to the
range of a long, a component to 2**62 either way.

Queries come in blocks and the index in slices of bounded size; a task meets
one block and one slice and returns at most k rows per query.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id; rows with equal ids
count once (the smallest vector); vectors of different lengths have no
product, so each length is searched on its own; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postledger.llm.common import cut

SCALE = 1024
#: Stands where a query has fewer than k candidates; no id that takes part.
NONE = np.iinfo(np.int64).max
PIVOTS = 32
#: Queries of a block; vectors of a slice (fewer while the table is small, so that all tasks have work).
QUERY_BLOCK = 1024
SLICE, SMALL_SLICE, SMALL_SLICES = 65_536, 4096, 64


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str, zero: bool = True) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part; zero: whether zero vectors do."""
    v = F.col(vec_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def by_length(rows: DataFrame) -> list[tuple[DataFrame, int]]:
    """Rows of each length of v, and how many: only the lengths that occur reach the driver."""
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy("size").collect()
    return [(rows.where(F.size("v") == r["size"]), r["count"]) for r in lengths]


def _expand(best_s: np.ndarray, best_v: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, dist: np.ndarray, dq: np.ndarray, k: int) -> None:
    """Improve each query's k best by one pivot's vectors, which are in order of `dist`; dq: distances of the queries from that pivot."""
    qq, most = (q * q).sum(1), (x * x).sum(1).max()
    slack = (q.shape[1] + 4) * 2.0**-52 * (np.sqrt(qq * most) + qq + most)  # what doubles may be off by
    worst = np.where(best_v[:, -1] == NONE, -np.inf, best_s[:, -1].astype(np.float64)) - slack
    reach2 = qq + most - 2 * worst + slack  # |q - v|^2 at which a product still ties the k-th best
    reach = np.sqrt(np.maximum(reach2, 0)) * (1 + 1e-12) + 1e-6 + np.sqrt(slack)
    lo = np.where(reach2 >= 0, np.searchsorted(dist, dq - reach, "left"), 0)
    hi = np.where(reach2 >= 0, np.searchsorted(dist, dq + reach, "right"), 0)
    want = np.flatnonzero(hi > lo)
    if not len(want):
        return
    a, e = lo[want].min(), hi[want].max()
    ids = ids[a:e]
    score = q[want] @ x[a:e].T
    score[own[want][:, None] == ids[None, :]] = -np.inf
    floor = worst[want]
    if len(ids) > k:
        floor = np.maximum(floor, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * slack[want])
    row, col = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
    near = score[row, col]
    whole = (q[want].astype(np.int64)[row] * x[a:e].astype(np.int64)[col]).sum(1)
    whole = np.where(near >= 2.0**63, np.iinfo(np.int64).max, np.where(near < -(2.0**63), np.iinfo(np.int64).min, whole))
    # the k best of what was known and what is new, a run of rows for each query
    at = np.concatenate([np.repeat(np.arange(len(want)), k), row])
    s, v = np.concatenate([best_s[want].ravel(), whole]), np.concatenate([best_v[want].ravel(), ids[col]])
    order = np.lexsort((v, ~s, v == NONE, at))
    first = np.searchsorted(at[order], np.arange(len(want)))
    take = order[first[:, None] + np.arange(k)]
    best_s[want], best_v[want] = s[take], v[take]


def _search_slice(centre: np.ndarray, k: int):
    """Top k of a block of queries within a slice of the index."""

    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(index) and len(asked):
            q, own = np.array(asked["v"].tolist()), asked["vec_id"].to_numpy()
            best_s = np.full((len(q), k), np.iinfo(np.int64).min)
            best_v = np.full((len(q), k), NONE)
            dq = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (centre * centre).sum(1) - 2 * q @ centre.T, 0))
            cells = {p: g.sort_values(["dist", "vec_id"]) for p, g in index.groupby("pivot")}
            # the pivots nearest to the queries first: they raise the k-th best score soonest
            for p in sorted(cells, key=lambda p: (dq[:, p].mean(), p)):
                g = cells[p]
                _expand(best_s, best_v, q, own, np.array(g["v"].tolist()), g["vec_id"].to_numpy(), g["dist"].to_numpy(), dq[:, p], k)
            at = best_v != NONE
            out = {"query_id": np.repeat(own, k)[at.ravel()], "vec_id": best_v[at], "score": best_s[at]}
        return pd.DataFrame(out)

    return run


def _scaled(x: Column) -> Column:
    """floor(SCALE * x) as a double, within 2**62 either way."""
    most = F.lit(2.0**62)
    low = x * SCALE
    return F.when(F.abs(low) < 2.0**52, F.floor(low).cast("double")).otherwise(F.greatest(F.least(low, most), -most))


def exact_topk(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row whose id is divisible by `every`."""
    whole = valid_vectors(vectors, id_col, vec_col).select("vec_id", F.transform("v", _scaled).alias("v"))
    rows = cut(whole)
    found = [_topk_of_length(part, n, every, k, pivots) for part, n in by_length(rows)]
    return reduce(DataFrame.unionByName, found) if found else rows.selectExpr("vec_id AS query_id", "0 AS rank", "vec_id", "0L AS score")


def _topk_of_length(rows: DataFrame, n: int, every: int, k: int, pivots: int) -> DataFrame:
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).toPandas()  # `pivots` rows
    centre = np.array(sample["v"].tolist())

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.array(f["v"].tolist())
                d = (x * x).sum(1)[:, None] + (centre * centre).sum(1) - 2 * x @ centre.T
                near = d.argmin(1)
                yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "pivot": near, "dist": np.sqrt(((x - centre[near]) ** 2).sum(1))})

    slices = max(min(SMALL_SLICES, -(-n // SMALL_SLICE)), -(-n // SLICE))
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    index = (
        rows.mapInPandas(key, "vec_id long, v array<double>, pivot int, dist double")
        .withColumn("slice", part(slices))
        .withColumn("block", numbers(blocks))
    )
    queries = asked.withColumn("block", part(blocks)).withColumn("slice", numbers(slices))
    found = (
        index.groupBy("slice", "block")
        .cogroup(queries.groupBy("slice", "block"))
        .applyInPandas(_search_slice(centre, k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
