"""Largest inner products by collision counting over sorted projections.

With M the largest norm, a vector x becomes (x, sqrt(M² - |x|²)) and a query (M q / |q|, 0); the
nearest by distance is then the largest by inner product. Every vector is projected on a fixed
set of random lines. A block of vectors keeps one array per line, sorted by projection; around a
query's projection a window opens in each array, and each step of virtual rehashing widens all
windows by a factor. A vector collides on the lines whose window holds it. As soon as enough vectors of
the block have collided on ``threshold`` of the lines, those are verified by their inner product.
Windows end up over the whole block if need be, so a block always yields as many as it can.

Queries in blocks meet vectors in blocks; every vector is indexed and no partner is cut off. Each
pair of blocks returns its best ``k``, and these are merged. Rows with equal ids and vectors count
once; rows that share an id only are candidates and queries of their own, and a query leaves out
just its own row. Null ids, and vectors that are null, zero, or hold null or non-finite
components, take no part; vectors of different lengths are never compared. With fewer than
``k`` candidates all are returned. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.registry import importable
from sluice.workspace import written

LINES = 80
#: Share of the lines on which a candidate collides.
THRESHOLD = 0.75
#: Share of a block that is verified for a query, and at least so many times the k wanted.
VERIFIED, TIMES = 0.25, 15
#: The factor by which windows widen, and the steps that the next query starts back by.
STEP, BACK = 1.12, 2
BLOCK = 4096
SEED = 20

_RESULT = "query_id long, query_key long, vec_id long, score double"


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(group: pd.DataFrame) -> np.ndarray:
    return np.stack(group["vector"].to_numpy()).astype(np.float64)


def search_block(vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, norm: float, k: int):
    """For each query, the places of verified vectors. ``own``: place of the query's own vector, or -1."""
    n, dim = vectors.shape
    lines = np.random.default_rng(SEED).standard_normal((dim + 1, LINES))
    lift = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))
    projected = (vectors @ lines[:dim] + lift[:, None] * lines[dim]).T
    order = np.argsort(projected, axis=1, kind="stable")
    arrays = np.take_along_axis(projected, order, axis=1)
    centres = (queries * (norm / np.sqrt((queries * queries).sum(1)))[:, None]) @ lines[:dim]
    threshold, wanted = math.ceil(THRESHOLD * LINES), math.ceil(min(n, max(TIMES * k, VERIFIED * n)))
    start = float(np.median(np.abs(arrays - np.median(arrays, axis=1)[:, None]))) or norm
    edges: list[tuple[np.ndarray, np.ndarray]] = []  # of all queries' windows, for each step

    def windows(step: int) -> tuple[np.ndarray, np.ndarray]:
        while step >= len(edges):
            half = start * STEP ** len(edges)
            sides = ([np.searchsorted(a, c + sign * half, side) for a, c in zip(arrays, centres.T, strict=True)] for sign, side in ((-1, "left"), (1, "right")))
            edges.append(tuple(np.stack(side, 1) for side in sides))
        return edges[step]

    step = 0
    for number in range(len(centres)):
        step = max(0, step - BACK)  # a query opens its windows somewhat narrower than where the one before ended
        low, high = (side[number] for side in windows(step))
        outside = [o[:x] for o, x in zip(order, low, strict=True)] + [o[y:] for o, y in zip(order, high, strict=True)]
        misses = np.bincount(np.concatenate(outside), minlength=n)  # lines on which a vector does not collide
        while len(candidates := np.nonzero(misses <= LINES - threshold)[0]) < wanted:
            step += 1
            a, b = (side[number] for side in windows(step))
            new = [o[x:y] for o, x, y in zip(order, a, low, strict=True)] + [o[x:y] for o, x, y in zip(order, high, b, strict=True)]
            misses -= np.bincount(np.concatenate(new), minlength=n)
            low, high = a, b
        yield candidates[candidates != own[number]]


def _search(norm: float, k: int):
    columns = ("query_id", "query_key", "vec_id", "score")

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in columns})
        vectors, queries = vectors.sort_values(["id", "key"]), queries.sort_values(["id", "key"])
        ids, data, asked = vectors["id"].to_numpy(), _vectors(vectors), _vectors(queries)
        place = {row: i for i, row in enumerate(zip(vectors["id"], vectors["key"], strict=True))}
        rows = list(zip(queries["id"], queries["key"], strict=True))
        own = np.array([place.get(row, -1) for row in rows])
        found = []
        for (name, key), query, candidates in zip(rows, asked, search_block(data, asked, own, norm, k), strict=True):
            score = (data[candidates] * query).sum(1)
            best = np.lexsort((ids[candidates], -score))[:k]
            found.append((np.full(len(best), name), np.full(len(best), key), ids[candidates[best]], score[best]))
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*found, strict=True), strict=True)})

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best for each vector whose id is divisible by ``every``."""
    importable(vectors.sparkSession)
    chosen = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    chosen = chosen.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    chosen = chosen.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("times")).drop("times")
    rows = written(chosen.withColumns({"dim": F.size("vector"), "key": F.xxhash64("vector")}), "vectors")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    asked = F.col("id") % every == 0
    count, queries, norm = rows.agg(F.count(F.lit(1)), F.count_if(asked), F.max(F.sqrt(squares))).first()
    blocks, query_blocks = max(1, math.ceil(count / BLOCK)), max(1, math.ceil(queries / BLOCK))
    part = F.xxhash64("id", "key")
    data = rows.withColumn("block", F.pmod(part, F.lit(blocks))).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>")))
    wanted = rows.where(asked).withColumn("query_block", F.pmod(part, F.lit(query_blocks))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    key = ["dim", "block", "query_block"]
    found = data.groupBy(key).cogroup(wanted.groupBy(key)).applyInPandas(_search(norm or 0.0, k), _RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
