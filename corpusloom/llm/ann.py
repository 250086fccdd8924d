"""Nearest neighbours by stable projections and kd-trees with a chi-square stopping test.

Vectors are projected to a few dimensions by a seeded Gaussian matrix. For two vectors at distance d, the squared distance of
their projections over d^2 follows the chi-square distribution, so once the next projected neighbour is farther than
d_k * sqrt(quantile), with d_k the k-th best distance so far, a nearer vector is left unseen with a known small chance, and
the search stops. A kd-tree over a bounded sample of projections cuts the space into cells; each cell's block of vectors gets
a kd-tree of its own in a worker. A query first searches its own cell, whose k-th distance bounds the answer, and then
the cells that the test does not rule out; in these leaves are taken from the nearest on, their vectors that pass the test are
verified, in the end by exact distance in double precision, and the search stops once the test rules the next leaf out.

Every row is indexed. Of equal vectors the k + 1 smallest ids take part, which is all that an answer can hold; they are told by 128 bits
of hash. Vectors that are null, zero, of another size than most, or hold null or non-finite components take no part, nor do
rows without an id. Ties go to the smaller id. Extra columns are ignored. Cells grow in number with the vectors up to a bound and then in
size; only a cell with more vectors than a task should hold is dealt into several blocks, all of which its queries meet,
and only a cell that very many queries meet is written more than once, so that no group grows with the data and what
is written stays near the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import scoped, staged

#: Projected dimensions (even), chance that the test keeps a true neighbour, vectors of a block, of a leaf.
DIMENSIONS, CHANCE, BLOCK, LEAF = 8, 0.995, 1_024, 1_024
#: Queries that search a block together.
TOGETHER = 256
#: Projections that the cells are fitted on at most, cells at most; vectors that a task holds, queries that meet them at once.
SAMPLE, CELLS, ROWS, QUERIES = 20_000, 4_096, 65_536, 50_000
#: Tables up to so many rows of 24 bytes are broadcast.
BROADCAST_ROWS = 200_000


def chi2_quantile(p: float, degrees: int) -> float:
    """By bisection of the closed form for an even number of degrees."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for k in range(1, degrees // 2):
            term *= x / 2 / k
            total += term
        low, high = (x, high) if 1 - np.exp(-x / 2) * total < p else (low, x)
    return high


def projection(size: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(size, dimensions))


@dataclass
class Cells:
    """Boxes of a kd-tree's leaves."""

    low: np.ndarray
    high: np.ndarray

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each box."""
        out = np.zeros((len(points), len(self.low)))
        for d in range(points.shape[1]):
            x = points[:, d : d + 1]
            out += np.maximum(0, np.maximum(self.low[:, d] - x, x - self.high[:, d])) ** 2
        return out

    def home(self, points: np.ndarray) -> np.ndarray:
        return np.argmin(self.distances(points), axis=1) if len(points) else np.empty(0, np.int64)


def kd_cells(points: np.ndarray, n: int) -> tuple[Cells, list[np.ndarray]]:
    """Splits points at medians of the widest side into about n leaves; the boxes cover the whole space."""
    d = points.shape[1]
    pending = [(np.arange(len(points)), np.full(d, -np.inf), np.full(d, np.inf), n)]
    boxes, leaves = [], []
    while pending:
        rows, low, high, k = pending.pop()
        spread = np.ptp(points[rows], axis=0) if len(rows) > 1 else np.zeros(d)
        axis = int(np.argmax(spread))
        if k <= 1 or not spread[axis]:
            boxes.append((low, high))
            leaves.append(rows)
            continue
        x = points[rows, axis]
        cut = np.median(x)
        side = x <= cut if cut < x.max() else x < cut
        for part, a, b in ((rows[side], low, np.where(np.arange(d) == axis, cut, high)), (rows[~side], np.where(np.arange(d) == axis, cut, low), high)):
            pending.append((part, a, b, k // 2))
    return Cells(np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])), leaves


class Block:
    """The vectors of one block under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray):
        self.ids, self.vectors, self.points, self.squares = ids, vectors, vectors @ project, (vectors**2).sum(1)
        _, self.leaves = kd_cells(self.points, 1 << max(0, int(np.ceil(np.log2(max(1, len(ids) / LEAF))))))
        self.boxes = Cells(np.array([self.points[r].min(0) for r in self.leaves]), np.array([self.points[r].max(0) for r in self.leaves]))

    def search(self, own: np.ndarray, queries: np.ndarray, points: np.ndarray, k: int, bound: np.ndarray, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query the ids and distances of the nearest vectors found, ties to the smaller id; infinite where fewer are found.

        Leaves are taken from the nearest on. The projected neighbours in a leaf that the test leaves are compared by one
        product of matrices; those that may be among the k nearest, with room for its rounding, are then verified by exact
        distance, and the k-th of these is the bound for the next leaf.
        """
        bound, squares = bound.copy(), (queries**2).sum(1)
        ids, found = np.full((len(own), k), np.iinfo(np.int64).max), np.full((len(own), k), np.inf)
        far = self.boxes.distances(points)
        for leaf in np.argsort(far.min(0), kind="stable"):
            rows, active = self.leaves[leaf], np.flatnonzero(far[:, leaf] <= quantile * bound**2)
            if not len(active):
                continue
            most, p, x = bound[active, None] ** 2, points[active], self.points[rows]
            near = (p**2).sum(1)[:, None] + (x**2).sum(1) - 2 * p @ x.T
            sums = squares[active, None] + self.squares[rows]
            close = sums - 2 * queries[active] @ self.vectors[rows].T
            close[(near > quantile * most) | (self.ids[rows] == own[active, None])] = np.inf
            if len(rows) > k:
                most = np.minimum(most, np.partition(close, k - 1, axis=1)[:, k - 1 : k])
            q, at = np.nonzero((close <= most + 1e-9 * sums) & (close < np.inf))
            if not len(q):
                continue
            gap = self.vectors[rows[at]] - queries[active[q]]
            old = np.repeat(np.unique(q), k)
            # what is found so far and what is new, by query, distance and id
            query = np.concatenate([old, q])
            score = np.concatenate([found[active[old[::k]]].ravel(), np.sqrt(np.einsum("ij,ij->i", gap, gap))])
            name = np.concatenate([ids[active[old[::k]]].ravel(), self.ids[rows[at]]])
            order = np.lexsort((name, score, query))
            query, score, name = query[order], score[order], name[order]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            best = place < k
            found[active[query[best]], place[best]], ids[active[query[best]], place[best]] = score[best], name[best]
            bound = np.minimum(bound, found[:, -1])
        return ids, found


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Columns id and v (array of doubles) of the rows that take part, v of the commonest size."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    rows = rows.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def _search(blocks: DataFrame, wanted: DataFrame, project: np.ndarray, k: int, quantile: float) -> DataFrame:
    """blocks: block, id, v; wanted: block, id, v, bound. Returns query_id, vec_id, score."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = Block(left["id"].to_numpy(), np.stack(left["v"]), project)
            for at in range(0, len(right), TOGETHER):
                part = right.iloc[at : at + TOGETHER]
                queries, own = np.stack(part["v"]), part["id"].to_numpy()
                ids, found = block.search(own, queries, queries @ project, k, part["bound"].to_numpy(), quantile)
                row, column = np.nonzero(np.isfinite(found))
                out.append(pd.DataFrame({"query_id": own[row], "vec_id": ids[row, column], "score": found[row, column]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return blocks.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(search, "query_id long, vec_id long, score double")


def without_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of each group of equal vectors the k with the smallest ids. Only hashes and ids are shuffled to find the k-th of large groups."""
    hashed = rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    order = W.partitionBy("h1", "h2").orderBy("id")
    large = hashed.select("h1", "h2", "id").withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("h1", "h2", F.col("id").alias("last"))
    large = staged(large, "copies")
    if large.isEmpty():
        return rows
    small = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    return hashed.join(small, ["h1", "h2"], "left").where("last is null or id <= last").select("id", "v")


def _dealt(vectors: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a block: crowded cells are dealt by id, and their queries meet all parts; where very many queries meet
    a cell they are dealt, and the cell's vectors are written for each part. One row for each cell is counted and broadcast."""
    full, met = vectors.groupBy("cell").agg(F.count("*").alias("rows")), wanted.groupBy("cell").agg(F.count("*").alias("met"))
    plan = full.join(met, "cell").select("cell", F.ceil(F.col("rows") / ROWS).alias("salts"), F.ceil(F.col("met") / QUERIES).alias("parts"))
    plan = F.broadcast(staged(plan, "cells"))  # proven bound: CELLS rows
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    block = F.struct("cell", "salt", "part").alias("block")
    left = vectors.join(plan, "cell").withColumn("salt", F.pmod(F.xxhash64("id"), "salts")).withColumn("part", every("parts"))
    right = wanted.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), "parts")).withColumn("salt", every("salts"))
    return left.select(block, "id", "v"), right.select(block, "id", "v", "bound")


@scoped
def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, dimensions: int = DIMENSIONS, chance: float = CHANCE, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """The k nearest rows (id, v) of each query (id, v) other than itself: query_id, rank, vec_id, score."""
    rows = staged(without_copies(rows.select("id", "v"), k + 1), "vectors")
    queries = staged(queries.select("id", "v"), "queries")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    if not sample or queries.isEmpty():
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    project, quantile = projection(len(sample[0]), dimensions, seed), chi2_quantile(chance, dimensions)
    cells, _ = kd_cells(np.array(sample) @ project, min(CELLS, 1 << max(0, int(np.ceil(np.log2(n / block))))))

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series(cells.home(np.stack(v) @ project) if len(v) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, bound: pd.Series) -> pd.Series:
        points = np.stack(v) @ project
        far, own = cells.distances(points), cells.home(points)
        far[np.arange(len(own)), own] = np.inf
        return pd.Series([np.flatnonzero((f < np.inf) & (f <= quantile * b * b)).astype("int32") for f, b in zip(far, bound, strict=True)])

    placed = staged(rows.select("id", "v", home("v").alias("cell")), "placed")
    own = queries.select("id", "v", home("v").alias("cell"), F.lit(float("inf")).alias("bound"))
    first = staged(_search(*_dealt(placed, own), project, k, quantile), "nearest")
    known = queries.join(_kth(first, k).withColumnRenamed("query_id", "id"), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    wider = staged(known.select("id", "v", F.explode(others("v", "bound")).alias("cell"), "bound"), "wider")
    second = _search(*_dealt(placed, wider), project, k, quantile)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return first.union(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """The k-th best distance of each query that has k."""
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", F.col("score").alias("bound"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return nearest(rows, rows.where("id % 100 = 0"))
