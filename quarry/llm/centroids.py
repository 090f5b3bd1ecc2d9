"""Centroid clustering of integer vectors, with Ptolemaic lower bounds over fixed pivot pairs.

For a vector x, a centroid c and pivots p, q Ptolemy's inequality gives
d(x, c) d(p, q) >= |d(x, p) d(c, q) - d(x, q) d(c, p)|. Distances from the pivots are
taken once and stay beside each vector; those of the centroids are taken in each
round. A centroid is checked exactly, in integers, only if its greatest bound,
rounded down, isn't above the exact distance of the centroid of the least bound.

A round is one narrow pass: tasks add up each cluster's vectors, and only these
sums, a number of clusters times the dimensions for each task, are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.frames import cut, fresh, stored

#: Vectors that are compared at once, and pairs of vector and centroid that are checked at once.
BLOCK, CHECKED = 4096, 65_536
#: Components beyond this have distances that don't fit into 64 bits.
LARGEST = 1 << 27
#: Relative error that is allowed for in a product or quotient of rounded distances; theirs is some 1e-15.
SLACK = 1e-13


@dataclass(frozen=True)
class Plan:
    """Clusters, rounds of moving centroids, components of a vector, steps of a unit, seed of the first centroids, pivots and pairs of them."""

    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    steps: int = 256
    seed: int = 2
    pivots: int = 6
    pairs: int = 8


class Pivots:
    """Pivots (each a row of integers) and the pairs of them that give bounds."""

    def __init__(self, rows: np.ndarray, most: int) -> None:
        self.rows = rows
        apart = np.sqrt(squares(rows, rows).astype(np.float64))
        first, second = np.triu_indices(len(rows), 1)
        order = np.argsort(-apart[first, second], kind="stable")[:most]
        order = order[apart[first[order], second[order]] > 0]
        self.first, self.second, self.apart = first[order], second[order], apart[first[order], second[order]]

    def bounds(self, own: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared lower bounds (vectors x centroids), rounded down, from squared distances from the pivots."""
        x, c = np.sqrt(own.astype(np.float64)), np.sqrt(centroids.astype(np.float64))
        most = np.zeros((len(x), len(c)))
        for p, q, apart in zip(self.first, self.second, self.apart, strict=True):
            a, b = np.outer(x[:, p], c[:, q]), np.outer(x[:, q], c[:, p])
            np.maximum(most, (np.abs(a - b) - SLACK * (a + b)) / apart, out=most)
        return most * most * (1 - SLACK)


def squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of left and right, in integers."""
    out = np.empty((len(left), len(right)), np.int64)
    for j, row in enumerate(right):
        gap = left - row
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def _exact(x: np.ndarray, i: np.ndarray, centroids: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), CHECKED):
        gap = x[i[at : at + CHECKED]] - centroids[j[at : at + CHECKED]]
        out[at : at + CHECKED] = np.einsum("ij,ij->i", gap, gap)
    return out


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row of x (ties: the smaller number), its squared distance, and how many pairs were checked exactly."""
    bound = pivots.bounds(own, squares(centroids, pivots.rows)) if len(pivots.rows) else np.zeros((len(x), len(centroids)))
    every = np.arange(len(x))
    guess = bound.argmin(axis=1)
    least = _exact(x, every, centroids, guess)
    i, j = np.nonzero(bound <= least[:, None])
    distance = np.full(bound.shape, np.iinfo(np.int64).max)
    distance[i, j] = _exact(x, i, centroids, j)
    found = distance.argmin(axis=1)
    return found, distance[every, found], len(i)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def kept(rows: DataFrame, plan: Plan) -> DataFrame:
    """vec_id and x (integers) of vectors of the right length without null, infinite or undefined components."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = (F.size("embedding") == plan.dimensions) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    out = rows.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(x, lambda e: F.floor(plan.steps * e).cast("long")).alias("x"))
    fits = F.forall("x", lambda e: F.abs(e) <= LARGEST)
    return out.withColumn("x", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large: distances must fit into 64 bits")).cast("array<long>")))


def first_centroids(vectors: DataFrame, plan: Plan) -> np.ndarray:
    """The vectors of the least hashes of their ids; of equal ids by their components."""
    draw = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(draw.alias("draw"), "x").orderBy("draw", "x").limit(plan.clusters).collect()  # as many as clusters
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), plan.dimensions)


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """n rows that are far from each other: the first, then always the one farthest from all before it; equal rows are no two pivots."""
    if not len(rows):
        return rows
    chosen = [0]
    far = squares(rows, rows[:1])[:, 0]
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squares(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def measured(vectors: DataFrame, pivots: Pivots, plan: Plan) -> DataFrame:
    """vectors with own: the squared distances from the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = squares(_rows(batch.column("x"), plan.dimensions), pivots.rows)
            held = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * own.shape[1]), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), held], names=["vec_id", "x", "own"])

    return vectors.select("vec_id", "x").mapInArrow(run, vectors.select("vec_id", "x", F.lit(None).cast("array<long>").alias("own")).schema)


def _nearest(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: Pivots) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, int]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = _rows(part.column("x"), centroids.shape[1])
            yield part, x, *nearest(x, _rows(part.column("own"), len(pivots.rows)), centroids, pivots)


def sums(held: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    """cluster, n, checked (pairs checked exactly), total (the sum of its vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, checked = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), 0
        for _, x, found, _, pairs in _nearest(batches, centroids, pivots):
            order = np.argsort(found, kind="stable")
            some, first = np.unique(found[order], return_index=True)
            total[some] += np.add.reduceat(x[order], first, axis=0)
            n += np.bincount(found, minlength=len(n))
            checked += pairs
        at = np.flatnonzero(n)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * total.shape[1]), pa.array(total[at].reshape(-1)))
        pairs = np.zeros(len(at), np.int64)
        pairs[:1] = checked
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(pairs), flat], names=["cluster", "n", "checked", "total"])

    parts = held.mapInArrow(run, "cluster int, n long, checked long, total array<long>")
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"d{i}") for i in range(centroids.shape[1])]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("checked").alias("checked"), *each).select("cluster", "n", "checked", F.array(*(f"d{i}" for i in range(centroids.shape[1]))).alias("total"))


def fit(held: DataFrame, first: np.ndarray, pivots: Pivots, plan: Plan) -> tuple[np.ndarray, list[int]]:
    """Centroids after all rounds, and how many pairs each round checked exactly; the driver holds the sums of the clusters."""
    centroids, checked = first.copy(), []
    for _ in range(plan.rounds if len(first) else 0):
        moved = sums(held, centroids, pivots).collect()  # a row for each cluster
        centroids = centroids.copy()
        for row in moved:
            centroids[row.cluster] = [int(t) // row.n for t in row.total]
        checked.append(sum(row.checked for row in moved))
    return centroids, checked


def annotate(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    rows: vec_id, embedding. Vectors of another length and such with null, infinite or undefined components are left out, null
    ones too. With fewer vectors than clusters each is a centroid. Repeated rows are vectors like others; of equal centroids the
    smaller number has all. A null vec_id is hashed as an empty text. An empty table gives no rows. Components beyond LARGEST, whose distances
    don't fit into 64 bits, are an error. Other columns don't matter, whatever their names.
    """
    vectors = stored(kept(rows.select("vec_id", "embedding"), plan))
    first = first_centroids(vectors, plan)
    pivots = Pivots(spread(first, plan.pivots), plan.pairs)
    held = stored(measured(vectors, pivots, plan))
    centroids, _ = fit(held, first, pivots, plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, found, distance, _ in _nearest(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(found.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    out = stored(held.mapInArrow(run, held.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = rows.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    each = cut(out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")))
    each = each.crossJoin(F.broadcast(each.agg(F.sum("cluster_inertia").alias("inertia")))).join(F.broadcast(names), "cluster")  # one row for each cluster
    return out.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assign(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """rows, all of them, with cluster and distance of their vec_id (unique); null where the vector isn't kept."""
    found, own = annotate(rows, plan), fresh("vec", rows.columns)
    return rows.join(found.select(F.col("vec_id").alias(own), "cluster", "distance"), F.col(own) == F.col("vec_id"), "left").drop(own)
