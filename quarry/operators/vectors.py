"""Dense vectors: cosine similarity in double precision, exact top-k, entity resolution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries that are sent to all tasks at once; queries and rows that meet in one product; what a task holds beside the best rows.
BLOCK, PART, ROWS, WAITING = 16_384, 1024, 1024, 1_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k rows nearest to each query: query_id, row_id, score, rank. Both have id and embedding.

    Queries go to the tasks in blocks of a fixed number; each task keeps its best
    k rows for each query over all of its batches, so k rows a task and query are
    shuffled. Zero vectors have no score and are left out. Ties go to the smaller id.
    """
    return top_k_within(queries.withColumn("_all", F.lit(0)), rows.withColumn("_all", F.lit(0)), k, "_all")


def top_k_within(queries: DataFrame, rows: DataFrame, k: int, by: str) -> DataFrame:
    """As top_k, among the rows that have the query's value of by (an integer); others aren't compared."""
    queries = queries.where("embedding IS NOT NULL")
    blocks = max(-(-queries.count() // BLOCK), 1)
    parts = queries.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    own = rows.where("embedding IS NOT NULL").where(dot("embedding", "embedding") > 0).select("id", "embedding", F.col(by).cast("long").alias("by"))
    out = None
    for b in range(blocks):
        held = parts.where(F.col("_block") == b).select("id", "embedding", F.col(by).alias("by")).toPandas()  # about BLOCK queries, 8 MB of 64 numbers
        part = own.mapInPandas(_keeper(held["id"].to_numpy(), _unit(held["embedding"]), held["by"].to_numpy(), k), "query_id long, row_id long, score double")
        out = part if out is None else out.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "row_id")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _keeper(ids: np.ndarray, matrix: np.ndarray, by: np.ndarray, k: int):
    """What keeps a task's best k rows for each query.

    What may be better than a query's k-th best so far waits until it is WAITING rows, and is then cut to the best k, so memory is
    bounded by k rows a query and WAITING, not by how many rows a task reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)]  # place of the query, row, score
        least, waiting, n = np.full(len(ids), -2.0), [], 0

        def cut() -> list[np.ndarray]:
            rows = [np.concatenate(x) for x in zip(best, *waiting, strict=True)]
            order = np.lexsort((rows[1], -np.round(rows[2], 9), rows[0]))
            rows = [x[order] for x in rows]
            rank = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
            rows, rank = [x[rank < k] for x in rows], rank[rank < k]
            least[rows[0][rank == k - 1]] = rows[2][rank == k - 1] - 1e-8  # with all ties
            return rows

        for batch in batches:
            for value in np.intersect1d(batch["by"].to_numpy(), by):
                rows = batch[batch["by"].to_numpy() == value]
                mine = np.flatnonzero(by == value)
                for start in range(0, len(rows), ROWS):
                    part = rows.iloc[start : start + ROWS]
                    units, row_ids = _unit(part["embedding"]), part["id"].to_numpy()
                    for a in range(0, len(mine), PART):
                        own = mine[a : a + PART]
                        scores = np.nan_to_num(matrix[own] @ units.T, copy=False, nan=-2.0)
                        edge = np.full(len(own), -2.0)
                        if scores.shape[1] > k:
                            edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 1e-8
                        q, r = np.nonzero((scores >= np.maximum(edge, least[own])[:, None]) & (scores > -2.0))
                        waiting.append((own[q].astype(np.int32), row_ids[r], scores[q, r]))
                        n += len(q)
                        if n >= WAITING:
                            best, waiting, n = cut(), [], 0
        best = cut()
        for a in range(0, len(best[0]), WAITING):
            part = slice(a, a + WAITING)
            yield pd.DataFrame({"query_id": ids[best[0][part]], "row_id": best[1][part], "score": best[2][part]})

    return run


def _unit(vectors: pd.Series) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 1))
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    with np.errstate(invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)
