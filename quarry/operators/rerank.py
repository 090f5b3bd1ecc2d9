"""Reranking in two stages with any scorer that is a column expression (a pandas UDF of a model, too)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Candidates and characters of the first stage, candidates of the second.
STAGE_ONE, CHARACTERS, STAGE_TWO = 100, 800, 25


def _first(rows: DataFrame, score: str, n: int, out: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "chunk_id")
    return rows.withColumn(out, F.row_number().over(order)).where(F.col(out) <= n)


def two_stages(rows: DataFrame, k: int, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """The k best candidates of each question; rows: query_id, query, chunk_id, content, score.

    The first max(100, 2 k) by score are scored on their first 800 characters, the best 25 of these on their whole text.
    """
    pool = _first(rows, "score", max(STAGE_ONE, 2 * k), "_rank")
    pool = pool.withColumn("first_score", scorer(F.col("query"), F.substring("content", 1, CHARACTERS)))
    pool = _first(pool, "first_score", STAGE_TWO, "_rank").withColumn("rerank_score", scorer(F.col("query"), F.col("content")))
    return _first(pool, "rerank_score", k, "rank").select("query_id", "chunk_id", "first_score", "rerank_score", "rank")
