"""Retrieval of passages for many questions in one plan: three signals, fusion, filter, parents, title boost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.operators import fusion, graph, lexical, rerank, vectors
from quarry.session import cut


def retrieve(questions: DataFrame, documents: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, mentions: DataFrame, k: int = 15, over: int = 3) -> DataFrame:
    """Passages of questions (query_id, content, embedding): query_id, document_id, score, rank.

    chunk_vectors: id (chunk), embedding. mentions: space_id, chunk_id, name,
    relevance. Each signal gives over times k candidates. A document stands with
    its best chunk, boosted by the words that its title shares with the question.
    """
    vector = vectors.top_k(questions.select(F.col("query_id").alias("id"), "embedding"), chunk_vectors, over * k).select("query_id", F.col("row_id").alias("chunk_id"), "score")
    words = lexical.top_k(questions.select("query_id", "content"), chunks, over * k).select("query_id", "chunk_id", "score")
    names = questions.select("query_id", F.lit(0).alias("space_id"), F.explode(T.meaningful_words("content")).alias("name"))
    held = mentions.withColumn("space_id", F.lit(0))
    linked = graph.retrieve(names, held, over * k).select("query_id", "chunk_id", "score")
    fused = fusion.keep_strong(fusion.fuse(vector, words, linked))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid_score", 9)), "chunk_id")
    fused = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = fused.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("query_id", "document_id").agg(F.max("hybrid_score").alias("hybrid_score"), F.min("rank").alias("first"))
    titled = best.join(documents.select("document_id", "title"), "document_id").join(questions.select("query_id", "content"), "query_id")
    scored = titled.withColumn("score", F.col("hybrid_score") + fusion.title_boost("content", "title"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first")
    return scored.select("query_id", "document_id", "score", F.row_number().over(by).cast("long").alias("rank"))


def answer(questions: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, mentions: DataFrame, scorer: Callable[[Column, Column], Column], k: int = 10, pool: int = 45, block: int = 4) -> DataFrame:
    """Passages of questions within their spaces, the whole way: query_id, document_id, block, rank, way.

    questions: query_id, space_id, content, embedding (null: no vector signal). chunks: chunk_id, document_id, chunk_index, space_id, content.
    chunk_vectors: id, space_id, embedding. mentions: space_id, chunk_id, name, relevance. Each signal looks at the question's space
    alone. Candidates are fused, weak ones dropped; the first pool of them are reranked in two stages, unless the first five are so near
    that this is skipped (way: direct). A question without candidates gets those of its words (way: fallback). Chunks stand for
    the block of chunks around them, each block once, with its best rank.
    """
    vector = vectors.top_k_within(questions.select(F.col("query_id").alias("id"), "embedding", "space_id"), chunk_vectors, pool, "space_id").select("query_id", F.col("row_id").alias("chunk_id"), "score")
    words = lexical.top_k(questions.select("query_id", "content", "space_id"), chunks, pool, "space_id").select("query_id", "chunk_id", "score")
    names = questions.select("query_id", "space_id", F.explode(T.meaningful_words("content")).alias("name"))
    linked = graph.retrieve(names, mentions, pool).select("query_id", "chunk_id", "score")
    texts = chunks.select("chunk_id", "document_id", "chunk_index", "content").dropDuplicates(["chunk_id"])
    kept = fusion.keep_strong(fusion.fuse(vector, words, linked)).join(texts, "chunk_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid_score", 9)), "chunk_id")
    kept = cut(kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pool))  # few rows, read four times
    stop = fusion.early_stop(kept.select("query_id", F.col("place").alias("rank"), F.coalesce("vector_similarity", F.lit(0.0)).alias("score")), 5).select("query_id", "stop")
    kept = kept.join(stop, "query_id")
    asked = kept.where("NOT stop").join(questions.select("query_id", F.col("content").alias("query")), "query_id").select("query_id", "query", "chunk_id", "content", F.col("hybrid_score").alias("score"))
    ranked = rerank.two_stages(asked, k, scorer).select("query_id", "chunk_id", "rank", F.lit("rerank").alias("way"))
    direct = kept.where("stop").where(F.col("place") <= k).select("query_id", "chunk_id", F.col("place").alias("rank"), F.lit("direct").alias("way"))
    left = questions.join(kept.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "content", "space_id")
    last = lexical.keyword_fallback(left, chunks, k, "space_id").select("query_id", "chunk_id", "rank", F.lit("fallback").alias("way"))
    rows = ranked.union(direct).union(last).join(texts.drop("content"), "chunk_id")
    rows = rows.groupBy("query_id", "document_id", F.floor(F.col("chunk_index") / block).alias("block")).agg(F.min("rank").alias("best"), F.min("way").alias("way"))
    by = Window.partitionBy("query_id").orderBy("best")
    return rows.select("query_id", "document_id", "block", F.row_number().over(by).cast("long").alias("rank"), "way")
