"""Graph retrieval in all its stages, and searches that go on from hop to hop with a state for each question.

Tables: mentions (space_id, chunk_id, name, relevance); known (space_id, entity, term: all names and aliases by which an entity
is known, its own too); terms (query_id, space_id, name, pos). Rows of a stage are pairs of chunk and name, as a chunk may
mention several; a chunk stands with its first one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators import fusion, graph
from quarry.session import cut

#: Most terms of a question's search and of a hop's, terms that may be parts of names, names beside the found ones, what these lose.
MOST_TERMS, HOP_TERMS, PARTIAL_TERMS, NEIGHBOURS, DECAY = 120, 80, 5, 40, 0.88
#: Hops, candidates of all hops, new candidates of a hop, names that lead on. One hop without new candidates is the last.
MOST_HOPS, BUDGET, PER_HOP, LEADING = 3, 80, 20, 12

_KEY = ["query_id", "space_id"]


def closure(terms: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """terms and all names and aliases of the entities that they name, the first most of them: terms by pos, then others by name."""
    hit = terms.join(known.select("space_id", "entity", F.col("term").alias("name")), ["space_id", "name"]).select(*_KEY, "entity").distinct()
    more = hit.join(known, ["space_id", "entity"]).select(*_KEY, F.col("term").alias("name"), F.lit(None).cast("long").alias("pos"))
    rows = terms.select(*_KEY, "name", F.col("pos").cast("long").alias("pos")).union(more).groupBy(*_KEY, "name").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy(*_KEY).orderBy(F.col("pos").asc_nulls_last(), "name")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)


def _first_rows(rows: DataFrame, most: Column | int) -> DataFrame:
    """The first rows (chunk_id, name, relevance) of each question by relevance, with their place."""
    order = Window.partitionBy(*_KEY).orderBy(F.desc(F.round("relevance", 9)), "chunk_id", "name")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _held(names: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions of names; for the first rows of a question, the best mentions of each name are enough."""
    return mentions.join(names.select(*_KEY, "name").distinct(), ["space_id", "name"]).select(*_KEY, "chunk_id", "name", "relevance")


def _next(stage: int, rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows of chunks that aren't found yet, of each chunk the first."""
    rows = rows.join(found.select(*_KEY, "chunk_id").distinct(), [*_KEY, "chunk_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy(*_KEY, "chunk_id").orderBy("place"))
    return rows.withColumn("_n", first).where("_n = 1").select(*_KEY, "chunk_id", "name", "relevance", F.lit(stage).alias("stage"), "place")


def _holding(terms: DataFrame, mentions: DataFrame) -> DataFrame:
    """Names of a space that hold a term; they meet by runs of three letters, so that not all names meet all terms."""
    names = mentions.select("space_id", "name").distinct().where(F.length("name") >= 3)
    run = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(F.col("name"), i, F.lit(3)))))
    own = terms.where(F.length("name") >= 3).select(*_KEY, F.col("name").alias("term"))
    once = own.select("space_id", "term").distinct().withColumn("run", F.substring("term", 1, 3))
    held = once.join(names.withColumn("run", run), ["space_id", "run"]).where(F.contains("name", "term")).select("space_id", "term", "name")
    return own.join(held, ["space_id", "term"]).select(*_KEY, "name").distinct()


def _beside(found: DataFrame, mentions: DataFrame, most: int) -> DataFrame:
    """Names that stand in chunks with the found ones, without these: those of the most common chunks. A question has most found ones at most."""
    seeds = cut(found.select(*_KEY, "name").distinct())
    near = graph.mentioned_with(mentions, seeds, NEIGHBOURS + most)
    order = Window.partitionBy(*_KEY).orderBy(F.desc("weight"), "name")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= NEIGHBOURS).select(*_KEY, "name")


def _chunks(rows: DataFrame) -> DataFrame:
    """One row for each chunk: its first name, its best relevance, its stage and order; neighbours' relevance is decayed."""
    decayed = F.col("relevance") * F.when(F.col("stage") == 2, DECAY).otherwise(1.0)
    order = F.struct("stage", "place")
    return rows.groupBy(*_KEY, "chunk_id").agg(F.min_by("name", order).alias("name"), F.max(decayed).alias("score"), F.min(order).alias("_o")).select(*_KEY, "chunk_id", "name", "score", "_o.stage", "_o.place")


def search(terms: DataFrame, mentions: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """Chunks of a question's space by names: query_id, space_id, chunk_id, name, score, stage, place.

    Stage 0: chunks that mention a term, or another name of an entity that a term names; k rows at most. Stage 1, where these are fewer
    than half of k: names that hold one of the first five terms. Stage 2, where there still are fewer than k: names that stand beside
    those found. mentions is read in each stage, so it should be a table. Questions meet the k best chunks of a name only.
    """
    best = graph._best_of_names(mentions, k)
    expanded = cut(closure(terms, known, MOST_TERMS))
    exact = cut(_first_rows(_held(expanded, best), k).withColumn("stage", F.lit(0)))
    counted = expanded.select(*_KEY).distinct().join(exact.groupBy(*_KEY).agg(F.count("*").alias("n")), _KEY, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = expanded.where(F.col("pos") <= PARTIAL_TERMS).join(counted.where(F.col("n") < k // 2), _KEY)
    partial = _first_rows(_held(_holding(few, best), best).join(counted, _KEY), F.lit(k) - F.col("n"))
    found = cut(exact.select(*_KEY, "chunk_id", "name", "relevance", "stage", "place").unionByName(_next(1, partial, exact)))
    counted = found.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") < k)
    beside = _held(_beside(found.join(counted.select(*_KEY), _KEY, "left_semi"), mentions, k), best)
    last = _first_rows(beside.join(counted, _KEY), F.lit(k) - F.col("n"))
    return _chunks(found.unionByName(_next(2, last, found)))


def from_seeds(seeds: DataFrame, mentions: DataFrame, known: DataFrame, seen: DataFrame, most: int = PER_HOP, best: DataFrame | None = None) -> DataFrame:
    """New chunks by names: the first most chunks that aren't in seen (query_id, chunk_id), those of the seeds before those of the names beside them.

    best: the best 2 * most mentions of each name, where they are written already.
    """
    best = graph._best_of_names(mentions, 2 * most) if best is None else best
    exact = cut(_first_rows(_held(closure(seeds, known, HOP_TERMS), best), 2 * most).withColumn("stage", F.lit(0)))
    beside = _first_rows(_held(_beside(exact, mentions, 2 * most), best), most)
    rows = exact.select(*_KEY, "chunk_id", "name", "relevance", "stage", "place").unionByName(_next(2, beside, exact))
    order = F.struct("stage", "place")
    first = rows.groupBy(*_KEY, "chunk_id").agg(F.min_by("name", order).alias("name"), F.min_by("relevance", order).alias("score"), F.min(order).alias("_o"))
    first = first.join(seen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    n = F.row_number().over(Window.partitionBy(*_KEY).orderBy("_o"))
    return first.withColumn("_n", n).where(F.col("_n") <= most).select(*_KEY, "chunk_id", "name", "score")


def hops(first: DataFrame, pivots: DataFrame, mentions: DataFrame, known: DataFrame, expanding: bool = True) -> DataFrame:
    """Candidates of questions over up to three hops, scored by their depth: query_id, chunk_id, hop, name, mh_score.

    first: query_id, space_id, chunk_id, vector, lexical, kag (signals; null: none), name (by which the graph found it, or null) and
    score (fused). pivots: query_id, name. Each question has a state: chunks and names seen, and whether it goes on. A hop starts
    from the names that most of the 20 best candidates have and that weren't seen; a question ends without such names, with 80
    candidates or after a hop without a new one. Evidence of a chunk is how many pivots its name holds. A question's state
    is bounded by its budget; states are tables, cut off in each hop, and all questions take a hop together. Without expanding, names
    of the first candidates count as seen, so that only such names lead on as others of the candidates have: none, where the graph alone names them.
    """
    zero = F.lit(0.0)
    rows = cut(first.select(*_KEY, "chunk_id", *(F.coalesce(c, zero).alias(c) for c in ("vector", "lexical", "kag")), zero.alias("evidence"), F.lit(0).alias("hop"), "name", "score"))
    names = rows.where("name IS NOT NULL").select("query_id", "name").distinct()
    names = names.limit(0) if expanding else names
    going, best = rows.select(*_KEY).distinct(), graph._best_of_names(mentions, 2 * PER_HOP)
    for hop in range(1, MOST_HOPS + 1):
        open_now = rows.join(going, _KEY, "left_semi")
        going = open_now.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") < BUDGET).select(*_KEY)
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
        top = open_now.join(going, _KEY, "left_semi").withColumn("place", first).where(F.col("place") <= PER_HOP)
        leading = top.where("name IS NOT NULL").groupBy(*_KEY, "name").agg(F.count("*").alias("n"), F.min("place").alias("place"))
        order = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.desc("n"), "place"))
        seeds = cut(leading.withColumn("pos", order).where(F.col("pos") <= LEADING).join(names, ["query_id", "name"], "left_anti").select(*_KEY, "name", "pos"))
        if seeds.isEmpty():
            break
        found = from_seeds(seeds, mentions, known, rows, best=best)
        held = found.join(pivots.select("query_id", F.col("name").alias("_pivot")).where("_pivot <> ''").distinct(), "query_id", "left")
        evidence = F.sum(F.when(F.contains("name", "_pivot"), 1.0).otherwise(0.0))
        new = cut(held.groupBy(*_KEY, "chunk_id", "name", "score").agg(evidence.alias("evidence")).select(*_KEY, "chunk_id", zero.alias("vector"), zero.alias("lexical"), F.col("score").alias("kag"), "evidence", F.lit(hop).alias("hop"), "name", "score"))
        if new.isEmpty():  # all questions that went on have met their patience of one hop
            break
        names = cut(names.union(seeds.select("query_id", "name")).distinct())
        rows = cut(reduce(DataFrame.unionByName, [rows, new]))
        going = new.select(*_KEY).distinct()
    return fusion.depth_score(rows).join(rows.select("query_id", "chunk_id", "name"), ["query_id", "chunk_id"]).select("query_id", "chunk_id", "hop", "name", "mh_score")
