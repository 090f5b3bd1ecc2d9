"""Importance resampling towards a target distribution, by hashed n-grams and Arrow kernels.

Texts go through ascii_lower, split_pattern_regex, list_flatten and
dictionary_encode. Runs of words are shifted dictionary indices: a run of n words is
the run of n - 1 before it, numbered among its distinct ones, and the next word. Only
distinct runs are spelled out and hashed, to CRC32 modulo the number of buckets.
Tasks add up buckets before anything is shuffled; the gains of all buckets, a bounded
number, go to all tasks, where they are taken by index and reduced within documents.

A document's score is its weight and Gumbel noise drawn from its id, so the highest
scores are a weighted sample without repetition. Scores are whole numbers of bounded
range: ranks are offsets of scores, out of their counts, and places within a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm import words as W
from quarry.llm.frames import cut, fresh, stored

#: What isn't in words, after lower-casing A-Z.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Plan:
    """Longest runs of words, buckets, tenths of a percent drawn, fewest words of those that may be drawn, seed of the noise."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def _crcs(runs: Iterator[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, runs), np.int64, n)


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of the texts, the text of each run, and the number of words of each text."""
    data, bounds = W.buffer(texts)  # ascii_lower reads arrays wrong whose first offset isn't 0, as slices' are
    texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(bounds)), pa.py_buffer(np.ascontiguousarray(data)))
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # texts that start or end between words have empty parts there
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(owner, minlength=len(texts))
    coded = pc.dictionary_encode(flat)
    spelled = coded.dictionary.cast(pa.large_binary()).to_pylist()
    word = coded.indices.to_numpy().astype(np.int64)
    run, runs, found, owners = word, spelled, [], []
    for n in range(1, longest + 1):
        if n > 1:
            inside = owner[n - 1 :] == owner[: len(owner) - n + 1] if len(owner) >= n else np.zeros(0, bool)
            pair = run[: len(inside)] * np.int64(max(len(spelled), 1)) + word[n - 1 :][: len(inside)]
            held, run = np.unique(pair, return_inverse=True)  # runs across texts are numbered too, but not counted
            left, right = np.divmod(held, max(len(spelled), 1))
            runs = [runs[a] + b" " + spelled[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        else:
            inside = np.ones(len(word), bool)
        crc = _crcs(iter(runs), len(runs)) % buckets
        found.append(crc[run[inside]])
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(found), np.concatenate(owners), n_words


def counts(rows: DataFrame, plan: Plan) -> DataFrame:
    """bucket, n: how many runs of the texts of rows fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(plan.buckets, np.int64)
        for batch in W.sliced(batches, "text"):
            total += np.bincount(features(batch.column("text"), plan.longest, plan.buckets)[0], minlength=plan.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, plan: Plan) -> DataFrame:
    """bucket, gain of all buckets: thousandths of the logarithm of how much likelier it is in the target, with one more run in each bucket."""
    both = raw.sparkSession.range(plan.buckets).select(F.col("id").alias("bucket"))
    both = both.join(counts(raw, plan).withColumnRenamed("n", "s"), "bucket", "left").join(counts(target, plan).withColumnRenamed("n", "t"), "bucket", "left")
    both = cut(both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    total = F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + plan.buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + plan.buckets)).cast("double")
    return both.crossJoin(total).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(docs: DataFrame, gain: DataFrame, plan: Plan) -> DataFrame:
    """docs with n_features, n_words, weight (the floored mean gain of a document's runs, 0 without any); the columns are in a struct, importance."""
    table = np.zeros(plan.buckets, np.int64)
    for row in gain.collect():  # plan.buckets rows
        table[row.bucket] = row.gain
    spread = docs.sparkSession.sparkContext.broadcast(table)
    out = fresh("importance", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(spread.value)
        for batch in W.sliced(batches, "text"):
            bucket, owner, n_words = features(batch.column("text"), plan.longest, plan.buckets)
            value = pc.take(own, pa.array(bucket)).to_numpy()
            n = np.bincount(owner, minlength=batch.num_rows)
            order = np.argsort(owner, kind="stable")  # runs of one length are in order; lengths follow each other
            total = np.concatenate([[0], np.cumsum(value[order])])
            end = np.cumsum(n)
            weight = np.where(n > 0, (total[end] - total[end - n]) // np.maximum(n, 1), 0)
            held = pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(n_words.astype(np.int64)), pa.array(weight.astype(np.int64))], names=["n_features", "n_words", "weight"])
            yield pa.RecordBatch.from_arrays([*batch.columns, held], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, docs.select("*", F.lit(None).cast("struct<n_features: long, n_words: long, weight: long>").alias(out)).schema)


def ranked(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (score, doc_id, n_words) with rank: 1 and on for those drawn, by falling score, then rising doc_id; null for others.

    Scores are whole thousandths of logarithms, some ten thousand different ones at any size. They are counted, their offsets are
    added up within steps of 128 and over the steps. What one score has, at most a few rows in ten thousand unless ids
    repeat, is numbered together.
    """
    able = F.col("n_words") >= plan.least_words
    by_score = cut(rows.where(able).groupBy("score").count().withColumn("step", F.floor(F.col("score") / 128)))
    steps = sorted(by_score.groupBy("step").agg(F.sum("count").alias("n")).collect(), reverse=True)  # a few hundred rows
    offset, above = {}, 0
    for row in steps:
        offset[row.step], above = above, above + row.n
    drawn = above * plan.percent // 100
    higher = F.coalesce(F.sum("count").over(Window.partitionBy("step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.sparkSession.createDataFrame(list(offset.items()), "step long, first long")
    offsets = by_score.withColumn("higher", higher).join(F.broadcast(first), "step")
    offsets = cut(offsets.select("score", (F.col("first") + F.col("higher")).alias("offset")).where(F.col("offset") < drawn))
    with_offset = rows.join(F.broadcast(offsets), "score", "left")
    high = with_offset.where(able & F.col("offset").isNotNull())
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    high = high.withColumn("rank", F.when(F.col("offset") + place <= drawn, (F.col("offset") + place).cast("long")))
    rest = with_offset.where(F.col("offset").isNull() | ~able).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(rest).drop("offset")


def annotate(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, n_words, weight, score, rank (null: not drawn).

    docs: doc_id, text; target: text. Null and empty texts have no words: weight 0, and they are only drawn if plan.least_words is 0.
    Very long texts are read whole. Repeated rows count as often as they stand there and are scored alike; equal scores rank
    by doc_id, null ids last. A null id has noise of its own, one for all. Empty tables give no rows; an empty target is uniform.
    Other columns don't matter, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    gain = gains(docs, target.select("text"), plan)
    held = weighted(docs, gain, plan).select("doc_id", "importance.*")
    return ranked(stored(held.withColumn("score", F.col("weight") + noise(F.col("doc_id"), plan.seed))), plan)


def sample(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of docs (doc_id is unique) that are drawn."""
    drawn = annotate(docs, target, plan).where("rank IS NOT NULL").select("doc_id")
    return docs.join(drawn, "doc_id", "left_semi")
