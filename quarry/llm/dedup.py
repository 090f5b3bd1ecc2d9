"""Exact deduplication by deterministic block naming.

Texts are cut into fixed-size blocks. Equal blocks get one integer name, then
adjacent names are paired and the pairs named, until each document has one
name. A name is the smallest occurrence number of the sorted group that it
stands for, so two different groups never share one: no hash decides that
texts are equal. A hash only tells blocks apart: one whose hash occurs once
is a group of its own, and so is every pair and document that holds it, so
the contents of such blocks needn't be moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.frames import LETTERS, cut, fresh, stored

BLOCK_BYTES = 8192
CHANGED = "the documents were read in another order than before"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower())


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """rid, body, ... -> one row for each block: pos, block."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("body") / size).cast("int") - 1)
    rows = texts.withColumn("last", last).select("*", F.explode(F.sequence(F.lit(0), "last")).alias("pos"))
    return rows.withColumn("block", F.expr(f"substring(body, pos * {size} + 1, {size})")).drop("body")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of docs: rid, doc_id, keep_id, keep_rid, group_size, kept, text_sha256.

    rid is monotonically_increasing_id() over docs, which must give the same
    rows in the same order when read again, as tables do; a block that isn't what
    it was is an error. Null texts equal empty ones. Of equal texts the row with the largest doc_id stays (null is
    the smallest), of repeated rows with that doc_id the last read. Any number
    of blocks is named, in as many rounds as the logarithm of the longest text.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", normalised(F.col("text")).alias("norm"))
    body = texts.select("rid", "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("body"))
    occurrences = _blocks(body, block_bytes).select(
        "rid", "pos", "last", F.monotonically_increasing_id().alias("oid"), F.xxhash64("block").alias("h"),
        *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "text_sha256")),
    )
    occurrences = cut(occurrences)

    # Blocks that may have an equal one; a document that has another block has no equal.
    again = cut(occurrences.groupBy("h").count().where("count > 1").select("h"))
    shared = occurrences.select("rid", "pos", "last", "oid", "h").join(again, "h")
    whole = cut(shared.groupBy("rid").agg(F.count("*").alias("n"), F.first("last").alias("last")).where("n = last + 1").select("rid"))
    contents = texts.select("rid", F.col("norm").cast("binary").alias("body")).join(whole, "rid", "left_semi")
    contents = _blocks(contents, block_bytes)
    numbers = occurrences.select("rid", "pos", "oid", "h")
    same = F.when(F.xxhash64("block") == F.col("h"), F.col("h")).otherwise(F.raise_error(F.lit(CHANGED)))
    contents = stored(contents.join(numbers, ["rid", "pos"]).withColumn("h", same))
    names = cut(contents.groupBy("h", "block").agg(F.min("oid").alias("name")))
    level = cut(contents.join(names, ["h", "block"]).select("rid", "pos", "last", "oid", "name"))

    done, depth = level.where("last = 0").select("rid", F.lit(0).alias("depth"), "name"), 0
    longest = level.agg(F.max("last")).first()[0] or 0
    while longest > 0:
        depth, longest = depth + 1, longest // 2
        even = F.col("pos") % 2 == 0
        pairs = level.where("last > 0").groupBy("rid", F.expr("pos div 2").cast("int").alias("half")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.min("oid").alias("oid"), F.first(F.expr("last div 2").cast("int")).alias("last"),
        )
        pairs = cut(pairs.withColumnRenamed("half", "pos"))
        names = cut(pairs.groupBy("a", "b").agg(F.min("oid").alias("name")))
        level = cut(pairs.join(names, ["a", "b"]).select("rid", "pos", "last", "oid", "name"))
        done = done.union(level.where("last = 0").select("rid", F.lit(depth).alias("depth"), "name"))

    rows = occurrences.where("pos = 0").select("rid", "doc_id", "text_sha256")
    named = cut(done.join(rows.select("rid", "doc_id"), "rid"))
    groups = cut(named.groupBy("depth", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1"))
    found = named.join(groups, ["depth", "name"]).select("rid", F.col("keep.doc_id").alias("keep_id"), F.col("keep.rid").alias("keep_rid"), "group_size", F.lit(True).alias("named"))
    return rows.join(found, "rid", "left").select(
        "rid", "doc_id",
        F.when(F.col("named"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("keep_rid", "rid").alias("keep_rid"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_rid", "rid") == F.col("rid")).alias("kept"), "text_sha256",
    )


def deduplicate(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, as they are."""
    rid, gone = fresh("rid", docs.columns), fresh("gone", docs.columns)
    dropped = identities(docs, block_bytes).where("not kept").select(F.col("rid").alias(rid), F.struct("doc_id").alias(gone))
    stays = F.when(F.col(gone).isNull(), True).when(F.col(f"{gone}.doc_id").eqNullSafe(F.col("doc_id")), False).otherwise(F.raise_error(F.lit(CHANGED)))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(dropped, rid, "left").where(stays).drop(rid, gone)
