"""Benchmark decontamination by winnowing.

Of every nine consecutive 5-gram hashes the rightmost smallest is kept as a
fingerprint, for benchmark items and documents alike. Any 13 words that both
share hold nine common 5-grams, so both keep the same one at the same place:
joining the fingerprints finds every shared span of 13 words or more. Hits are
extended along their diagonal and only runs of 13 words count. Items of fewer
words are looked up whole, by the hash of exactly as many words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quarry.llm import words as W
from quarry.llm.frames import fresh, stored

SPAN = 13  # words of a window
K = 5  # words of a hashed gram
WINDOW = SPAN - K + 1  # grams of which one is kept
#: A benchmark of at most so many bytes goes to every task; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20

VERDICT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("contaminated", T.BooleanType()),
])
_VERDICT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("contaminated", pa.bool_())])


def winnow(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of texts of SPAN words or more: hash, word position (over all texts), text."""
    grams = W.grams(hashes, K)
    n = len(grams) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, dtype=np.int8)
    for j in range(1, WINDOW):
        other = grams[j : j + n]
        take = other <= least
        np.copyto(least, other, where=take)
        where[take] = j
    at, owner = W.positions(*W.gram_bounds(bounds, SPAN))
    kept = at + where[at]
    new = np.ones(len(kept), dtype=bool)
    new[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])
    return grams[kept[new]], kept[new], owner[new]


def whole(hashes: np.ndarray, bounds: np.ndarray, n: int, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of the texts: hash, position, text."""
    at, owner = W.positions(*W.gram_bounds(bounds, n))
    grams = W.grams(hashes, n)[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)
    if only is not None:
        at, owner, grams = at[only[owner]], owner[only[owner]], grams[only[owner]]
    return grams, at, owner


def fingerprints(words: W.Words, short: list[int], items: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents, or of items: an item of fewer words than SPAN has one for all of it."""
    found = [winnow(words.hashes, words.bounds)]
    size = np.diff(words.bounds)
    for n in short:
        found.append(whole(words.hashes, words.bounds, n, size == n if items else None))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def extend(document: np.ndarray, seeds: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, list[int]]:
    """Extends seeds (item's words, diagonal): the document's hit words, and the seeds that hold."""
    hit, held = np.zeros(len(document) + 1, dtype=np.int64), []
    for k, (item, diagonal) in enumerate(seeds):
        low = max(0, diagonal)
        high = min(len(document), diagonal + len(item))
        need = min(SPAN, len(item))
        if high - low < need:
            continue
        same = np.zeros(high - low + 2, dtype=np.int8)
        same[1:-1] = document[low:high] == item[low - diagonal : high - diagonal]
        edge = np.diff(same)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= need
        if long.any():
            held.append(k)
            np.add.at(hit, low + start[long], 1)
            np.add.at(hit, low + end[long], -1)
    return np.cumsum(hit)[:-1] > 0, held


class Index:
    """The benchmark's fingerprints, sorted, with the places of each."""

    def __init__(self, ids: list[str], texts: pa.Array) -> None:
        words = W.scan(texts, W.ALNUM)
        size = np.diff(words.bounds)
        self.ids = ids
        self.items = [words.hashes[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.short = sorted({int(n) for n in size if 0 < n < SPAN})
        prints, at, owner = fingerprints(words, self.short, items=True)
        order = np.argsort(prints, kind="stable")
        self.prints, self.item = prints[order], owner[order]
        self.at = (at - words.bounds[owner])[order]
        self.distinct = np.unique(self.prints)

    def verdicts(self, texts: pa.Array) -> pa.Array:
        words = W.scan(texts, W.ALNUM)
        prints, at, owner = fingerprints(words, self.short, items=False)
        keep = W.has(self.distinct, prints)
        prints, at, owner = prints[keep], at[keep], owner[keep]
        low, high = np.searchsorted(self.prints, prints), np.searchsorted(self.prints, prints, side="right")
        place, hit = W.positions(low, high - low)
        pairs = np.stack([owner[hit], self.item[place], at[hit] - words.bounds[owner[hit]] - self.at[place]], axis=1)
        return judge(words, np.unique(pairs, axis=0), self.items, self.ids)


def judge(words: W.Words, pairs: np.ndarray, items: list[np.ndarray], ids: list[str]) -> pa.Array:
    """Verdicts of texts; pairs: (text, item, diagonal), sorted."""
    size = np.diff(words.bounds)
    out: list[dict] = [{"n_words": int(n), "n_hit": 0, "n_items": 0, "items": [], "spans": [], "contaminated": False} for n in size]
    for d in np.unique(pairs[:, 0]) if len(pairs) else ():
        mine = pairs[np.searchsorted(pairs[:, 0], d) : np.searchsorted(pairs[:, 0], d, side="right")]
        hit, held = extend(words.hashes[words.bounds[d] : words.bounds[d + 1]], [(items[i], int(g)) for _, i, g in mine])
        if n := int(hit.sum()):
            found = sorted({ids[mine[k][1]] for k in held})
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1).tolist()
            out[d] |= {"n_hit": n, "n_items": len(found), "items": found, "spans": spans, "contaminated": 20 * n >= int(size[d])}
    return pa.array(out, type=_VERDICT)


def _with(batch: pa.RecordBatch, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "verdict"])


def annotate(docs: DataFrame, benchmark: DataFrame, out: str = "decontamination", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs, with a struct column: n_words, n_hit, n_items, items (ids as text), spans (word ranges), contaminated.

    The struct's name gets underscores while a column of docs has it. Null
    texts have no words and no hits; neither have empty ones. Items without
    words match nothing; repeated items count once by their id, and an item
    whose id is null has the empty string as its id. Repeated documents each
    get their own row. Empty tables give no rows or no hits.
    """
    spark, name = docs.sparkSession, fresh(out, docs.columns)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("words"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("words") + 16), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in bench.collect()])

        def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = None
            for batch in W.sliced(batches, "text"):
                index = index or Index([x for x, _ in held.value], pa.array([x for _, x in held.value], type=pa.string()))
                yield _with(batch, index.verdicts(batch.column("text")))

        schema = T.StructType([*docs.schema.fields, T.StructField("verdict", VERDICT)])
        flat = docs.select("*").toDF(*[f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)])
        fields = [T.StructField(c, f.dataType) for c, f in zip(flat.columns, schema.fields, strict=False)]
        return flat.mapInArrow(narrow, T.StructType([*fields, T.StructField("verdict", VERDICT)])).toDF(*docs.columns, name)
    return _joined(docs, bench, name)


def _joined(docs: DataFrame, bench: DataFrame, name: str) -> DataFrame:
    """For any benchmark: fingerprints are joined by a shuffle, candidate items go to their documents."""
    key = fresh("doc_key", docs.columns)
    docs = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    schema = "k long, print long, at long, owner string"

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "words"):
            words = W.scan(batch.column("words"), W.ALNUM)
            short = sorted({int(n) for n in np.diff(words.bounds) if 0 < n < SPAN})
            prints, at, owner = fingerprints(words, short, items=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(words.bounds)[owner]), pa.array(prints.view(np.int64)), pa.array(at - words.bounds[owner]), batch.column("item").take(pa.array(owner))], names=["k", "print", "at", "owner"])

    bench = bench.distinct()
    held = stored(bench.mapInArrow(item_prints, schema))
    short = [r[0] for r in held.where(F.col("k") < SPAN).select("k").distinct().collect()]  # at most 12 numbers

    def doc_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text"):
            words = W.scan(batch.column("text"), W.ALNUM)
            prints, _, owner = fingerprints(words, short, items=False)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(owner)), pa.array(prints.view(np.int64))], names=["k", "print"])

    found = docs.select(F.col(key).alias("k"), "text").mapInArrow(doc_prints, "k long, print long")
    pairs = found.distinct().join(held.select("print", "owner").distinct(), "print").select("k", F.col("owner").alias("item")).distinct()
    candidates = pairs.join(bench, "item").groupBy("k").agg(F.collect_list(F.struct("item", "words")).alias("items")).withColumnRenamed("k", f"{key}_")
    cols = [f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)]
    both = docs.join(candidates, F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_").toDF(*cols, "held_items")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text"):
            out = []
            for text, items in zip(batch.column("text"), batch.column("held_items"), strict=True):
                items = items.as_py() or []
                index = Index([x["item"] for x in items], pa.array([x["words"] for x in items], type=pa.string()))
                out.append(index.verdicts(pa.array([text.as_py()], type=pa.string())))
            yield _with(batch.drop_columns(["held_items"]), pa.concat_arrays(out))

    fields = [T.StructField(c, f.dataType) for c, f in zip(cols, docs.schema.fields, strict=True)]
    return both.mapInArrow(verify, T.StructType([*fields, T.StructField("verdict", VERDICT)])).toDF(*docs.columns, name).drop(key)


def digest(items: str) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    name = fresh("decontamination", docs.columns)
    return annotate(docs, benchmark).where(~F.col(f"{name}.contaminated")).drop(name)
