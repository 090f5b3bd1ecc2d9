"""Near duplicates by b-bit MinHash, confirmed on whole shingle sets.

A set keeps 160 minima of as many hash functions. Five of them make the key of
one of 32 bands; two sets of similarity 0.85 share no band once in 10^8 times.
Of each minimum the lowest four bits stay, packed into 80 bytes. Two signatures
agree in a share E of their minima, by chance alone in C = 1/16 of them, so
(E - C) / (1 - C) estimates their similarity. Its standard deviation is 0.03 at
0.85: pairs from 0.65 on are confirmed on their sets, which decide.

Equal sets (told by 128 bits of hash) are one class, and have one signature.
Classes that share a band are a bucket. Within buckets signatures are compared by
bit counts; what estimates connect is a cell. To a cell's task its texts go, each
once, and pairs of close estimate that aren't connected yet are confirmed on
their sets. Tasks return the links that connect, never the pairs of a group.
Buckets and cells of more than a chunk are dealt out; see connected().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm import words as W
from quarry.llm.frames import fresh, salted, stored
from quarry.llm.jaccard import BROADCAST_IDS, _add, components, lead, shingles

#: Two sets link from so many hundredths of similarity on.
PERCENT = 85
BANDS, ROWS, BITS = 32, 5, 4
MINIMA = BANDS * ROWS
#: Pairs of a lower estimate aren't confirmed; seven standard deviations below PERCENT.
LEAST_ESTIMATE = 0.65
#: Members that one task compares, and their shingles; a single longer text is compared whole.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Members of a dealt cell that go to all of its chunks.
PIVOTS = 8

_rng = np.random.default_rng(85)
_FACTORS = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_LOWEST = np.uint64(0x1111111111111111)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima (sets x functions) of sets that aren't empty and start at starts."""
    out = np.empty((len(starts), MINIMA), dtype=np.uint64)
    if len(starts):
        held = np.empty_like(hashes)
        for i in range(MINIMA):
            np.multiply(hashes, _FACTORS[i], out=held)
            held += _TERMS[i]
            held >>= np.uint64(32)
            out[:, i] = np.minimum.reduceat(held, starts)
    return out


def packed(minimum: np.ndarray) -> np.ndarray:
    """The lowest four bits of all minima, two in a byte (sets x 80)."""
    low = (minimum & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, ::2] | low[:, 1::2] << BITS


def bands(minimum: np.ndarray) -> np.ndarray:
    """The key of each band (sets x bands)."""
    parts = minimum.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(W.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for r in range(ROWS):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated similarities of packed signatures (as rows of 64-bit words) of equal or broadcast shapes, corrected for chance."""
    other = left ^ right
    other |= other >> np.uint64(2)
    other |= other >> np.uint64(1)
    other &= _LOWEST
    agree = 1 - np.bitwise_count(other).sum(axis=-1, dtype=np.int64) / MINIMA
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.sliced(batches, "text"):
        hashes, bounds = shingles(batch.column("text"))
        n = np.diff(bounds)
        full = np.flatnonzero(n)
        low = minima(hashes, bounds[:-1][full])
        place = np.full(len(n), -1)
        place[full] = np.arange(len(full))
        at = pa.array(place, mask=place < 0)
        signature = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MINIMA * BITS // 8), len(full), [None, pa.py_buffer(np.ascontiguousarray(packed(low)))]).cast(pa.binary())
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(bands(low).reshape(-1)))
        columns = [batch.column("rid"), batch.column("doc_id"), pa.array(n), pa.array(_add(W.mix(hashes), bounds)), pa.array(_add(W.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds)), signature.take(at), keys.take(at)]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "doc_id", "n", "s1", "s2", "signature", "bands"])


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _sets(table: pa.Table) -> list[np.ndarray]:
    """Shingle sets of the rows, which must be those that the first pass has seen."""
    out: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    for batch in W.sliced(iter(table.select(["text"]).to_batches()), "text"):
        hashes, bounds = shingles(batch.column("text"))
        out += [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sums.append(_add(W.mix(hashes), bounds))
    if [len(x) for x in out] != table["n"].to_pylist() or not np.array_equal(np.concatenate(sums), table["s1"].to_numpy()):
        raise ValueError("the documents were read in another order than before")
    return out


def _comparer(percent: int, confirm: bool):
    """What finds links (a, b) of a group: those that connect its members whose estimates, and with confirm whose sets, are near enough.

    role: 0 meets all, 1 and 2 meet each other; members of one label are connected.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, n, role = (table[c].to_numpy() for c in ("id", "n", "role"))
        group = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        edges: list[tuple[int, int]] = []
        if group.any():
            signature, sets = _matrix(table["signature"]), _sets(table) if confirm else []
            left, right = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
            if confirm:
                held, owner = np.concatenate([sets[i] for i in right]), np.repeat(np.arange(len(right)), n[right])
                order = np.argsort(held, kind="stable")
                held, owner = held[order], owner[order]
            for at in range(0, len(left), 128):
                mine = left[at : at + 128]
                estimate = estimates(signature[mine][:, None, :], signature[right][None, :, :])
                near = (estimate >= LEAST_ESTIMATE) & (100 * np.minimum(n[mine][:, None], n[right]) >= percent * np.maximum(n[mine][:, None], n[right]))
                for i, own in zip(mine, near, strict=True):
                    place = np.flatnonzero(own & (group[right] != group[i]))
                    if confirm and len(place):
                        if len(place) < 16:
                            common = np.array([W.has(sets[right[j]], sets[i]).sum() for j in place])
                        else:
                            low, high = np.searchsorted(held, sets[i]), np.searchsorted(held, sets[i], side="right")
                            common = np.bincount(owner[W.positions(low, high - low)[0]], minlength=len(right))[place]
                        place = place[100 * common >= percent * (n[i] + n[right[place]] - common)]
                    if len(place):
                        met, first = np.unique(group[right[place]], return_index=True)
                        edges += [(ids[i], ids[right[place[x]]]) for x in first]
                        group[np.isin(group, met)] = group[i]
        return pa.table({"a": np.array([x for x, _ in edges], np.int64), "b": np.array([x for _, x in edges], np.int64)})

    return run


def connected(cells: DataFrame, rows: DataFrame, percent: int, confirm: bool, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect what is near within a cell.

    cells: cell, id, size; rows: id, n, signature and, to confirm on sets, s1 and text. Both should be tables. Cells of more than
    a chunk are dealt out in chunks, to each of which some members of the cell go as pivots. What isn't connected with most of its cell
    then meets all chunks, so the members of a group of near copies don't meet each other.
    """
    run, limit = _comparer(percent, confirm), CHUNK_SHINGLES if confirm else 1 << 62
    columns = [c for c in rows.columns if c != "id"]
    sizes = cells.groupBy("cell").agg(F.count("*").alias("members"), F.sum("size").alias("total"), F.min("id").alias("least")).where("members > 1")
    chunks = F.ceil(F.greatest(F.col("members") / chunk, F.least(F.col("total") / limit, F.col("members")))).cast("int")
    sizes = stored(sizes.select("cell", "members", "least", chunks.alias("chunks")))
    dealt = stored(salted(cells, sizes, ["cell"], "id").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")))
    is_pivot = (F.col("id") == F.col("least")) | (F.pmod(F.xxhash64("id", F.lit(1)), "members") < PIVOTS)
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    first = dealt.withColumn("chunk", F.explode(F.when((F.col("chunks") > 1) & is_pivot, every).otherwise(F.array("chunk"))))
    first = first.select("cell", "chunk", "id", F.col("id").alias("label"), F.lit(0).alias("role")).join(rows, "id")
    near = stored(first.groupBy("cell", "chunk").applyInArrow(run, "a long, b long"))
    if sizes.where("chunks > 1").isEmpty():
        return near
    labels = components(near)
    large = stored(dealt.where("chunks > 1").join(labels, "id", "left").select("cell", "chunk", "chunks", "id", "size", F.coalesce("label", "id").alias("label")))
    leading = large.groupBy("cell", "label").count().groupBy("cell").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("lead"), F.count("*").alias("labels")).where("labels > 1")
    mixed = stored(salted(large, stored(leading.select("cell", "lead")), ["cell"], "id"))
    rest = mixed.where("label <> lead")
    shares = rest.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / chunk, F.least(F.sum("size") / limit, F.count("*")))).cast("int").alias("shares"))
    mixed = stored(salted(mixed, stored(shares), ["cell"], "id"))
    share = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    one = mixed.where("label <> lead").withColumn("share", F.pmod(F.xxhash64("id"), "shares").cast("int")).withColumn("chunk", F.explode(every)).withColumn("role", F.lit(1))
    two = mixed.withColumn("share", share).withColumn("role", F.lit(2))
    last = one.unionByName(two).select("cell", "share", "chunk", "id", "label", "role").join(rows.select("id", *columns), "id")
    return near.union(stored(last.groupBy("cell", "share", "chunk").applyInArrow(run, "a long, b long")))


def links(sets: DataFrame, texts: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """id, label (the smallest id that is connected) of all classes that link with another.

    sets: id, n, s1, signature, bands, a table; texts: id, text.
    """
    held = sets.select("id", F.explode("bands").alias("bucket"))
    buckets = stored(held.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")).where("members > 1"))
    once = stored(buckets.groupBy("members", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket"))  # of buckets with the same members one
    cells = stored(held.join(once, "bucket", "left_semi").select(F.col("bucket").alias("cell"), "id", F.lit(1).alias("size")))
    likely = components(connected(cells, sets.select("id", "n", "signature"), percent, False, chunk))
    wanted = likely.select("id")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi")  # so that others needn't move
    rows = stored(texts.join(sets.drop("bands"), "id").join(likely, "id"))
    cells = rows.select(F.col("label").alias("cell"), "id", F.col("n").alias("size"))
    return components(connected(cells, rows.drop("label"), percent, True, chunk))


def classes(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs: rid, doc_id, n_shingles, component_id, kept, label (one for each group).

    rid is monotonically_increasing_id() over docs, which must read the same
    again, as tables do; other texts than before are an error. A text without
    words, or null, has no shingles, is linked with nothing, has its own doc_id and
    is kept. Very long texts are read whole. Repeated rows are one class, and all
    of the smallest doc_id are kept. A null doc_id is never the smallest while another is
    there. An empty table gives no rows. Other columns of docs don't matter, whatever their names.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = stored(docs.mapInArrow(_signed, "rid long, doc_id long, n long, s1 long, s2 long, signature binary, bands array<long>"))
    same = ["n", "s1", "s2"]
    groups = stored(seen.where("n > 0").groupBy(*same).agg(F.min("rid").alias("id"), F.min("doc_id").alias("smallest")))
    sets = stored(seen.join(groups.select(F.col("id").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("id"), "n", "s1", "signature", "bands"))
    labels = links(sets, docs.select(F.col("rid").alias("id"), "text"), percent, chunk)
    labelled = groups.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = stored(labelled.groupBy("label").agg(F.min("smallest").alias("component_id")))
    found = stored(labelled.join(smallest, "label").select(*same, "label", "component_id"))
    rows = seen.select("rid", "doc_id", *same)
    full = salted(rows.where("n > 0"), found, same, "rid").select("rid", "doc_id", "n", "component_id", "label")
    out = full.union(rows.where("n = 0").select("rid", "doc_id", "n", F.col("doc_id"), F.lit(-1) - F.col("rid")))
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "label")


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, of which one row of each group of near copies stays, the one of the smallest doc_id."""
    rid = fresh("rid", docs.columns)
    stay = lead(classes(docs, percent)).select(F.col("rid").alias(rid))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(stay, rid, "left_semi").drop(rid)
