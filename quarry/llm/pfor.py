"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in ascending doc_id order:

    magic, then the blocks' payload, then the index, then its length (8 bytes)

A block holds 256 ids. Its smallest id is subtracted; what remains is packed at
the width that a given share of its ids needs, and the ids that need more are
listed as exceptions: position (1 byte) and value above the minimum (4 bytes).
The index has each block's start, minimum, width and number of exceptions, and
each document's id and number of ids, so that any block can be read by itself.

A task names its file by a random number and reports it; only what successful
tasks report is read, so files of lost attempts do no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm import tokens, words as W
from quarry.llm.frames import cut

MAGIC = b"PFOR0001"
BLOCK = 256
#: The share of a block's ids that fit its width.
SHARE = 0.95
END = 1
#: Bytes of text that go to one file, about; with less text, the cluster's cores share it while each gets as much as LEAST_BYTES.
FILE_BYTES, LEAST_BYTES = 32 << 20, 4 << 20
#: Bytes of text that are encoded at once; a worker's memory is some 60 MB less than with four times as many.
SLICE_BYTES = 1 << 20
_BLOCKS = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
_DOCS = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n_tokens", "<u8")])


def pack_blocks(ids: np.ndarray, at: int = 0, share: float = SHARE) -> tuple[bytes, np.ndarray]:
    """Payload and block index of ids; the last block may be short. at: the payload's start."""
    n = -(-len(ids) // BLOCK)
    table = np.zeros(n, _BLOCKS)
    if not n:
        return b"", table
    rows = np.append(ids, np.full(n * BLOCK - len(ids), ids[-1])).astype(np.uint32).reshape(n, BLOCK)
    table["least"] = rows.min(axis=1)
    rows = rows - table["least"][:, None]
    bits = np.ceil(np.log2(rows.astype(np.float64) + 1)).astype(np.uint8)
    table["width"] = np.partition(bits, int(share * (BLOCK - 1)), axis=1)[:, int(share * (BLOCK - 1))]
    over = bits > table["width"][:, None]
    table["exceptions"] = over.sum(axis=1)
    parts: list[bytes] = [b""] * n
    for width in np.unique(table["width"]):
        own = np.flatnonzero(table["width"] == width)
        if width:
            spread = (rows[own][:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
            packed = np.packbits(spread.astype(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
            for k, i in enumerate(own.tolist()):
                parts[i] = packed[k].tobytes()
    for i in np.flatnonzero(table["exceptions"]).tolist():
        where = np.flatnonzero(over[i])
        parts[i] += where.astype(np.uint8).tobytes() + rows[i][where].astype("<u4").tobytes()
    size = np.fromiter(map(len, parts), np.int64, n)
    table["start"] = at + np.cumsum(size) - size
    return b"".join(parts), table


def unpack_blocks(payload: bytes, table: np.ndarray, at: int = 0) -> np.ndarray:
    """Ids of whole blocks; at: where the payload starts in the file."""
    out = np.zeros((len(table), BLOCK), np.uint32)
    for width in np.unique(table["width"]):
        own = np.flatnonzero(table["width"] == width)
        if width:
            size = int(width) * BLOCK // 8
            raw = np.stack([np.frombuffer(payload, np.uint8, size, int(table["start"][i]) - at) for i in own])
            spread = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(own), BLOCK, int(width))
            out[own] = (spread.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    for i in np.flatnonzero(table["exceptions"]).tolist():
        n, start = int(table["exceptions"][i]), int(table["start"][i]) - at + int(table["width"][i]) * BLOCK // 8
        where = np.frombuffer(payload, np.uint8, n, start)
        out[i, where] = np.frombuffer(payload, "<u4", n, start + n)
    return (out + table["least"][:, None].astype(np.uint32)).ravel()


class Writer:
    """Writes one file; holds less than a block of ids besides the index."""

    def __init__(self, out) -> None:
        self.out, self.at, self.rest, self.tables, self.docs = out, len(MAGIC), np.zeros(0, np.uint32), [], []
        out.write(MAGIC)

    def add(self, docs: np.ndarray, ids: np.ndarray, last: bool = False) -> None:
        self.docs.append(docs)
        ids = np.concatenate([self.rest, ids])
        now = len(ids) if last else len(ids) // BLOCK * BLOCK
        payload, table = pack_blocks(ids[:now], self.at)
        self.rest = ids[now:]
        self.tables.append(table)
        self.out.write(payload)
        self.at += len(payload)

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        self.add(np.zeros(0, _DOCS), np.zeros(0, np.uint32), last=True)
        table, docs = np.concatenate(self.tables), np.concatenate(self.docs)
        total = int(docs["n_tokens"].sum())
        index = np.array([len(table), len(docs)], "<u8").tobytes() + table.tobytes() + docs.tobytes()
        self.out.write(index + np.array([len(index)], "<u8").tobytes())
        return len(docs), total


def write(docs: DataFrame, path: str, folder: str, end: int = END, partitions: int | None = None) -> DataFrame:
    """Writes the ids of all texts below folder, a URI; gives the manifest: part, file, n_docs, n_tokens.

    Documents are dealt by ranges of doc_id and sorted within; rows of one
    doc_id are ordered by their text, repeated rows are written each. A null
    doc_id comes first, a null or empty text is the end id alone, a very long one
    has a file of its own size. Other columns aren't read. Empty partitions and
    an empty table write no file.
    """
    if partitions is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        partitions = max(-(-size // FILE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), 1)
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange(partitions, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer = None, None
        for batch in W.sliced(batches, "text", SLICE_BYTES):
            if writer is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                name = f"part-{batch.column('part')[0].as_py():06d}-{uuid.uuid4().hex}.pfor"
                out = store.open_output_stream(f"{base}/{name}")
                writer, encoder = Writer(out), tokens.encoder(path, tokens.runs)
                part = batch.column("part")[0].as_py()
            ids, bounds = encoder.encode(batch.column("text"), end)
            rows = np.zeros(batch.num_rows, _DOCS)
            key = batch.column("doc_id")
            rows["known"] = key.is_valid().to_numpy(zero_copy_only=False)
            rows["doc_id"], rows["n_tokens"] = key.fill_null(0).to_numpy(), np.diff(bounds)
            writer.add(rows, ids)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": n_tokens}])

    return cut(rows.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"))


#: Blocks that a task decodes at once.
STRETCH = 4096


def _documents(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of a file's documents: rows of its index, ids, bounds."""
    store, name = fs.FileSystem.from_uri(uri)
    with store.open_input_file(name) as f:
        size = f.size()
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} isn't a file of this format")
        f.seek(size - 8)
        length = int(np.frombuffer(f.read(8), "<u8")[0])
        f.seek(size - 8 - length)
        index = f.read(length)
        n, m = (int(x) for x in np.frombuffer(index, "<u8", 2))
        table = np.frombuffer(index, _BLOCKS, n, 16)
        docs = np.frombuffer(index, _DOCS, m, 16 + n * _BLOCKS.itemsize)
        ends = np.cumsum(docs["n_tokens"]).astype(np.int64)
        rest, first, done = np.zeros(0, np.uint32), 0, 0
        for a in range(0, n, STRETCH):
            b = min(a + STRETCH, n)
            low, high = int(table["start"][a]), int(table["start"][b]) if b < n else size - 8 - length
            f.seek(low)
            rest = np.concatenate([rest, unpack_blocks(f.read(high - low), table[a:b], low)])
            last = int(np.searchsorted(ends, done + len(rest), side="right"))
            if last > first:
                bounds = np.concatenate([[0], ends[first:last] - done])
                yield docs[first:last], rest[: bounds[-1]], bounds
                rest, done, first = rest[bounds[-1] :], int(ends[last - 1]), last


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32, and its ids if wanted.

    Of a manifest without files there are no rows.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", before.alias("before"))  # a row for each file
    files = files.repartition(max(manifest.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                for docs, ids, bounds in _documents(uri):
                    ids = ids.astype("<u4")
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    columns = [pa.array(docs["doc_id"], mask=docs["known"] == 0), pa.array(bounds[:-1] + start), pa.array(docs["n_tokens"].astype(np.int64)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    start += int(bounds[-1])
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
