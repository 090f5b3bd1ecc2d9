"""Packing of documents into token sequences by best-fit decreasing.

Overlong documents are first cut into full windows. What remains goes, longest
first, into the open window of the least room that still holds it, which a
segment tree over remaining room finds. Each partition packs its own rows, in
groups of a bounded number of ids. Of the windows that have room left, those of
the most room stay open for later groups, a bounded number, so ids never move
and memory doesn't grow with the partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm import tokens, words as W

CAPACITY = 2048
END = 1
#: Ids that a task holds before it packs them.
GROUP_IDS = 8 << 20
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 20
#: Windows that stay open from group to group at most.
OPEN_WINDOWS = 1 << 16


class Room:
    """A segment tree over remaining room: how many open windows have just so much."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        if room:
            self.open[room].append(window)
            self._change(room, 1)

    def close(self, limit: int) -> None:
        """Closes the windows of the least room, but for limit of them."""
        over = self.count[1] - limit
        for room, held in enumerate(self.open):
            if over <= 0:
                return
            gone = min(over, len(held))
            if gone:
                del held[:gone]
                self._change(room, -gone)
                over -= gone

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes the window with the least room of at least need: room, window."""
        at = self.leaves + need
        while not self.count[at]:
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            # at is now the right neighbour of a subtree that holds nothing of use
            while not self.count[at] and not at & 1:
                at >>= 1
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        room = at - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()


class Packer:
    """Assigns (sequence, offset) to lengths; windows stay open between calls."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_WINDOWS) -> None:
        self.capacity, self.limit, self.room, self.sequences = capacity, limit, Room(capacity), 0

    def window(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def pack(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[i])
            room, window = self.room.take(n) or (self.capacity, self.window())
            sequence[i], offset[i] = window, self.capacity - room
            self.room.add(room - n, window)
        self.room.close(self.limit)
        return sequence, offset


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32, and its ids if wanted.

    A null or empty text is the end id alone. Repeated rows are packed each; a
    null doc_id stays null. sequence_id holds the partition above bit 33 and a
    running number below, so it is unique. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.encoder(path, tokens.before_spaces), Packer(capacity)
        base = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for batch in W.sliced(batches, "text", SLICE_BYTES):
            held.append((batch.column("doc_id"), *encoder.encode(batch.column("text"), end)))
            if sum(len(x[1]) for x in held) >= GROUP_IDS:  # the last text may be longer than a group; it is packed whole
                yield _pieces(held, packer, base, with_ids)
                held = []
        if held:
            yield _pieces(held, packer, base, with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def _pieces(held: list, packer: Packer, base: int, with_ids: bool) -> pa.RecordBatch:
    capacity = packer.capacity
    ids = np.concatenate([x[1] for x in held]).astype("<u4")
    size = np.concatenate([np.diff(x[2]) for x in held])
    count = -(-size // capacity)
    begin = np.cumsum(size) - size
    number, owner = W.positions(np.zeros(len(size), np.int64), count)
    start = number * capacity
    length = np.minimum(size[owner] - start, capacity)
    full = length == capacity
    sequence, offset = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    sequence[full] = [packer.window() for _ in range(int(full.sum()))]
    sequence[~full], offset[~full] = packer.pack(length[~full])
    low = begin[owner] + start
    crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(low.tolist(), length.tolist(), strict=True)]
    columns = [pa.concat_arrays([x[0] for x in held]).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(size[owner]), pa.array(sequence + base), pa.array(offset), pa.array(crc, pa.int64())]
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", *["ids"] * with_ids])
