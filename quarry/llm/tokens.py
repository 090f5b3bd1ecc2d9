"""Exact token ids of whole texts through the tokenizers library.

A text is cut into chunks where its pre-tokenizer cuts in any case, and each
distinct chunk of a slice is encoded once and kept. Chunks are told apart by
64-bit hashes.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa

from quarry.llm import words as W

#: Chunks whose ids a worker keeps at most between slices.
KEPT_CHUNKS = 1_000_000
#: Chunks that are encoded as one text, parted by a special token.
JOINED = 4096


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for tokenizers that drop white space: runs without ASCII white space."""
    word = W.NONSPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def before_spaces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks for byte-level tokenizers: cut at each ASCII white space after a character that surely isn't white space.

    Such a tokenizer's pattern never joins white space to what stands before
    it, so the chunks cover the text and are encoded independently. After a
    character that might be Unicode white space no cut is made.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(~W.NONSPACE[data[1:]]) + 1
    before = data[at - 1]
    ascii_ = (before > 0x20) & (before < 0x7F)
    second = data[np.maximum(at - 2, 0)]
    third = data[np.maximum(at - 3, 0)]
    wide = (before >= 0x80) & (second != 0xC2) & ~np.isin(third, [0xE1, 0xE2, 0xE3])
    first = np.zeros(len(data), dtype=bool)
    first[at[ascii_ | wide]] = True
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data))


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All integers of some lists, and the lists' sizes."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size


class Chunks:
    """Keeps a sequence of integers for each distinct chunk; beyond KEPT_CHUNKS the more used half stays."""

    def __init__(self, cut, make, kept: int = KEPT_CHUNKS) -> None:
        """cut: chunks' ranges in bytes of texts; make: for some chunks, all their integers and how many each has."""
        self.cut, self.make, self.kept = cut, make, kept
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def evict(self) -> None:
        """Leaves the more used half; uses count half from now on."""
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.kept // 2])
        place, _ = W.positions(self.start[stay], self.size[stay])
        self.pool, self.filled = self.pool[place], len(place)
        self.keys, self.size, self.used = self.keys[stay], self.size[stay], self.used[stay] // 2
        self.start = np.cumsum(self.size) - self.size

    def add(self, keys: np.ndarray, used: np.ndarray, made: np.ndarray, size: np.ndarray) -> None:
        """Takes in new chunks, in ascending order of their keys."""
        if self.filled + len(made) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + len(made), np.uint32)])
        self.pool[self.filled : self.filled + len(made)] = made
        at = np.searchsorted(self.keys, keys)
        start = self.filled + np.cumsum(size) - size
        self.filled += len(made)
        self.keys, self.start, self.size, self.used = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.start, start), (self.size, size), (self.used, used)))

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each chunk in start and size, after making those that are new."""
        hashes = W.hash_ranges(data, starts, ends, fold=False)
        inverse, distinct = pd.factorize(hashes)
        index = np.empty(len(distinct), np.int64)
        index[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        used = np.bincount(inverse, minlength=len(distinct))
        order = np.argsort(distinct)
        if len(self.keys) > self.kept:
            self.evict()
        known = W.has(self.keys, distinct[order])
        self.used[np.searchsorted(self.keys, distinct[order[known]])] += used[order[known]]
        new = order[~known]
        if len(new):
            raw, at = data.tobytes(), index[new]
            made, size = self.make([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self.add(distinct[new], used[new], made, size)
        slot = np.empty(len(distinct), np.int64)
        slot[order] = np.searchsorted(self.keys, distinct[order])
        return slot[inverse]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All integers of the texts' chunks, the bounds of each text in chunks, the chunks' bounds in integers."""
        data, bounds = W.buffer(texts)
        starts, ends = self.cut(data, bounds)
        slot = self.slots(data, starts, ends)
        size = self.size[slot]
        place, _ = W.positions(self.start[slot], size)
        return self.pool[place], np.searchsorted(starts, bounds), np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=2)
def encoder(path: str, cut) -> Encoder:
    """This worker's encoder; what it has learned serves later tasks too."""
    return Encoder(path, cut)


class Encoder:
    """Ids of texts, as the tokenizer's own encode gives them without added special tokens."""

    def __init__(self, path: str, cut) -> None:
        self.tokenizer = tokenizer(path)
        self.chunks = Chunks(cut, self._encode)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark = next(((i, x.content) for i, x in sorted(added.items()) if x.special and not (x.normalized or x.lstrip or x.rstrip or x.single_word)), None)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks. A special token parts a text before all else, so chunks may stand between such tokens."""
        ids, sizes = [], []
        for a in range(0, len(chunks), JOINED):
            held = chunks[a : a + JOINED]
            text = self.mark[1].join(held) if self.mark else ""
            if self.mark and text.count(self.mark[1]) == len(held) - 1:
                out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                bounds = np.concatenate([[-1], np.flatnonzero(out == self.mark[0]), [len(out)]])
                ids.append(np.delete(out, bounds[1:-1]))
                sizes.append(np.diff(bounds) - 1)
            else:  # a chunk that holds the token itself
                out, size = flat([x.ids for x in self.tokenizer.encode_batch_fast(held, add_special_tokens=False)])
                ids.append(out)
                sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's; end is put after each text."""
        ids, by_text, by_chunk = self.chunks.of(texts)
        bounds = by_chunk[by_text]
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))
