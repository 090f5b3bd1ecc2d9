"""Word scanning and hashing over Arrow string buffers, vectorised with numpy.

Every function works on a slice of an Arrow batch of bounded size, so that the
memory of a task doesn't depend on how many documents its partition holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
HASH_BLOCK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32

#: Bytes of words. Multi-byte UTF-8 characters have bytes >= 0x80 only, so byte classes suffice.
ALNUM = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
NONSPACE = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _FOLD[data]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: np.uint64) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(_BASE), of(_BASE_INV)


@dataclass
class Words:
    """Words of some texts: byte ranges in data, the hash of each, and for each text its range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i]:bounds[i + 1]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together and the bounds of each; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into such of about limit bytes of text; one longer text stays whole."""
    for batch in batches:
        _, bounds = buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of ascending byte ranges, by prefix sums of byte values times powers of an odd base."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = max(int(np.searchsorted(ends, starts[at] + HASH_BLOCK, side="right")), at + 1)
        low, high = int(starts[at]), int(ends[end - 1])
        up, down = powers(max(HASH_BLOCK, 1 << int(high - low).bit_length()))
        part = data[low:high]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_FOLD[part] if fold else part] * up[: len(part)], out=sums[1:])
        out[at:end] = (sums[ends[at:end] - low] - sums[starts[at:end] - low]) * down[starts[at:end] - low]
        at = end
    return mix(out)


def scan(texts: pa.Array, inside: np.ndarray) -> Words:
    """Words of lower-cased (A-Z only) texts as runs of the bytes in a class."""
    data, bounds = buffer(texts)
    word = inside[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, starts, ends, hash_ranges(data, starts, ends), np.searchsorted(starts, bounds))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def gram_bounds(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First position and number of the k-grams that lie within each text."""
    return bounds[:-1], np.maximum(np.diff(bounds) - k + 1, 0)


def positions(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expands ranges: all positions, and the range of each."""
    owner = np.repeat(np.arange(len(count)), count)
    shift = np.repeat(first - (np.cumsum(count) - count), count)
    return np.arange(len(owner)) + shift, owner


def has(array: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array."""
    if not len(array):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(array, values)
    at[at == len(array)] = 0
    return array[at] == values
