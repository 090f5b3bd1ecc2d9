"""Scores of texts by a subword lattice.

The pieces of an existing vocabulary are weighted by how often its own
segmentation uses them in the training texts. The probability of a text is that
of all its segmentations together: each word, with the mark of a word's start,
is a lattice of pieces, and a forward recursion in log space sums over all
paths. Pieces don't cross words, so a text's score is the sum of its words' and
of the end's.

Beside it stands a plain count model: log10((c + 1) / (N + V + 1)) for each
word. Word counts come from all training texts. Documents are taken in blocks
of neighbouring rows of about one size, bounded in bytes: a block gives its
distinct words with their counts, these are summed over the corpus and joined
back to the blocks that hold the word, and each block scores its documents with
them. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm import tokens, words as W
from quarry.llm.frames import stored

#: Rows of a block of short texts, whose words and counts are in memory together. A text of more than the first size is in a
#: block of a sixteenth as many rows, so that a block has 64 MB at most; one of more than the second has its own.
BLOCK_ROWS, SIZES = 4096, (16 << 10, 128 << 10)
#: Words of more bytes are scored one by one; their matches are looked up for so many ends at once.
ALONE, STRETCH = 1024, 1 << 16
KEPT_WORDS = 2_000_000
MARK = "▁".encode()
ALPHA = 0.1  # added to each piece's count
_END = np.uint64(0x0123456789ABCDEF)  # the end's place among the words' hashes


def held_out(doc_id: Column) -> Column:
    """A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _segmenter(path: str) -> tuple:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    runs = tokens.Chunks(None, lambda held: tokens.flat(model.encode(held, num_threads=1)))
    return model, runs


def pieces(path: str) -> list[tuple[int, bytes]]:
    """Ids and bytes of the vocabulary's pieces; its byte pieces stand for single bytes."""
    model, _ = _segmenter(path)
    out = []
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            out.append((i, bytes([int(model.id_to_piece(i)[1:-1], 16)])))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append((i, model.id_to_piece(i).encode()))
    return out


class Lattice:
    """Log10 probabilities of words, each with all its segmentations."""

    def __init__(self, weights: dict[bytes, float]) -> None:
        """weights: natural logarithms of the pieces' probabilities."""
        held = sorted(weights, key=len)
        data, size = np.frombuffer(b"".join(held), np.uint8), np.fromiter(map(len, held), np.int64, len(held))
        ends = np.cumsum(size)
        hashes = W.hash_ranges(data, ends - size, ends, fold=False)
        order = np.argsort(hashes)
        self.keys, self.values = hashes[order], np.array([weights[x] for x in held])[order]
        self.lengths = np.unique(size).tolist()
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros(0)

    def score(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        short = [i for i, w in enumerate(words) if len(w) <= ALONE]
        for i in set(range(len(words))) - set(short):
            out[i] = self._long(words[i])
        short.sort(key=lambda i: len(words[i]))
        at = 0
        while at < len(short):
            group = short[at : at + max(1, (1 << 19) // (len(words[short[min(at + 20_000, len(short) - 1)]]) + 1))][:20_000]
            out[group] = self._forward([words[i] for i in group])
            at += len(group)
        return out / np.log(10)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and those pieces' weights."""
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        found = np.flatnonzero(self.keys[at] == hashes)
        return found, self.values[at[found]]

    def _long(self, word: bytes) -> float:
        """The same recursion over one word of any length; of its states only those are held that a piece can reach."""
        most = max(x for x in self.lengths if x <= len(word))
        lengths = [x for x in self.lengths if x <= most]
        up, down = W.powers(W.HASH_BLOCK)
        alpha = [-np.inf] * most + [0.0]  # of the last places up to the stretch's start
        for base in range(0, len(word), STRETCH):
            low = max(base - most, 0)
            data = W.byte_values(np.frombuffer(word[low : base + STRETCH], np.uint8))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(data * up[: len(data)], out=sums[1:])
            ends, sizes, weights = [], [], []
            for length in lengths:
                end = np.arange(max(base - low + 1, length), len(data) + 1)
                found, value = self._find(W.mix((sums[end] - sums[end - length]) * down[end - length]))
                ends.append(end[found])
                sizes.append(np.full(len(found), length))
                weights.append(value)
            end, size, weight = np.concatenate(ends), np.concatenate(sizes), np.concatenate(weights)
            order = np.argsort(end, kind="stable")
            first = np.searchsorted(end[order], np.arange(base - low + 1, len(data) + 2)).tolist()
            size, weight = size[order].tolist(), weight[order].tolist()
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                terms = [alpha[most + 1 + k - size[j]] + weight[j] for j in range(a, b)]
                top = max(terms, default=-np.inf)
                alpha.append(top + math.log(sum(math.exp(x - top) for x in terms)) if top > -np.inf else top)
            alpha = alpha[-most - 1 :]
        return alpha[-1]

    def _forward(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithms; words in ascending length."""
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        most = int(size.max())
        data = np.zeros((n, most), np.uint8)
        data[np.arange(most) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        up, down = W.powers(W.HASH_BLOCK)
        sums = np.zeros((n, most + 1), np.uint64)
        np.cumsum(W.byte_values(data) * up[:most], axis=1, out=sums[:, 1:])
        alpha = np.full((n, most + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, most + 1):
            live = np.flatnonzero(size >= end)
            best = np.full(len(live), -np.inf)
            for length in self.lengths:
                if length > end:
                    break
                hashes = W.mix((sums[live, end] - sums[live, end - length]) * down[end - length])
                found, value = self._find(hashes)
                if len(found):
                    best[found] = np.logaddexp(best[found], alpha[live[found], end - length] + value)
            alpha[live, end] = best
        return alpha[np.arange(n), size]

    def of(self, hashes: np.ndarray, word) -> np.ndarray:
        """Scores of distinct words by their hashes; word(i) gives the bytes of those that aren't kept yet."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.scores = np.zeros(0, np.uint64), np.zeros(0)
        new = np.flatnonzero(~W.has(self.known, hashes))
        if len(new):
            new = new[np.argsort(hashes[new])]
            made = self.score([MARK + word(i) for i in new.tolist()])
            at = np.searchsorted(self.known, hashes[new])
            self.known, self.scores = np.insert(self.known, at, hashes[new]), np.insert(self.scores, at, made)
        return self.scores[np.searchsorted(self.known, hashes)]


def _distinct(texts: pa.Array) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, lower-cased; the distinct one of each word; the hash and first place of distinct ones."""
    words = W.scan(texts, W.NONSPACE)
    words.data = W.fold(words.data)
    inverse, distinct = pd.factorize(words.hashes)
    first = np.empty(len(distinct), np.int64)
    first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
    return words, inverse, distinct, first


def _gather(path: str):
    """Rows of block, h, n: the training count of each distinct word of a block; with block -1, that of each piece."""

    def rows(block: int, texts: pa.Array, train: np.ndarray) -> pa.RecordBatch:
        words, inverse, distinct, first = _distinct(texts)
        size = np.diff(words.bounds)
        n = np.bincount(inverse, weights=np.repeat(train, size), minlength=len(distinct)).astype(np.int64)
        _, runs = _segmenter(path)
        used = np.flatnonzero(n)
        used = used[np.argsort(first[used])]
        slot = runs.slots(words.data, words.starts[first[used]], words.ends[first[used]])
        place, owner = W.positions(runs.start[slot], runs.size[slot])
        count = np.bincount(runs.pool[place], weights=n[used][owner]).astype(np.int64) if len(place) else np.zeros(0, np.int64)
        seen = np.flatnonzero(count)
        blocks = np.concatenate([np.full(len(distinct) + 1, block), np.full(len(seen), -1)])
        hashes = np.concatenate([distinct, [_END]]).astype(np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.concatenate([hashes, seen])), pa.array(np.concatenate([n, [int(train.sum())], count[seen]]))], names=["block", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {0: [], 1: [], 2: []}  # by size
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            for kind in np.unique(blocks & 3).tolist():
                own = np.flatnonzero((blocks & 3) == kind)
                part, number = batch.take(pa.array(own)), blocks[own]
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(own)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if held[kind] and held[kind][0].column("block")[0].as_py() != number[a]:
                        yield whole(held[kind])
                        held[kind] = []
                    held[kind].append(part.slice(a, b - a))
        for rows in held.values():
            if rows:
                yield whole(rows)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return rows(table["block"][0].as_py(), table["text"].combine_chunks(), ~table["held_out"].to_numpy())

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, path: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs must read the same again, as tables do; a block that holds other words
    than before is an error. Texts are lower-cased (A-Z); a null or empty one is
    the end alone. Very long texts have blocks of their own and very long words
    are scored whole. Repeated rows count and are scored each. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size, few = F.octet_length("text"), max(block_rows // 16, 1)
    first = lambda n: F.expr(f"(rid div {n}) * {n} * 4")
    block = F.when(size <= SIZES[0], first(block_rows)).when(size <= SIZES[1], first(few) + 1).otherwise(first(1) + 2)
    rows = rows.select(block.alias("block"), "doc_id", "held_out", "text")
    seen = stored(rows.select("block", "held_out", "text").mapInArrow(_gather(path), "block long, h long, n long"))
    counts = stored(seen.where("block >= 0").groupBy("h").agg(F.sum("n").alias("c")))
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    used = {r.h: r.n for r in seen.where("block = -1").groupBy("h").agg(F.sum("n").alias("n")).collect()}  # at most a row for each piece
    ends = (counts.where(F.col("h") == int(_END.view(np.int64))).first() or {"c": 0})["c"]
    own = pieces(path)
    mass = sum(used.get(i, 0) + ALPHA for i, _ in own) + ends + ALPHA
    weights: dict[bytes, float] = {}
    for i, text in own:
        weights[text] = np.logaddexp(weights.get(text, -np.inf), np.log((used.get(i, 0) + ALPHA) / mass))
    end_score = float(np.log10((ends + ALPHA) / mass))
    held = spark.sparkContext.broadcast(weights)  # as many as the vocabulary has pieces
    key, base = uuid.uuid4().hex, float(total + kinds + 1)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        lattice = _lattice(key, held)
        order = np.argsort(right["h"].to_numpy())
        keys, count = right["h"].to_numpy()[order], right["c"].to_numpy()[order]
        out = []
        for part in W.sliced(iter(left.combine_chunks().to_batches()), "text"):
            words, inverse, distinct, first = _distinct(part.column("text"))
            if not W.has(keys, distinct.view(np.int64)).all():
                raise ValueError("the documents were read in another order than before")
            c = count[np.searchsorted(keys, distinct.view(np.int64))] if len(distinct) else np.zeros(0, np.int64)
            data = words.data.tobytes()
            marginal = lattice.of(distinct, lambda i: data[words.starts[first[i]] : words.ends[first[i]]]) if len(distinct) else np.zeros(0)
            n = np.diff(words.bounds)
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.bounds])
            fit = lambda c: np.log10((c + 1) / base)
            columns = [part.column("doc_id"), part.column("held_out"), n + 1, sums((c > 0)[inverse].astype(np.int64)) + (ends > 0), np.full(len(n), total), _sums(fit(c)[inverse], words.bounds) + fit(ends), _sums(marginal[inverse], words.bounds) + end_score]
            out.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[f.split()[0] for f in SCHEMA.split(", ")]))
        return pa.Table.from_batches(out, schema=out[0].schema) if out else pa.table({f.split()[0]: pa.array([], t) for f, t in zip(SCHEMA.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    back = seen.where("block >= 0").join(counts, "h").select("block", "h", "c")
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(block, SCHEMA)


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ranges, each added up by itself, so that rounding doesn't depend on what else is there."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full])
    return out


_made: dict[str, Lattice] = {}


def _lattice(key: str, weights) -> Lattice:
    """This worker's lattice of a broadcast vocabulary; what it has scored serves later blocks too."""
    if key not in _made:
        _made.clear()
        _made[key] = Lattice(weights.value)
    return _made[key]
