"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The encoding of a prefix ends with one token; what stands before that token is
the encoding of a shorter prefix. A byte-pair encoding is valid if each pair of
neighbours is, so the last token of prefix i is the one token t ending there
that is valid after the last token of prefix i - |t|, and

    count[i] = count[i - |t|] + 1

The count of a text's prefix is the count where its chunk begins plus the count
within the chunk, so questions about truncation and budgets need no encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.llm import tokens, words as W
from quarry.llm.frames import fresh

LIMIT = 512
#: Pairs and words that a worker remembers; beyond it starts anew.
KEPT_PAIRS = 1_000_000
KEPT_MARKS = 100_000

#: Characters that the pattern of byte-level tokenizers takes as white space, and its contractions.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = ("'re", "'ve", "'ll")

_PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space, letters, marks: three pre-tokens at most, whatever stands around.
_EASY = re.compile(r"([ \n]?)(\w+)([!-&(-/:-@\[-`{-~]*)")
_LEADING = re.compile(f"[{SPACE}]*")


class PrefixCounter:
    """Counts of all prefixes (in code points) of texts, for a byte-level tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        self.tokenizer = tokens.tokenizer(path)
        self.model = self.tokenizer.model
        mapped = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters: dict[int, str] = {}  # of bytes, in the vocabulary's strings
        for c in map(chr, [*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000)]):
            self.letters.update(zip(c.encode(), mapped.pre_tokenize_str(c)[0][0], strict=True))
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.vocab = {t for t in self.tokenizer.get_vocab() if t not in special}
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.marks: dict[str, list[int]] = {}
        self.before: tuple[str, list[str], list[int]] = ("", [""], [0])

    def _valid(self, before: str, token: str) -> bool:
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[before, token] = [t.value for t in self.model.tokenize(before + token)] == ([before, token] if before else [token])
        return known

    def word(self, text: str) -> list[int]:
        """One pre-token, all prefixes of which are pre-tokens too: the counts of its prefixes.

        What it has in common with the last word isn't computed again.
        """
        mapped = text.encode().decode("latin-1").translate(self.letters)
        old, last, count = self.before
        n, same = min(len(old), len(mapped)), 0
        while same < n and old[same] == mapped[same]:
            same += 1
        del last[same + 1 :], count[same + 1 :]
        vocab, pairs, longest = self.vocab, self.pairs, self.longest
        for i in range(same + 1, len(mapped) + 1):
            for start in range(i - longest if i > longest else 0, i):
                token = mapped[start:i]
                if token in vocab:
                    known = pairs.get((last[start], token))
                    if known or known is None and self._valid(last[start], token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
        self.before = (mapped, last, count)
        if len(mapped) == len(text):
            return count[1:]
        return [count[i] for i in accumulate(len(c.encode()) for c in text)]

    def mark(self, text: str) -> list[int]:
        """word() for what isn't letters, much of which comes again and again."""
        if (out := self.marks.get(text)) is None:
            if len(self.marks) > KEPT_MARKS:
                self.marks.clear()
            held, self.before = self.before, ("", [""], [0])
            out = self.marks[text] = self.word(text)
            self.before = held
        return out

    def __call__(self, chunk: str) -> list[int]:
        """A text, or a part of one that begins where the pattern cuts in any case."""
        out: list[int] = []
        at = 0
        for m in self.special.finditer(chunk) if self.special else ():
            if m.end() > m.start():
                self._plain(chunk[at : m.start()], out)
                # before it is whole, a special string is ordinary text
                self._plain(m[0], part := [])
                base, tail = (out[-1] if out else 0), self._joined(chunk[at : m.start()], m[0], out, at)
                out += tail or [base + x for x in part]
                out[-1] = base + 1
                at = m.end()
        self._plain(chunk[at:], out)
        return out

    def _joined(self, before: str, special: str, out: list[int], at: int) -> list[int]:
        """Counts of prefixes that end within a special string, which then is text like that before it."""
        if not before:
            return []
        base = out[at - 1] if at else 0
        self._plain(before + special, whole := [])
        return [base + x for x in whole[len(before) :]]

    def _plain(self, text: str, out: list[int]) -> None:
        for m in _PARTS.finditer(text):
            base, part = (out[-1] if out else 0), m[0]
            if easy := _EASY.fullmatch(part):
                lead, body, tail = easy.groups()
                if body.isalpha():
                    counts = [1, *(x + 1 for x in self.word(body))] if lead == "\n" else self.word(lead + body)
                    if tail:
                        done = counts[-1]
                        counts += [done + x for x in self.mark(tail)]
                    out += [base + x for x in counts] if base else counts
                    continue
            lead = _LEADING.match(part).end()
            if lead:
                out += [base + x for x in self.mark(part[:lead])]
            done = 0
            for word, (start, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                source = part[start:end]
                counts = [1, 2, len(self.model.tokenize(word))] if source in CONTRACTIONS else self.word(source)
                out += [base + done + x for x in counts[max(0, lead - start) :]]
                done += counts[-1]


@lru_cache(maxsize=1)
def counter(path: str) -> tokens.Chunks:
    """This worker's counts of chunks; what it has learned serves later tasks too."""
    own = PrefixCounter(path)

    def make(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out: list[list[int]] = [[]] * len(chunks)
        for i in sorted(range(len(chunks)), key=chunks.__getitem__):  # neighbours have the most in common
            out[i] = own(chunks[i])
        return tokens.flat(out)

    return tokens.Chunks(tokens.before_spaces, make)


VERDICT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def _pass(docs: DataFrame, path: str, name: str, kind: T.DataType, make) -> DataFrame:
    """docs with a column that make(bytes of each text, counts of all prefixes, bounds) gives."""
    cols = [f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = counter(path)
        for batch in W.sliced(batches, "text"):
            counts, by_text, by_chunk = chunks.of(batch.column("text"))
            size = np.diff(by_chunk)
            last = np.where(size > 0, counts[by_chunk[1:] - 1], 0).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(last)])
            first = total[:-1] - np.repeat(total[by_text[:-1]], np.diff(by_text))  # tokens of the text before the chunk
            counts = counts + np.repeat(first, size)
            n_bytes = np.diff(W.buffer(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, make(n_bytes, counts, by_chunk[by_text])], names=[*batch.schema.names, "made"])

    fields = [T.StructField(c, f.dataType) for c, f in zip(cols, docs.schema.fields, strict=True)]
    return docs.toDF(*cols).mapInArrow(run, T.StructType([*fields, T.StructField("made", kind)])).toDF(*docs.columns, name)


def annotate(docs: DataFrame, path: str, limit: int = LIMIT, out: str = "tokens") -> DataFrame:
    """docs with a struct: n_bytes, n_tokens, fit_chars (the longest prefix of at most limit tokens), over_limit.

    A null text counts as empty: no bytes, no tokens. Rows and their other
    columns stay as they are; the struct's name gets underscores while a column has it.
    """

    def make(n_bytes: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.Array:
        size = np.diff(bounds)
        n = np.zeros(len(size), np.int64)
        n[size > 0] = counts[bounds[1:][size > 0] - 1]
        fits = np.flatnonzero(counts <= limit)
        at = np.searchsorted(fits, bounds[1:]) - 1  # the last prefix that fits
        fit = np.where(at >= 0, fits[np.maximum(at, 0)] + 1 - bounds[:-1], 0) if len(fits) else np.zeros(len(size), np.int64)
        return pa.StructArray.from_arrays([pa.array(n_bytes), pa.array(n), pa.array(np.maximum(fit, 0)), pa.array(n > limit)], names=["n_bytes", "n_tokens", "fit_chars", "over_limit"])

    return _pass(docs, path, fresh(out, docs.columns), VERDICT, make)


def prefix_table(docs: DataFrame, path: str, out: str = "prefix_tokens") -> DataFrame:
    """docs with an array: the token count of each prefix, from one code point to all of the text.

    A null or empty text has an empty array. Rows, repeated ones too, and other columns stay as they are; a clashing name gets
    underscores; an empty table gives no rows. A very long text has as long an array.
    """

    def make(n_bytes: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(counts.astype(np.int32)))

    return _pass(docs, path, fresh(out, docs.columns), T.ArrayType(T.IntegerType()), make)


def tokens_of_prefix(table: str | Column, n_chars: Column) -> Column:
    """Tokens of the first n_chars code points, from prefix_table's array."""
    return F.coalesce(F.get(table, (F.least(n_chars, F.size(table)) - 1).cast("int")), F.lit(0))


def longest_prefix(table: str | Column, budget: int) -> Column:
    """Code points of the longest prefix of at most budget tokens, from prefix_table's array."""
    table = F.col(table) if isinstance(table, str) else table
    fits = F.transform(table, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))
