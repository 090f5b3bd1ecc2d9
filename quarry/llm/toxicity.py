"""Toxic spans by a linear-chain conditional random field.

Labels are of documents, so the tokens' labels are latent: of a toxic document at
least one token is toxic, of a clean one none. The chain has two states and
features of each state and word: the word, its neighbours, its first and last
three bytes (all by hash), how strongly it and its neighbours mark toxic
documents (buckets of log-odds), and the step from state to state. Its weights
maximise the probability of the document labels over all ways to label the
tokens, with expectations by forward-backward: for a clean document those of the
free chain, for a toxic one those under the constraint.

Scoring runs forward-backward over each whole document. Marginals over one half
give the offending spans; the greatest and the summed marginal and the odds of
any toxic token, put through a logistic calibration on labelled documents that
the weights weren't fitted to, give the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.llm import words as W
from quarry.llm.frames import fresh, stored

#: Labelled training rows that the model is fitted on: at most so many of each label, so many bytes of each, and none of more bytes.
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 4 << 20
ROW_BYTES = 1 << 20
#: Bytes of text that are scored at once; one longer text is scored whole.
SLICE_BYTES = 1 << 20
#: Lower bounds of the log-odds buckets above 0, which is for all other words.
BUCKETS = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0])
#: Standard errors by which a word's log-odds are lowered.
DOUBT = 1.5
#: Weights of hashed features.
HASHED = 1 << 17
#: Occurrences that a hashed feature is taken to have besides its own, so that rare ones learn slowly; and how fast all do.
CAUTION, RATE, DECAY = 20.0, 1.0, 0.01
#: Words that are scanned together; the chain is exact at any value.
STRETCH = 256
#: Every fourth document of the sample is left to the calibration.
SHARE = 4

VERDICT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
_VERDICT = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int64())))])


def fold(doc_id: Column) -> Column:
    """Rows of fold 0 are held out; a null id is in none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def marginals(emit: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts as one chain that starts anew at each text.

    emit: potential of state 1 at each word (of state 0 it is 0); first: whether
    a word begins a text; steps: 2 x 2 potentials. Returns the marginals of state
    1, those of state 1 at a word and the one before it, and the logarithms of
    scales, which add up to the log of a text's partition function.

    The chain is cut into stretches that go side by side: the first pass
    multiplies each one's matrices, then its ends' vectors are known, and two
    more passes run forward and backward within it.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    wide = -(-n // STRETCH)
    pad = wide * STRETCH - n
    e = np.exp(np.clip(np.append(emit, np.zeros(pad)), -40, 40)).reshape(wide, STRETCH).T.copy()
    r = np.append(first, np.ones(pad, dtype=bool)).reshape(wide, STRETCH).T.copy()
    move = np.exp(steps)
    of = lambda t, i, j: np.where(r[t], 1.0, move[i, j]) * (e[t] if j else 1.0)

    product = [np.ones(wide), np.zeros(wide), np.zeros(wide), np.ones(wide)]
    for t in range(STRETCH):
        m00, m01, m10, m11 = of(t, 0, 0), of(t, 0, 1), of(t, 1, 0), of(t, 1, 1)
        a, b, c, d = product
        product = [a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11]
        total = sum(product)
        product = [x / total for x in product]
    matrices = np.stack(product, axis=1).tolist()
    left, right = np.zeros((wide, 2)), np.zeros((wide, 2))
    x, y = 1.0, 0.0
    for k, (a, b, c, d) in enumerate(matrices):
        left[k] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x, y = 1.0, 1.0
    for k in range(wide - 1, -1, -1):
        right[k] = x, y
        a, b, c, d = matrices[k]
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)

    f0, f1, scale = np.zeros((STRETCH + 1, wide)), np.zeros((STRETCH + 1, wide)), np.zeros((STRETCH, wide))
    f0[0], f1[0] = left.T
    for t in range(STRETCH):
        x, y = f0[t], f1[t]
        u, v = x * of(t, 0, 0) + y * of(t, 1, 0), x * of(t, 0, 1) + y * of(t, 1, 1)
        scale[t] = u + v
        f0[t + 1], f1[t + 1] = u / scale[t], v / scale[t]
    p, both = np.zeros((STRETCH, wide)), np.zeros((STRETCH, wide))
    u, v = right.T
    for t in range(STRETCH - 1, -1, -1):
        total = f0[t + 1] * u + f1[t + 1] * v
        p[t] = f1[t + 1] * v / total
        both[t] = np.where(r[t], 0.0, f1[t] * move[1, 1] * e[t] * v / scale[t] / total)
        u, v = of(t, 0, 0) * u + of(t, 0, 1) * v, of(t, 1, 0) * u + of(t, 1, 1) * v
        total = u + v
        u, v = u / total, v / total
    flat = lambda x: x.T.ravel()[:n]
    return flat(p), flat(both), np.log(flat(scale))


def indices(words: W.Words) -> np.ndarray:
    """Places of the hashed features of each word: itself, the one before, the one after, first and last three bytes."""
    h, first = words.hashes, starts(words.bounds, len(words.hashes))
    last = np.append(first[1:], True) if len(h) else first
    before, after = np.append(np.zeros(1, np.uint64), h[:-1])[: len(h)], np.append(h[1:], np.zeros(1, np.uint64))[: len(h)]
    size = words.ends - words.starts
    head, tail = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
    for k in range(3):
        there = size > k
        head[there] = head[there] * np.uint64(257) + W.fold(words.data[words.starts[there] + k]).astype(np.uint64) + np.uint64(1)
        tail[there] = tail[there] * np.uint64(257) + W.fold(words.data[words.ends[there] - 1 - k]).astype(np.uint64) + np.uint64(1)
    own = [h, np.where(first, np.uint64(0), before), np.where(last, np.uint64(0), after), head, tail]
    return np.stack([(W.mix(x ^ np.uint64(0x9E37 * (k + 1))) % np.uint64(HASHED)).astype(np.int32) for k, x in enumerate(own)])


def starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Whether each word begins a text."""
    out = np.zeros(n, dtype=bool)
    out[bounds[:-1][np.diff(bounds) > 0]] = True
    return out


def beside(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Buckets of the word before, the word, and the word after, within a text."""
    before, after = np.append(0, buckets[:-1])[: len(buckets)], np.append(buckets[1:], 0)[: len(buckets)]
    last = np.append(first[1:], True)[: len(first)]
    return np.stack([np.where(first, 0, before), buckets, np.where(last, 0, after)])


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of known words
    bucket: np.ndarray
    hashed: np.ndarray  # weights of hashed features
    near: np.ndarray  # weights of the buckets of the word before, the word, the word after
    bias: float
    steps: np.ndarray
    calibration: np.ndarray

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.bucket[at], 0) if len(self.keys) else np.zeros(len(hashes), np.int8)

    def potentials(self, places: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        out = np.full(places.shape[1], self.bias)
        for x in places:
            out += self.hashed[x]
        for k, x in enumerate(buckets):
            out += self.near[k][x]
        return out

    def tag(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of words, and scores of texts."""
        first = starts(words.bounds, len(words.hashes))
        p, _, scale = marginals(self.potentials(indices(words), beside(self.buckets(words.hashes), first)), first, self.steps)
        return p, self.scores(features(p, scale, words.bounds))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def totals(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each text, added up by itself."""
    out, full = np.zeros(len(bounds) - 1), np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(x, bounds[:-1][full])
    return out


def features(p: np.ndarray, scale: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: 1, the greatest marginal, the log of 1 + their sum, the log-odds of any toxic word."""
    size = np.diff(bounds)
    most = np.zeros(len(size))
    if len(p):
        most[size > 0] = np.maximum.reduceat(p, bounds[:-1][size > 0])
    odds = np.log(np.expm1(np.clip(totals(scale, bounds), 1e-5, 10)))
    return np.stack([np.ones(len(size)), most, np.log1p(totals(p, bounds)), odds], axis=1)


def train(texts: pa.Array, labels: np.ndarray, rounds: int = 40) -> Model:
    """Fits words, chain and calibration to labelled texts. Without texts of both labels every score is the share of label 1."""
    words = W.scan(texts, W.ALNUM)
    size = np.diff(words.bounds)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((owner, words.hashes))
    held, holder = words.hashes[order], owner[order]
    new = np.ones(len(order), dtype=bool)  # each word once in a document
    new[1:] = (held[1:] != held[:-1]) | (holder[1:] != holder[:-1])
    toxic = labels[holder[new]]
    keys, at = np.unique(held[new], return_index=True)
    n1 = np.add.reduceat(toxic, at) if len(keys) else np.zeros(0)
    n0 = np.add.reduceat(1 - toxic, at) if len(keys) else np.zeros(0)
    total1, total0 = int(labels.sum()), int((1 - labels).sum())
    low = lambda a, b: np.log((a + 0.5) / (total1 + 1)) - np.log((b + 0.5) / (total0 + 1)) - DOUBT * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    del order, held, holder, new, toxic, at
    bucket = np.searchsorted(BUCKETS, low(n1, n0), side="right").astype(np.int8)
    known = np.flatnonzero(bucket)
    near = np.zeros((3, len(BUCKETS) + 1))
    near[1, 1:] = BUCKETS
    model = Model(keys[known], bucket[known], np.zeros(HASHED), near, -5.0, np.array([[0.0, 0.0], [0.0, 1.0]]), np.zeros(4))
    if not (total1 and total0 and len(words.hashes)):
        model.calibration[0] = np.log((total1 + 0.5) / (total0 + 0.5))
        return model

    # In fitting, a document doesn't count among those that its own words are judged by.
    word, label = np.searchsorted(keys, words.hashes), labels[owner]
    buckets = np.searchsorted(BUCKETS, low(np.maximum(n1[word] - label, 0), np.maximum(n0[word] - (1 - label), 0)), side="right").astype(np.int8)
    del word, label, owner
    places, first = indices(words), starts(words.bounds, len(words.hashes))
    around = beside(buckets, first)
    fitted = np.arange(len(size)) % SHARE != SHARE - 1
    if len(np.unique(labels[fitted & (size > 0)])) < 2:
        fitted[:] = True
    own, mine = np.repeat(fitted, size), labels[fitted]
    _fit(model, places[:, own], around[:, own], first[own], np.concatenate([[0], np.cumsum(size[fitted])]), mine, rounds)

    rest = ~fitted if len(np.unique(labels[~fitted])) == 2 else np.ones(len(size), dtype=bool)
    own, mine, bounds = np.repeat(rest, size), labels[rest], np.concatenate([[0], np.cumsum(size[rest])])
    p, _, scale = marginals(model.potentials(places[:, own], around[:, own]), first[own], model.steps)
    x = features(p, scale, bounds)
    for _ in range(50):  # Newton's method with a small ridge
        s = model.scores(x)
        slope = x.T @ (mine - s) - 0.5 * model.calibration
        curve = (x * (s * (1 - s))[:, None]).T @ x + 0.5 * np.eye(x.shape[1])
        model.calibration = model.calibration + np.linalg.solve(curve, slope)
    return model


def _fit(model: Model, places: np.ndarray, around: np.ndarray, first: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int) -> None:
    """Ascends the log probability of document labels: Adam for the few dense weights, damped steps for the hashed ones."""
    size = np.diff(bounds)
    support = sum(np.bincount(x, minlength=HASHED) for x in places) + CAUTION
    dense = np.concatenate([model.near.ravel(), [model.bias], model.steps.ravel()[1:]])
    m, v = np.zeros(len(dense)), np.zeros(len(dense))
    for k in range(1, rounds + 1):
        p, both, scale = marginals(model.potentials(places, around), first, model.steps)
        # Against the free chain: a clean document has no toxic word; of a toxic one, the ways with none are ruled out.
        pull = np.where(labels == 1, 1 / np.expm1(np.clip(totals(scale, bounds), 1e-6, 700)), -1.0)
        pull = np.repeat(pull, size)
        slope = p * pull
        moved = both * pull
        entered = np.where(first, 0.0, slope) - moved
        left = np.where(first[1:], 0.0, p[:-1] * pull[1:]).sum() - moved.sum()
        dense_slope = np.concatenate([*(np.bincount(x, weights=slope, minlength=len(BUCKETS) + 1) for x in around), [slope.sum()], [entered.sum(), left, moved.sum()]]) / len(size) - 1e-3 * dense
        m, v = 0.9 * m + 0.1 * dense_slope, 0.99 * v + 0.01 * dense_slope**2
        dense = dense + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model.hashed += RATE * sum(np.bincount(x, weights=slope, minlength=HASHED) for x in places) / support - DECAY * model.hashed
        model.near, model.bias, model.steps = dense[:-4].reshape(model.near.shape), float(dense[-4]), np.append(0.0, dense[-3:]).reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> Model:
    """Fits on a bounded sample of labelled rows outside fold 0, in the order of a hash of the id.

    Of each label there are at most sample_rows rows and sample_bytes bytes in
    it, and no row of more than row_bytes; all words of the sample count. Rows
    without id, text or label are left out; of several labels of one id the
    greatest counts, of several texts of one id the least. As the sample holds
    another share of label 1 than all labelled rows, the calibration's constant
    is moved by the difference of log-odds.
    """
    known = labels.where("toxic IN (0, 1)").where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    known = stored(known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("draw", F.xxhash64("doc_id")))
    share = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    drawn = [known.where(F.col("label") == y).orderBy("draw", "doc_id").limit(sample_rows) for y in (0, 1)]
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    rows = rows.where(F.octet_length("text") <= row_bytes).groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text"))
    rows = stored(rows.withColumn("size", F.octet_length("text")))
    room, ids = [sample_bytes, sample_bytes], []
    for r in sorted(rows.select("draw", "doc_id", "label", "size").collect()):  # 2 * sample_rows at most
        room[r.label] -= r.size
        if room[r.label] >= 0:
            ids.append((r.doc_id,))
    chosen = rows.sparkSession.createDataFrame(ids, "doc_id long")
    found = rows.join(F.broadcast(chosen), "doc_id").orderBy("draw", "doc_id").select("text", "label").collect()  # 2 * sample_bytes at most
    drawn_labels = np.array([r[1] for r in found], np.int64)
    model = train(pa.array([r[0] for r in found], type=pa.string()), drawn_labels)
    ones = int(drawn_labels.sum())
    if 0 < ones < len(drawn_labels):
        model.calibration[0] += np.log(share[1] / share[0]) - np.log(ones / (len(drawn_labels) - ones))
    return model


def annotate(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """docs with a struct: score, spans (ranges of code points whose marginals are over one half).

    A null text is scored as an empty one. A text of any length is one chain;
    some 200 bytes are held for each of its words. Rows and other columns stay
    as they are; the struct's name gets underscores while a column has it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    cols = [f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text", SLICE_BYTES):
            words = W.scan(batch.column("text"), W.ALNUM)
            p, scores = held.value.tag(words)
            spans = _spans(p, words.bounds, _characters(words, W.buffer(batch.column("text"))[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([{"score": float(s), "spans": x} for s, x in zip(scores, spans, strict=True)], type=_VERDICT)], names=[*batch.schema.names, "made"])

    fields = [T.StructField(c, f.dataType) for c, f in zip(cols, docs.schema.fields, strict=True)]
    return docs.toDF(*cols).mapInArrow(run, T.StructType([*fields, T.StructField("made", VERDICT)])).toDF(*docs.columns, fresh(out, docs.columns))


def _characters(words: W.Words, bounds: np.ndarray) -> np.ndarray:
    """First and end code point of each word within its text."""
    lead = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80, dtype=np.int32)])
    base = np.repeat(lead[bounds[:-1]], np.diff(words.bounds))
    return np.stack([lead[words.starts] - base, lead[words.ends] - base], axis=1).astype(np.int32)


def _spans(p: np.ndarray, bounds: np.ndarray, ranges: np.ndarray) -> list[list[list[int]]]:
    out: list[list[list[int]]] = [[] for _ in range(len(bounds) - 1)]
    hits = np.flatnonzero(p > 0.5)
    owner = np.searchsorted(bounds, hits, side="right") - 1
    for i, (at, d) in enumerate(zip(hits.tolist(), owner.tolist(), strict=True)):
        low, high = ranges[at].tolist()
        if i and hits[i - 1] == at - 1 and owner[i - 1] == d:
            out[d][-1][1] = high
        else:
            out[d].append([low, high])
    return out


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, as they are."""
    name = fresh("toxicity", docs.columns)
    return annotate(docs, fit(docs, labels)).where(F.col(f"{name}.score") < threshold).drop(name)
