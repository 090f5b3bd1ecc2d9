import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import lattice, tokens
from tests.llm.common import awkward, documents

PATH = tokens.vocabulary("piece_bpe_32k.model")


def enumerate_all(word, weights):
    """The probability of a word by all its segmentations."""
    if not word:
        return 1.0
    return sum(math.exp(weights[word[:n]]) * enumerate_all(word[n:], weights) for n in range(1, len(word) + 1) if word[:n] in weights)


def test_all_segmentations():
    rng = random.Random(3)
    weights = {bytes([b]): -6.0 for b in range(256)} | {w: -rng.random() * 5 for w in [lattice.MARK, lattice.MARK + b"a", b"a", b"aa", b"ab", b"ba", b"bab", "é".encode(), b"a" * 7]}
    words = [lattice.MARK + w for w in [b"a", b"aaab", b"babab", "é".encode(), b"aaaaaaaaa", b"x", b"abab"]]
    got = lattice.Lattice(weights).score(words)
    assert np.allclose(got, [math.log10(enumerate_all(w, weights)) for w in words])


def one_by_one(word, weights):
    """The probability's logarithm by the plain recursion over every place of a word."""
    most, alpha = max(map(len, weights)), [0.0]
    for end in range(1, len(word) + 1):
        terms = [alpha[end - n] + weights[word[end - n : end]] for n in range(1, min(most, end) + 1) if word[end - n : end] in weights]
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha[-1] / math.log(10)


def test_long_words_are_scored_whole(monkeypatch):
    """Words of 5,000 bytes and more, also across the stretches in which matches are looked up."""
    rng = random.Random(5)
    weights = {bytes([b]): -7.0 for b in range(256)} | {w: -rng.random() * 5 for w in [lattice.MARK, b"a", b"aa", b"ab", b"ba", b"bab", b"a" * 7, b"abba" * 5]}
    words = [lattice.MARK + bytes(rng.choice(b"ab") for _ in range(n)) for n in (lattice.ALONE - 3, lattice.ALONE - 2, 5000, 9001)] + [b"a" * 6000]
    want = [one_by_one(w, weights) for w in words]
    assert np.allclose(lattice.Lattice(weights).score(words), want)
    monkeypatch.setattr(lattice, "STRETCH", 700)
    monkeypatch.setattr(lattice, "ALONE", 0)
    assert np.allclose(lattice.Lattice(weights).score(words), want)


def brute_force(texts):
    words = lambda t: [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in texts if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in texts}


def test_same_as_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["the", "The", "été", "x,", "thing", "日本", "a" * 5000] + [f"w{i}" for i in range(200)]
    texts = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(150)] + [(200, None), (201, ""), (202, "the"), (202, "the"), (None, "the")]
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(lattice, "SIZES", (100, 5000))  # blocks of all sizes
    out = lattice.score(docs, PATH, block_rows=32).collect()
    assert len(out) == len(texts)
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out} == brute_force(texts)
    assert all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert len({r.score for r in out if r.doc_id in (200, 201)}) == 1
    want = marginal(texts)
    assert all(math.isclose(r.score, want[r.doc_id, r.n_tokens], rel_tol=1e-6) for r in out)


def marginal(texts):
    """Scores of texts by doc_id and tokens: weights from the vocabulary's own segmentation of the training words, then the plain recursion."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    words = lambda t: [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    train = [t for i, t in texts if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    used = Counter(p for t in train for w in words(t) for p in model.encode(w))
    own = lattice.pieces(PATH)
    mass, weights = sum(used[i] + lattice.ALPHA for i, _ in own) + len(train) + lattice.ALPHA, {}
    for i, text in own:
        weights[text] = np.logaddexp(weights.get(text, -np.inf), math.log((used[i] + lattice.ALPHA) / mass))
    one = {w: one_by_one(lattice.MARK + w.encode(), weights) for w in {w for _, t in texts for w in words(t)}}
    return {(i, len(words(t)) + 1): sum(one[w] for w in words(t)) + math.log10((len(train) + lattice.ALPHA) / mass) for i, t in texts}


def test_likelier_than_shuffled(spark):
    rng = random.Random(9)
    parts = ["ing", "the", "tion", "er", "and", "re", "on", "st"]
    texts = [(i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(50))) for i in range(100)]
    mixed = [(1000 + i, " ".join("".join(rng.sample(w, len(w))) for w in t.split())) for i, t in texts]
    r = {r.new: r.s for r in lattice.score(documents(spark, texts + mixed), PATH).groupBy((F.col("doc_id") < 1000).alias("new")).agg(F.sum("score").alias("s")).collect()}
    assert r[True] > r[False]


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("block", F.lit("x")).withColumn("h", F.lit(1))
    assert lattice.score(docs, PATH).count() == docs.count()
    assert lattice.score(docs.limit(0), PATH).count() == 0
