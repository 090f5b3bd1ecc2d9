import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity
from tests.llm.common import awkward, documents

BAD = ["vile", "nasty", "Foul", "rotten"]


def enumerated(emit, steps):
    """Marginals of state 1, of both a word and the one before, and the partition function, by all paths of one text."""
    n = len(emit)
    paths = {y: np.exp(sum(emit[i] * s for i, s in enumerate(y)) + sum(steps[s, t] for s, t in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=n)}
    z = sum(paths.values())
    p = sum(np.array(y) * w for y, w in paths.items()) / z
    both = sum(np.array([0, *(s * t for s, t in itertools.pairwise(y))]) * w for y, w in paths.items()) / z
    return p, both, z


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_marginals_by_enumeration(monkeypatch, stretch):
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    rng = np.random.default_rng(1)
    emit, steps, bounds = rng.normal(size=18), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 11, 18])
    p, both, scale = toxicity.marginals(emit, toxicity.starts(bounds, 18), steps)
    for a, b in itertools.pairwise(bounds):
        if b > a:
            want_p, want_both, z = enumerated(emit[a:b], steps)
            assert np.allclose(p[a:b], want_p) and np.allclose(both[a:b], want_both) and np.isclose(scale[a:b].sum(), np.log(z))


def test_long_text_is_one_chain():
    """9,000 words: the same as a plain recursion over all of them."""
    rng = np.random.default_rng(2)
    emit, steps = rng.normal(size=9000) - 1, np.array([[0.0, -3.0], [-3.0, 3.0]])
    p, _, scale = toxicity.marginals(emit, toxicity.starts(np.array([0, 9000]), 9000), steps)
    forward, log_z = np.zeros((9000, 2)), 0.0
    for t in range(9000):
        x = (forward[t - 1] @ np.exp(steps) if t else np.ones(2)) * [1, np.exp(emit[t])]
        forward[t], log_z = x / x.sum(), log_z + np.log(x.sum())
    after, want = np.ones(2), np.zeros(9000)
    for t in range(8999, -1, -1):
        both = forward[t] * after
        want[t] = both[1] / both.sum()
        after = np.exp(steps) @ (after * [1, np.exp(emit[t])])
        after /= after.sum()
    assert np.allclose(p, want) and np.isclose(scale.sum(), log_z)


def test_slope_of_the_latent_likelihood(monkeypatch):
    """The fit's dense steps go along the numerical slope of the documents' log probability."""
    rng = np.random.default_rng(3)
    emit, steps, bounds, labels = rng.normal(size=9), np.array([[0.0, 0.3], [-0.2, 0.5]]), np.array([0, 4, 9]), np.array([1, 0])
    first = toxicity.starts(bounds, 9)

    def value(emit, steps):
        z = toxicity.totals(toxicity.marginals(emit, first, steps)[2], bounds)  # the path without toxic words has potential 0
        return np.log1p(-np.exp(-z[0])) - z[1]

    p, both, scale = toxicity.marginals(emit, first, steps)
    pull = np.repeat(np.where(labels == 1, 1 / np.expm1(toxicity.totals(scale, bounds)), -1.0), np.diff(bounds))
    for i in range(9):
        d = np.zeros(9)
        d[i] = 1e-6
        assert np.isclose((value(emit + d, steps) - value(emit - d, steps)) / 2e-6, p[i] * pull[i], atol=1e-6)
    d = np.array([[0, 0], [0, 1e-6]])
    assert np.isclose((value(emit, steps + d) - value(emit, steps - d)) / 2e-6, (both * pull).sum(), atol=1e-6)


def corpus(spark, n=600):
    rng = random.Random(7)
    words = [f"mot{i}" for i in range(300)] + ["été"]
    rows, labels = [], []
    for i in range(n):
        text, bad = rng.choices(words, k=rng.randrange(5, 200)), rng.random() < 0.2
        if bad:
            for _ in range(rng.randrange(1, 6)):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(bad)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    out = toxicity.annotate(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert len(out) > 80 and all((r.toxicity.score >= 0.5) == (r.toxic == 1) for r in out)
    for r in out:
        assert " ".join(r.text[a:b] for a, b in r.toxicity.spans).split() == [w for w in r.text.split() if w in BAD]
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("toxicity", F.lit("x"))
    _, labels = corpus(spark, 20)
    for held in (labels, labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.union(labels)):
        out = toxicity.annotate(docs, toxicity.fit(docs, held))
        assert out.columns[:-1] == docs.columns
        assert all(0 <= r.toxicity_.score <= 1 for r in out.collect())
    assert toxicity.annotate(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
