import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import jaccard
from tests.llm.common import awkward, documents


def shingle_set(text):
    w = [x for x in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(texts):
    sets = [shingle_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(texts):
        r = find(i)
        least[r] = min(least.get(r, key), key)
    return sorted((key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(texts))


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = rng.choices(vocabulary, k=60)
    base = [rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 40, 120, 200])) for _ in range(12)]
    texts = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words + passage
        if rng.random() < 0.2:
            words = words[rng.randrange(len(words)) :]
        text = " ".join(words)
        texts.append((i, text.upper() if rng.random() < 0.1 else text))
    return texts + [(n, ""), (n + 1, None), (n + 2, " "), (n + 3, "w1 w2"), (n + 4, "W1\tw2")]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1024), (2, 5)])
def test_same_as_brute_force(spark, tmp_path, seed, chunk):
    texts = corpus(seed)
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "d"))
    out = jaccard.classes(spark.read.parquet(str(tmp_path / "d")), chunk).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_force(texts)


def test_pairs_at_the_limit(spark, tmp_path):
    """A set and 0.8 of it, in all sizes, beside others that share a part."""
    rng, texts = random.Random(4), []
    for n in range(6, 130, 3):
        words = [f"{n}x{i}" for i in range(n)]
        k = -(-4 * (n - 4) // 5) + 4  # words of 0.8 of the shingles
        texts += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[:k])), (10 * n + 2, " ".join(words[n - k + 1 :])), (10 * n + 3, " ".join(words[: n // 2] + [f"{n}y{i}" for i in range(n)]))]
    rng.shuffle(texts)
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "d"))
    out = jaccard.classes(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_force(texts)


def test_recursion_is_exact():
    splits = 0
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = [rng.integers(0, 2**63, rng.integers(5, 60), dtype=np.uint64) for _ in range(4)]
        sets = []
        for _ in range(70):
            s = base[rng.integers(4)].copy()
            k = rng.integers(0, max(1, len(s) // 3))
            s[rng.integers(0, len(s), k)] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(s))
        fast, slow = jaccard.Region(sets), jaccard.Region(sets)
        fast.join(list(range(70)))
        links, _ = jaccard.overlaps(sets, sets)
        for i, j in zip(*np.nonzero(links), strict=True):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert 5 * len(a & b) >= 4 * len(a | b)
            slow.link(i, j)
        assert [fast.find(i) for i in range(70)] == [slow.find(i) for i in range(70)]
        splits += fast.splits
    assert splits >= 20


def test_rounds_of_large_regions(spark, tmp_path):
    """All texts hold common passages, so that regions are large and overlap; ids are joined by a shuffle."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    base = [passage + [f"b{k}x{i}" for i in range(rng.choice([8, 15, 60]))] for k in range(9)]
    texts = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"r{rng.randrange(30)}"
        texts.append((i, " ".join(words)))
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "d"))
    out = jaccard.classes(spark.read.parquet(str(tmp_path / "d")), chunk=6, pivots=2, broadcast_ids=0).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_force(texts)


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("rid", F.lit(1)).withColumn("h", F.lit("x"))
    rows = {(r.doc_id, r.component_id) for r in jaccard.classes(docs).collect()}
    assert rows == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7), (None, None), (8, 4), (9, 9)}
    left = jaccard.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == docs.count() - 2
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.deduplicate(docs.limit(0)).count() == 0
