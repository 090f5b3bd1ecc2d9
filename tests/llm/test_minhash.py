"""b-bit MinHash against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import jaccard, minhash
from tests.llm.common import awkward, documents
from tests.llm.test_jaccard import shingle_set


def brute(texts, percent=85):
    """Of (doc_id, text): doc_id, size, smallest linked doc_id."""
    sets = [shingle_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(texts):
        ids.setdefault(find(i), []).append(d)
    low = {r: min((x for x in held if x is not None), default=None) for r, held in ids.items()}
    return [(d, len(sets[i]), low[find(i)] if sets[i] else d) for i, (d, _) in enumerate(texts)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def near_copies(n, seed=3, words=120, edits=4):
    """A chain of edits of one text, so that the ends of a group don't link with each other, beside groups just below the threshold."""
    rng = random.Random(seed)
    held = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(held)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        if rng.random() < 0.3:
            held = own
        out.append((1000 + i, " ".join(own)))
    rng.shuffle(out)
    return out


def found(spark, texts, **how):
    rows = minhash.classes(documents(spark, texts), **how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key)


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.85, 1.0):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
            inner = int(round(share * 400))
            rest = (400 - inner) // 2
            sets = [np.unique(np.concatenate([both[:inner], both[inner : inner + rest]])), np.unique(np.concatenate([both[:inner], both[inner + rest :]]))]
            hashes = np.concatenate(sets)
            signature = minhash.packed(minhash.minima(hashes, np.array([0, len(sets[0])]))).view(np.uint64)
            true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
            errors.append(float(minhash.estimates(signature[0], signature[1])) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_bands_agree_where_five_minima_do():
    rng = np.random.default_rng(2)
    low = rng.integers(0, 2**32, (2, minhash.MINIMA), dtype=np.uint64)
    low[1, 10:15] = low[0, 10:15]
    same = minhash.bands(low)
    assert [i for i in range(minhash.BANDS) if same[0, i] == same[1, i]] == [2]


def test_awkward(spark):
    docs = awkward(spark)
    rows = minhash.classes(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key) == sorted(brute(texts), key=key)
    assert minhash.classes(docs.limit(0)).collect() == [] and minhash.classes(docs.limit(0)).columns[:5] == ["rid", "doc_id", "n_shingles", "component_id", "kept"]


def test_extra_columns_and_deduplicate(spark):
    texts = [(3, "a b c d e f g"), (1, "A B C D E F G"), (2, None), (5, ""), (4, "a b c d e f g")]
    docs = documents(spark, texts).selectExpr("*", "1 AS rid", "'x' AS label", "2 AS bucket", "3 AS n", "4 AS salt")
    out = minhash.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 5]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_groups(spark, chunk):
    texts = near_copies(70) + near_copies(40, 5, 60, 6) + near_copies(40, 9, 30, 3) + [(i, f"one two three four five six seven {i}") for i in range(9)]
    texts += [(2000 + i, texts[i][1]) for i in range(20)] + [(3000, None), (3001, ""), (None, texts[3][1])]
    assert found(spark, texts, chunk=chunk) == sorted(brute(texts), key=key)


def rows_of(texts, **more):
    """A group as a task gets it."""
    hashes, bounds = jaccard.shingles(pa.array(texts))
    low = minhash.minima(hashes, bounds[:-1])
    n = len(texts)
    held = {"id": list(range(n)), "n": np.diff(bounds), "s1": minhash._add(minhash.W.mix(hashes), bounds), "signature": [bytes(x) for x in minhash.packed(low)], "text": texts, "label": list(range(n)), "role": [0] * n}
    return pa.table(held | more)


def test_other_texts_than_before():
    with pytest.raises(ValueError):
        minhash._comparer(85, True)(rows_of(["a b c d e f g", "a b c d e f h"], text=["a b c d e f g", "a b c d e f i"]))


def test_a_task_returns_what_connects():
    texts = [t for _, t in near_copies(60)]
    found = minhash._comparer(85, True)(rows_of(texts)).to_pylist()
    sets = [shingle_set(t) for t in texts]
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    assert all(link(r["a"], r["b"]) for r in found)
    want = brute(list(enumerate(texts)))
    assert len(found) == len(texts) - len({c for _, _, c in want})
    assert minhash._comparer(85, True)(rows_of(texts, label=[0] * 60)).num_rows == 0
    parted = minhash._comparer(85, True)(rows_of(texts, role=[1] * 30 + [2] * 30)).to_pylist()
    assert parted and all((r["a"] < 30) != (r["b"] < 30) for r in parted)
