"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import resample
from tests.llm.common import awkward, documents


def runs_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain(texts, target, plan):
    bucket = lambda x: zlib.crc32(x.encode()) % plan.buckets
    of = [runs_of(t, plan.longest) for _, t in texts]
    s = Counter(bucket(x) for _, found in of for x in found)
    t = Counter(bucket(x) for text in target for x in runs_of(text, plan.longest)[1])
    all_s, all_t, b = sum(s.values()), sum(t.values()), plan.buckets
    gain = [math.floor(1000 * math.log((t[i] + 1) * (all_s + b) / ((s[i] + 1) * (all_t + b)))) for i in range(b)]
    rows = []
    for (i, _), (words, found) in zip(texts, of, strict=True):
        weight = sum(gain[bucket(x)] for x in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[2] >= plan.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): n for n, r in enumerate(able[: len(able) * plan.percent // 100], 1)}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=str)


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(90)] + ["The", "été", "x,y", "日本"]
    return [(i, rng.choice([" ", "\n", " - "]).join(rng.choices(words, k=rng.choice([0, 3, 25, 60])))) for i in range(n)], [" ".join(rng.choices(words[:30], k=40)) for _ in range(9)] + [None, ""]


@pytest.mark.parametrize("plan", [resample.Plan(), resample.Plan(3, 50, 40, 3, 7)])
def test_same_as_plain(spark, plan):
    texts, target = corpus()
    held = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.annotate(documents(spark, texts).repartition(5), held, plan).select("doc_id", "n_features", "n_words", "weight", "score", "rank")
    assert sorted(map(tuple, out.collect()), key=str) == plain(texts, target, plan)


def test_awkward(spark):
    docs = awkward(spark).selectExpr("*", "1 AS importance", "2 AS bucket", "3 AS score", "4 AS rank", "5 AS weight")
    held = spark.createDataFrame([("one two",)], "text string")
    plan = resample.Plan(2, 100, 100, 0)
    rows = resample.annotate(docs, held, plan).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain(texts, ["one two"], plan)
    # two rows of one id and score may change places
    assert sorted(((r.doc_id, r.n_features, r.n_words, r.weight, r.score) for r in rows), key=str) == sorted((r[:5] for r in want), key=str)
    assert sorted(r["rank"] for r in rows) == list(range(1, len(texts) + 1))
    assert resample.annotate(docs.limit(0), held).collect() == []
    assert len(resample.annotate(docs, held.limit(0)).collect()) == len(texts)
    assert resample.sample(docs, held, resample.Plan(1, 100, 100, 20)).columns == docs.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text("aB é.1 日\n-", max_size=20), min_size=1, max_size=6), st.integers(1, 4))
def test_runs(texts, longest):
    bucket, owner, n_words = resample.features(pa.array(texts, pa.string()), longest, 1 << 31)
    found = Counter(zip(owner.tolist(), bucket.tolist(), strict=True))
    want = Counter((i, zlib.crc32(x.encode()) % (1 << 31)) for i, t in enumerate(texts) for x in runs_of(t, longest)[1])
    assert found == want and n_words.tolist() == [len(runs_of(t, 1)[0]) for t in texts]


def test_slices_of_a_batch():
    texts = pa.array([f"One two word{i} x" * 40 for i in range(300)] + [None, ""], pa.string())
    whole = resample.features(texts, 2, 1 << 31)
    found = [resample.features(texts.slice(a, 100), 2, 1 << 31) for a in range(0, 302, 100)]
    assert np.concatenate([n for _, _, n in found]).tolist() == whole[2].tolist()
    assert Counter(b for held, _, _ in found for b in held.tolist()) == Counter(whole[0].tolist())


def test_texts_of_several_slices(spark):
    texts, target = [(i, f"Alpha beta w{i % 50} " * 400) for i in range(900)], ["alpha w3 w4"]
    held = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.annotate(documents(spark, texts).coalesce(1), held).select("doc_id", "n_features", "n_words", "weight", "score", "rank")
    assert sorted(map(tuple, out.collect()), key=str) == plain(texts, target, resample.Plan())
