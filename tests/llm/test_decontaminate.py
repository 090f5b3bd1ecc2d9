import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate as D
from tests.llm.common import awkward, documents


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Ünd", "A1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 20, 40])))) for i in range(30)] + [(3, "a a a a a a a a a a a a a a a a"), (31, None), (32, "..."), (None, "solo word")]
    texts = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, max(1, len(own) - 10))
            words[rng.randrange(len(words) + 1) : 0] = own[a : a + rng.choice([5, 12, 13, 14, 40])]
        texts.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return texts + [(60, "A a, a " * 40), (61, None), (62, ""), (62, "")], items


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]]) -> list[tuple[int, int, int, str, bool]]:
    """The contract's definition word by word, for tests."""
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for text in texts:
        doc, hit, ids = cut(text), set(), set()
        for key, item in items:
            own = cut(item)
            n = min(D.SPAN, len(own))
            wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(doc) - n + 1) if n else ():
                if tuple(doc[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    ids.add(str(key))
        out.append((len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)))
    return out


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, -1])
def test_same_as_brute_force(spark, limit):
    texts, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = D.annotate(documents(spark, texts), bench, broadcast_bytes=limit)
    got = out.select("doc_id", "decontamination.*").withColumn("sha", D.digest("items"))
    want = brute_force([t for _, t in texts], [("" if i is None else i, t) for i, t in items])
    rows = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in got.collect())
    assert rows == sorted((i, *w) for (i, _), w in zip(texts, want, strict=True))
    assert sum(r[5] for r in rows) > 5


def test_awkward_and_empty(spark):
    docs = awkward(spark).withColumn("decontamination", F.lit(1)).withColumn("n_words", F.lit(2))
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    out = D.annotate(docs, bench)
    assert out.columns[:-1] == docs.columns and out.count() == docs.count()
    assert {r.doc_id for r in out.where(f"{out.columns[-1]}.contaminated").collect()} == {4, 5, 8}
    assert D.annotate(docs, bench.limit(0)).where(f"{out.columns[-1]}.contaminated").count() == 0
    assert D.annotate(docs.limit(0), bench).count() == 0
    assert D.clean(docs, bench).columns == docs.columns
