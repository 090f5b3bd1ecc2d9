import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.llm import dedup
from tests.llm.common import awkward, documents


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_force(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[lower(t)].append(i)
    low = lambda i: -1 if i is None else i
    return sorted(((i, max(g := groups[lower(t)], key=low), len(g), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in texts), key=str)


def test_same_as_brute_force(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choices("abÀé", k=n)) for n in (0, 1, 3, 4, 5, 8, 16, 17, 40, 200)]
    texts = []
    for i in range(200):
        t = rng.choice(base)
        if t and rng.random() < 0.4:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("abx") + t[k + 1 :]
        texts.append((i, t.upper() if rng.random() < 0.2 else t))
    texts += [(None, "ab"), (None, "AB"), (300, None), (301, ""), (301, "")]
    documents(spark, texts).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for size in (4, 16, 8192):
        out = dedup.identities(docs, size).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == brute_force(texts)
        assert sum(r.kept for r in out) == len({lower(t) for _, t in texts})
    left = dedup.deduplicate(docs.withColumn("rid", F.lit(1)).withColumn("kept", F.lit("x")), 16)
    assert left.columns == [*docs.columns, "rid", "kept"] and left.count() == len({lower(t) for _, t in texts})


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = {(r.doc_id, r.kept): r for r in dedup.identities(docs).collect()}
    assert out[(1, False)].keep_id == 2 and out[(4, False)].keep_id == 8 and out[(6, True)].group_size == 2
    assert dedup.identities(docs.limit(0)).count() == 0 and dedup.deduplicate(docs.limit(0)).count() == 0
