"""Each registered query on a small written folder, its contract columns against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import centroids, queries, resample, tokens
from tests.llm import test_centroids, test_decontaminate, test_dedup, test_jaccard, test_lattice, test_licenses, test_minhash, test_pii, test_resample
from tests.llm.common import documents

TYPES = {
    "op1_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_lattice_score": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_personal_data": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op5_binary_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op11_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op12_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_centroids": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(21)
    words = ["the", "Thing", "été", "x,", "日本", "vile", "MIT", "license", "under", "a@b-c.org", "1.2.3.4", "+1 (017) 555-7713", "don't"] + [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 13, 30])))) for i in range(12)] + [(20, None), (21, "")]
    base = [rng.choices(words, k=rng.choice([2, 8, 40, 90])) for _ in range(8)]
    texts = []
    for i in range(90):
        own = list(rng.choice(base))
        own[rng.randrange(len(own))] = rng.choice(words)
        if rng.random() < 0.3:
            own += (rng.choice(items)[1] or "").split() + ["under", "the", "MIT", "license"]
        texts.append((i, rng.choice([" ", "\n", "\t "]).join(own)))
    texts += [(100, None), (101, ""), (102, " \n"), (103, "one"), (103, "one"), (104, "word " * 20_000), (105, "X" * 30_000), (106, "4111 1111 1111 1111"), (107, texts[3][1].upper())]
    extra = documents(spark, texts).withColumns({"rid": F.lit(1), "block": F.lit("x"), "label": F.lit(None).cast("string"), "h": F.lit(2)})
    extra.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int("vile" in (t or ""))) for i, t in texts[:90]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    draw = np.random.default_rng(4)
    vectors = [(i, (draw.normal(size=64) / 8).tolist()) for i in range(130)] + [(200, None), (201, [1.0] * 63), (202, [float("nan")] * 64), (203, [None] * 64)]
    spark.createDataFrame(vectors + vectors[:9], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path), texts, items


def run(spark, folder, name):
    out = queries.queries()[name](spark, folder[0])
    held = dict(out.dtypes)
    for column in TYPES[name].split(", "):
        assert held[column.split()[0]] == column.split()[1], column
    return out.collect()


def ids_of(name, text, end=True):
    return [*tokens.tokenizer(tokens.vocabulary(name)).encode(text or "", add_special_tokens=False).ids, *[1] * end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, folder):
    want = test_decontaminate.brute_force([t for _, t in folder[1]], folder[2])
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, folder, "op1_decontaminate"))
    assert got == sorted((i, *w) for (i, _), w in zip(folder[1], want, strict=True)) and any(r[5] for r in got)


def test_op2(spark, folder):
    rows = run(spark, folder, "op2_lattice_score")
    assert len(rows) == len(folder[1])
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows} == {(*x[:5], round(x[5], 4)) for x in test_lattice.brute_force(folder[1])}
    want = test_lattice.marginal(folder[1])
    assert all(abs(r.score - want[r.doc_id, r.n_tokens]) <= 1e-6 * abs(r.score) for r in rows)


def test_op3(spark, folder):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, folder, "op3_jaccard_join"))
    assert got == test_jaccard.brute_force(folder[1]) and len({c for _, _, c in got}) < len(got) - 5


def test_op4(spark, folder):
    texts = dict(folder[1])
    for r in run(spark, folder, "op4_personal_data"):
        want = test_pii.brute_force(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone"))
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_op5(spark, folder):
    rows, at = sorted(run(spark, folder, "op5_binary_output"), key=lambda r: r.start), 0
    assert [r.doc_id for r in rows] == sorted(i for i, _ in folder[1])
    texts = dict(folder[1])
    for r in rows:
        ids = ids_of("word_bpe_49k.json", texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op6(spark, folder):
    want = sorted((i, len((t or "").encode()), n := len(ids_of("byte_bpe_50k.json", t, False)), n > 512) for i, t in folder[1])
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, folder, "op6_token_counts")) == want


def pieces_are_right(rows, texts):
    want, held = [], {}
    for i, t in texts:
        ids, own = ids_of("byte_bpe_50k.json", t), [r for r in rows if r.doc_id == i]
        assert all(r.doc_tokens == len(ids) for r in own)
        want.append((i, len(ids)))
        for r in own:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length]) and r.length > 0
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_op7(spark, folder):
    pieces_are_right(run(spark, folder, "op7_packing"), folder[1])


def test_op8(spark, folder):
    rows = run(spark, folder, "op8_exact_dedup")
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == test_dedup.brute_force(folder[1])
    assert sum(r.kept for r in rows) == len({test_dedup.lower(t) for _, t in folder[1]})


def test_op9(spark, folder):
    rows, toxic = run(spark, folder, "op9_toxicity"), {i for i, t in folder[1] if "vile" in (t or "").lower()}
    assert len(rows) == len(folder[1])
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert sum((r.doc_id in toxic) == bool(r.predicted) for r in rows) > 0.8 * len(rows)


def test_op10(spark, folder):
    rows = run(spark, folder, "op10_license_scan")
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == sorted(((i, *test_licenses.brute_force(t)) for i, t in folder[1]), key=lambda x: x[:3])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_op11(spark, folder):
    rows = run(spark, folder, "op11_minhash")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(test_minhash.brute(folder[1]))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and not all(r.kept for r in rows)


def test_op12(spark, folder):
    rows = run(spark, folder, "op12_importance_resampling")
    want = test_resample.plain(folder[1], [t for _, t in folder[2]], resample.Plan())
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in rows), key=str) == sorted(((i, n, w, x) for i, n, _, w, x, _ in want), key=str)
    assert {(r.doc_id, r["rank"]) for r in rows if r["rank"]} == {(r[0], r[5]) for r in want if r[5]} and any(r["rank"] for r in rows)


def test_op13(spark, folder):
    rows = run(spark, folder, "op13_centroids")
    held = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder[0]}/embeddings.parquet").collect()]
    assert sorted(map(tuple, rows), key=str) == test_centroids.plain(held, centroids.Plan()) and len(rows) == 139


def test_pipeline(spark, folder):
    """The whole run against the stages' definitions, one after another."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.run(spark, folder[0]).collect()
    scores = {r.doc_id: r.score for r in queries.queries()["op9_toxicity"](spark, folder[0]).collect()}
    kept = [(i, t) for i, t in folder[1] if scores[i] < 0.5]
    groups = {}
    for i, t in kept:
        groups[test_dedup.lower(t)] = max((i, t), groups.get(test_dedup.lower(t), (i, t)), key=lambda x: x[0])
    kept = list(groups.values())
    kept = [(i, t) for i, t in kept if (i, i) in {(a, c) for a, _, c in test_jaccard.brute_force(kept)}]
    found = test_decontaminate.brute_force([t for _, t in kept], folder[2])
    kept = [x for x, f in zip(kept, found, strict=True) if not f[4]]
    assert {r.doc_id for r in rows} == {i for i, _ in kept} and len(kept) > 5
    pieces_are_right(rows, kept)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_query_is_tested():
    assert set(TYPES) == set(queries.queries())
