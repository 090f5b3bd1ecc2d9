import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quarry.llm import tokens, toxicity  # noqa: E402
from tests.llm import test_decontaminate, test_dedup, test_jaccard  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "0"))
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(str(tmp_path / str(k)))
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k + 1)))
        out = spark.read.parquet(str(tmp_path / str(k + 1)))
        if name != "packing":
            assert out.columns == columns
            kept = {r.doc_id for r in out.collect()}
        if name == "toxicity":
            found = toxicity.annotate(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            assert kept == {r.doc_id for r in found.where("toxicity.score < 0.5").collect()}
        elif name == "exact_dedup":
            assert kept == {keep for _, keep, _, _ in test_dedup.brute_force(list(before.items()))}
        elif name == "jaccard_join":
            assert kept == {c for _, _, c in test_jaccard.brute_force(list(before.items()))}
        elif name == "decontamination":
            found = test_decontaminate.brute_force(list(before.values()), items)
            assert kept == {i for i, x in zip(before, found, strict=True) if not x[4]}
        else:
            tk, rows = tokens.tokenizer(tokens.vocabulary("byte_bpe_50k.json")), {}
            for r in out.collect():
                rows[r.doc_id, r.start] = (r.length, r.ids_crc32)
            for i, t in before.items():
                ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
                for a in range(0, len(ids), 2048):
                    assert rows.pop((i, a)) == (len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))
            assert not rows


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and out.where(F.col("length") > 0).count() == out.count() > 0
