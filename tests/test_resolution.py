"""Entity resolution by cells against all pairs."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarry.operators import resolution as R

SCHEMA = "entity_id long, space_id int, entity_type string, embedding array<double>"


def vectors(n, width, around, noise, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(around, width))
    return centres[rng.integers(0, around, n)] + rng.normal(size=(n, width)) * noise


def all_pairs(rows, least):
    """entity -> best earlier partner, and entity -> smallest connected."""
    best, root = {}, {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s, t, v in rows:
        for j, s2, t2, w in rows:
            if j < i and (s, t) == (s2, t2) and v is not None and w is not None and len(v) == len(w):
                norm = float(np.linalg.norm(v) * np.linalg.norm(w))
                x = float(np.dot(v, w)) / norm if norm else -1.0
                if x > least:
                    best[i] = max(best.get(i, (-2.0, 0)), (round(x, 9), -j))
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: -best[i][1] if i in best else i for i, *_ in rows}, {i: find(i) for i, *_ in rows}


@pytest.mark.parametrize(("chunk", "least"), [(2048, 0.92), (16, 0.92), (16, 0.3), (8, 0.99)])
def test_same_as_all_pairs(spark, chunk, least):
    x = vectors(240, 6, 20, 0.12, 5)
    rows = [(i, i % 2, "ab"[i % 5 == 0], v.tolist()) for i, v in enumerate(x)]
    rows += [(300 + i, 0, "a", rows[4][3]) for i in range(40)] + [(400, 0, "a", [2 * y for y in rows[4][3]]), (401, 0, "a", None), (402, 0, "a", [0.0] * 6), (403, 0, "a", [1.0, 2.0]), (404, 1, None, rows[1][3]), (405, 1, None, rows[1][3])]
    best, root = all_pairs(rows, least)
    frame = spark.createDataFrame(rows, SCHEMA)
    out = {r.entity_id: (r.canonical_id, r.similarity) for r in R.resolve(frame, least, chunk).collect()}
    assert {i: c for i, (c, _) in out.items()} == best
    assert all(s > least for i, (c, s) in out.items() if c != i)
    assert {r.entity_id: r.root_id for r in R.merged(frame, least, chunk).collect()} == root


def test_empty(spark):
    assert R.resolve(spark.createDataFrame([], SCHEMA)).collect() == [] == R.merged(spark.createDataFrame([], SCHEMA)).collect()


def test_many_of_one_space_and_type(spark, tmp_path):
    n, width = 100_000, 32
    x = vectors(n, width, 300, 0.05, 9).astype(np.float64)
    x[50_000:60_000] = x[7]  # a tenth is one vector
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.reshape(-1)))
    pq.write_table(pa.table({"entity_id": np.arange(n), "space_id": np.zeros(n, np.int32), "entity_type": ["a"] * n, "embedding": flat}), tmp_path / "entities.parquet", row_group_size=10_000)
    frame = spark.read.parquet(str(tmp_path / "entities.parquet")).repartition(8)
    out = R.resolve(frame, 0.92).toPandas().set_index("entity_id").sort_index()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    for i in np.r_[rng.integers(0, n, 1500), 50_000, 59_999]:
        near = unit[:i] @ unit[i] if i else np.zeros(0)
        want = int(np.flatnonzero(near >= near.max() - 1e-12)[0]) if i and near.max() > 0.92 else i
        assert out.canonical_id[i] == want
