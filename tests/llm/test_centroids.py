"""Centroid clustering against a plain version."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException

from quarry.llm import centroids as C


def plain(rows, plan):
    held = [(i, [math.floor(plan.steps * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == plan.dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(held, key=lambda r: (name(r[0]), r[1]))[: plan.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centre))
    for _ in range(plan.rounds):
        of = [near(v)[1] for _, v in held]
        for k in range(len(centre)):
            own = [v for (_, v), o in zip(held, of, strict=True) if o == k]
            if own:
                centre[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [near(v) for _, v in held]
    inertia = [sum(d for d, k in last if k == c) for c in range(len(centre))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(held, last, strict=True)), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")


def corpus(n=200, width=5, seed=3):
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(9, width))
    rows = [(i, (around[rng.integers(9)] + rng.normal(size=width) / 9).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(5, rows[5][1]), (None, rows[7][1]), (n + 50, None), (n + 51, []), (n + 52, [1.0] * (width - 1)), (n + 53, [None] + [1.0] * (width - 1)), (n + 54, [float("nan")] * width), (n + 55, [float("-inf")] * width)]
    return rows


@pytest.mark.parametrize("plan", [C.Plan(12, 4, 5), C.Plan(3, 2, 5, 64, 9, 2, 1), C.Plan(400, 2, 5), C.Plan(4, 0, 5), C.Plan(4, 2, 5, pivots=1)])
def test_same_as_plain(spark, plan):
    rows = corpus()
    out = C.annotate(frame(spark, rows).repartition(3), plan)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows, plan)


def test_awkward(spark):
    plan = C.Plan(4, 2, 2)
    assert C.annotate(frame(spark, []), plan).collect() == []
    assert C.annotate(frame(spark, [(1, None)]), plan).collect() == []
    same = [(i, [0.5, -0.25]) for i in range(6)]
    assert sorted(map(tuple, C.annotate(frame(spark, same), plan).collect())) == plain(same, plan)
    assert len(C.assign(frame(spark, [(1, [1.0, 2.0]), (2, None)]).drop("cluster", "distance"), plan).collect()) == 2
    with pytest.raises(PySparkException):
        C.annotate(frame(spark, [(1, [1e300, 0.0])]), plan).collect()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 200, 1 << 20, 1 << 27]), st.integers(1, 6))
def test_bounds_never_exceed_distances(seed, size, width):
    rng = np.random.default_rng(seed)
    x, c, p = (rng.integers(-size, size, (n, width)) for n in (20, 8, 5))
    x[:3] = c[:3]
    pivots = C.Pivots(C.spread(p, 4), 6)
    own = C.squares(x, pivots.rows)
    true = C.squares(x, c)
    assert (pivots.bounds(own, C.squares(c, pivots.rows)) <= true).all()
    found, distance, checked = C.nearest(x, own, c, pivots)
    assert (found == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all() and len(x) <= checked <= true.size


def test_bounds_leave_out_most():
    rng = np.random.default_rng(8)
    around = rng.integers(-200, 200, (40, 64))
    x = around[rng.integers(0, 40, 2000)] + rng.integers(-20, 20, (2000, 64))
    pivots = C.Pivots(C.spread(around, 6), 8)
    assert C.nearest(x, C.squares(x, pivots.rows), around, pivots)[2] < 0.5 * 2000 * 40
