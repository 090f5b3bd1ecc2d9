"""The incremental graph against a full rebuild and a plain count."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from quarry.operators import graphbuild as G

SCHEMA = "space_id int, chunk_id long, content string"


def extract(content):
    """Words as names; types and importances by the words' letters."""
    words = F.filter(F.split(content, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(w.alias("name"), F.when(w.endswith("1"), "a").otherwise("b").alias("type"), F.when(w.endswith("0"), 0.0).when(w.endswith("2"), 7.0).otherwise(0.5).alias("importance")))


def corpus(seed, n=80):
    rng = random.Random(seed)
    return {(s, c): " ".join(f"Name-{rng.randrange(14)}" for _ in range(rng.randrange(2, 7))) for c in range(n) for s in {c % 3, 3}}


def rows_of(spark, held):
    return spark.createDataFrame([(s, c, t) for (s, c), t in held.items()], SCHEMA)


def tables(graph):
    return [sorted(map(tuple, x.collect()), key=str) for x in (graph.chunks, graph.mentions, graph.entities, graph.edges)]


def test_an_update_equals_a_rebuild(spark):
    old = corpus(1)
    new = {k: t for k, t in old.items() if k[1] % 9 != 4}
    rng = random.Random(2)
    for k in list(new):
        if rng.random() < 0.1:
            new[k] = f"Name-3 Name-2 other{rng.randrange(9)} été"
    new |= {(1, 500 + i): "Name-1 Name-2 fresh name" for i in range(3)} | {(2, 600): "short", (2, 601): None}
    first = G.build(rows_of(spark, old), extract)
    updated, whole = G.update(first, rows_of(spark, new), extract), G.build(rows_of(spark, new), extract)
    assert tables(updated) == tables(whole)
    known = lambda g: {r.hash for r in g.memo.collect()}
    fresh = {r.hash for r in whole.chunks.collect()} - known(first)
    assert fresh and known(updated) == known(first) | fresh and updated.memo.count() == len(known(updated))
    again = G.update(updated, rows_of(spark, new), extract)
    assert tables(again) == tables(whole) and again.memo.count() == updated.memo.count()
    weight, times = Counter(), Counter()
    for (s, _), t in new.items():
        if t and len(t.strip()) >= 20:
            names = {w.lower().replace("-", " ").replace("é", "e") for w in t.split()}
            times.update((s, n) for n in names)
            weight.update((s, *p) for p in combinations(sorted(names), 2))
    assert {(r.space_id, r.a, r.b): r.weight for r in whole.edges.collect()} == weight
    assert {(r.space_id, r["name"]): r.mention_count for r in whole.entities.collect()} == times
    relevance = {r["name"]: r.relevance for r in whole.mentions.collect()}
    assert relevance["name 0"] == 1.0 and relevance["name 2"] == 1.0 and relevance["name 3"] == 0.5


def test_to_and_from_nothing(spark):
    held, none = rows_of(spark, corpus(3, 20)), spark.createDataFrame([], SCHEMA)
    full = G.build(held, extract)
    assert tables(G.update(G.build(none, extract), held, extract)) == tables(full)
    assert all(x == [] for x in tables(G.update(full, none, extract)))


def test_canonical(spark):
    found = [("A-b", "t", 0.2), ("a b", "t", 0.9), ("a_b", "u", None), ("x", "t", 1.0), (None, "t", 1.0), ("??", "t", 1.0)] + [(f"n{i}x", None, -1.0) for i in range(12)]
    row = spark.createDataFrame([(found,)], "f array<struct<name:string,type:string,importance:double>>").select(G.canonical(F.col("f")).alias("x")).first().x
    assert [(e["name"], e["type"], e["importance"]) for e in row][:2] == [("a b", "t", 0.9), ("a b", "u", 1.0)] and len(row) == 10


def test_only_what_is_asked_for_is_made(spark):
    """Entities need no edges and edges no entities; names of a chunk aren't dealt out to be counted or paired."""
    old, new = corpus(5, 30), corpus(6, 30)
    for asked, other in (("entities", "edges"), ("edges", "entities")):
        first = G.build(rows_of(spark, old), extract)
        graph = G.update(first, rows_of(spark, new), extract)
        assert getattr(graph, asked).count() and asked in first.__dict__ and not {other} & (set(first.__dict__) | set(graph.__dict__))
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (graph.mentions, G._pairs(graph.named, 1))]
    assert not any("Exchange" in p for p in plans)


def test_no_text_is_written_and_edges_are_dealt_once(spark, monkeypatch):
    """Tables of a graph lie in columns, without texts; old edges aren't dealt again; pairs of a batch are counted before they are dealt."""
    import os

    import pyarrow as pa

    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    held = lambda: set(os.listdir(place)) if os.path.isdir(place) else set()
    old, new = corpus(7), corpus(8) | {k: t for k, t in corpus(7).items() if k[1] % 2}
    before = held()
    graph = G.update(G.build(rows_of(spark, old), extract), rows_of(spark, new), extract)
    plan = graph.edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(space_id") == plan.count("REPARTITION_BY_NUM") == 2
    whole, came = tables(G.build(rows_of(spark, new), extract)), held() - before
    assert tables(graph) == whole and came and all(x.startswith("stored-") and "content" not in spark.read.parquet(f"{place}/{x}").columns for x in came)
    monkeypatch.setattr(G, "MOST_SENT", 0)
    assert tables(G.update(G.build(rows_of(spark, old), extract), rows_of(spark, new), extract)) == whole
    batch = pa.RecordBatch.from_arrays([pa.array([1, None] * 500), pa.array([["b c", "a", "d"], ["a", "b c"]] * 500)], names=["space_id", "names"])
    out = [tuple(r.values()) for x in G._paired(-1)(iter([batch])) for r in x.to_pylist()]
    assert sorted(out, key=str) == sorted([(1, "a", "b c\x01d", [-500, -500]), (1, "b c", "d", [-500]), (None, "a", "b c", [-500])], key=str)


def test_the_query_deals_no_texts_to_documents(spark, monkeypatch):
    from quarry.plans import documents

    seen = []
    monkeypatch.setattr(documents.graphbuild, "build", lambda rows, extract: seen.append(rows))
    monkeypatch.setattr(documents.graphbuild, "update", lambda graph, rows, extract: seen.append(rows))
    documents._updated(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and not any("Exchange" in x._jdf.queryExecution().executedPlan().toString() for x in seen)
