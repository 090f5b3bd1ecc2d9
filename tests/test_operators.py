import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import catalog, chunking, extraction, fusion, graph, parents, tables, vectors
from quarry.streaming import status


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "document_id long, content string")


def one(spark, column, **values):
    types = {int: "long", str: "string", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_fixed_windows(spark):
    rows = chunking.fixed_windows(docs(spark, "a" * 1200, "b" * 1201, "", " " * 3000, None), 1200, 150).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.chunk_index, r.start_char, r.end_char) for r in rows] == [(0, 0, 0, 1200), (1, 0, 0, 1200), (1, 1, 1050, 1201)]


def test_sliding_windows(spark):
    rows = chunking.sliding_windows(docs(spark, "x" * 200, "y" * 80), 80, 10).orderBy("window_index").collect()
    assert [r.window_index for r in rows] == [0, 1, 2] and {r.window_count for r in rows} == {3} and len(rows[2].content) == 60


def test_h2_sections(spark):
    rows = chunking.h2_sections(docs(spark, "Intro\n## A\ntext\n## B\nmore", "none", "## only")).orderBy("chunk_index").collect()
    assert [(r.content, r.start_char, r.end_char) for r in rows] == [("Intro", 0, 5), ("## A\ntext", 7, 16), ("## B\nmore", 18, 27)]


def test_sentences():
    text = ("Une phrase assez courte. " * 40).strip()
    parts = chunking.sentences(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and parts[0].endswith(".") and parts[-1].endswith("courte.")
    assert chunking.sentences("z" * 250, 100, 20)[0] == "z" * 100 and chunking.sentences(None) == [] and chunking.sentences("kurz") == ["kurz"]


def test_content_class(spark):
    for text, kind in (("Selon la norme", "normative"), ("1. Serrer la vis", "procedure"), ("- point", "procedure"), ("Une belle maison", "description"), ("été en\tété", "normative")):
        assert one(spark, T.content_class("t"), t=text) == kind


def test_tables(spark):
    rows = {r.document_id: r for r in tables.parse(docs(spark, "| Produit | Diamètre | Note |\n|---|---|---|\n| Vis M4 | 4 | a\\|b |\n| Vis M5 |  |", "plain\ntext", "| only |", "- a\n- b", "| K | V |\n| a | 1 |\n| b | 2 |")).collect()}
    assert set(rows) == {0, 4}
    assert rows[0].headers == ["Produit", "Diamètre", "Note"] and rows[0].lines == [["Vis M4", "4", "a\\|b"], ["Vis M5", "", ""]]
    assert rows[0].suspicious == [1] and rows[0].empty == {1: [1, 2]}
    two = tables.parse(docs(spark, "| K | V |\n| a | 1 |\n| b |  |")).select(tables.canonical(F.col("headers"), F.col("lines")).alias("md"), tables.summary(F.col("headers"), F.col("lines"), F.lit("Titre")).alias("s")).first()
    assert two.md == "| K | V |\n|---|---|\n| a | 1 |\n| b |   |" and two.s == "Titre\n\nK → V\n\na → 1\nb → [vide]"


def test_row_text(spark):
    row = lambda h, c, p, bad: tables.row_text(F.array(*map(F.lit, h)), F.array(*map(F.lit, c)), F.lit(0), F.lit(3), F.lit("Sec"), F.lit(p).cast("string"), F.lit(7), F.lit(bad))
    assert one(spark, row(["Produit", ""], ["Vis M4", ""], None, False), x=1) == "[Sec] p.7 — Ligne 1/3: col1:Produit=Vis M4 | col2=[vide]"
    assert one(spark, row(["A"], ["b"], "Cap", True), x=1) == "[décalage probable] [Sec] Tableau (Cap) — p.7 — Ligne 1/3: col1:A=b"


def test_text_functions(spark):
    assert one(spark, T.normalize_name("t"), t="  Éléments-de_Façade (R2)! ") == "elements de facade r2"
    assert one(spark, T.query_terms("t"), t="Quel est le rôle de la vis M12 dans ISO 9001") == ["rôle", "vis", "m12", "iso", "9001"]
    assert one(spark, T.meaningful_words("t"), t="Façade façade pour murs") == ["facade", "murs"]
    assert one(spark, T.html_text("t"), t="<p>a&amp;b</p><script>x<y</script> <b>c</b>&copy;") == "a&b c ©"
    assert one(spark, T.safe_filename("t"), t="/x/y/a:b?.pdf") == "a_b_.pdf" and len(one(spark, T.safe_filename("t"), t="n" * 300 + ".md")) == 193
    assert one(spark, T.mime_type("t"), t="A.PDF") == "application/pdf"
    for q, n, want in (("Comparaison de A", 0, True), ("A vs B", 0, True), ("simple", 2, True), ("simple", 1, False), ("", 3, False)):
        assert one(spark, T.needs_several_steps("q", F.col("n")), q=q, n=n) is want


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, embedding array<double>")
    out = vectors.top_k(rows, rows, 2).where("query_id = 1").orderBy("rank").collect()
    assert [(r.row_id, round(r.score, 9)) for r in out] == [(1, 1.0), (2, 1.0)]
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), x=1) is None
    assert vectors.top_k(rows.limit(0), rows, 2).count() == 0


def scored(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, chunk_id long, score double")


def test_fusion(spark):
    out = {r.chunk_id: r for r in fusion.fuse(scored(spark, (1, 1, 0.9), (1, 2, 0.1)), scored(spark, (1, 2, 3.0)), scored(spark, (1, 3, 0.5), (1, 3, 0.7))).collect()}
    assert out[1].hybrid_score == pytest.approx(0.6) and out[2].hybrid_score == pytest.approx(0.25) and out[3].hybrid_score == pytest.approx(0.15)
    weak = spark.createDataFrame([(1, 1, 0.1, 0.0, 0.0, 0.0), (2, 1, 0.1, 0.0, 0.0, 0.0), (2, 2, 0.3, 0.0, 0.0, 0.0)], "query_id long, chunk_id long, vector_similarity double, lexical_norm double, kag_norm double, hybrid_score double")
    assert {(r.query_id, r.chunk_id) for r in fusion.keep_strong(weak).collect()} == {(1, 1), (2, 2)}
    hops = spark.createDataFrame([(1, 1, 0, 0.5, 0.5, 0.5, 0.0), (1, 2, 2, 0.5, 0.5, 0.5, 0.0)], "query_id long, chunk_id long, hop int, vector double, lexical double, kag double, evidence double")
    out = {r.chunk_id: r.mh_score for r in fusion.depth_score(hops).collect()}
    assert out[1] - out[2] == pytest.approx(0.10)
    out = {r.chunk_id: r.score for r in fusion.merge_boosted(scored(spark, (1, 1, 0.9)), scored(spark, (1, 1, 0.85), (1, 2, 0.95))).collect()}
    assert out == {1: pytest.approx(0.95), 2: 1.0}
    assert one(spark, fusion.title_boost("q", "t"), q="grande façade murs", t="Façade et murs") == 1.0


def test_graph(spark):
    m = spark.createDataFrame([(0, 1, "a", 1.0), (0, 1, "b", 0.5), (0, 2, "b", 1.0), (0, 2, "c", 1.0), (0, 3, "c", 0.4)], "space_id long, chunk_id long, name string, relevance double")
    edges = graph.co_occurrence(m)
    assert {(r.a, r.b, r.weight) for r in edges.collect()} == {("a", "b", 1), ("b", "c", 1)}
    seeds = spark.createDataFrame([(7, 0, "a")], "query_id long, space_id long, name string")
    assert [r.name for r in graph.neighbours(edges, seeds).collect()] == ["b"]
    out = graph.retrieve(seeds, m, 10).orderBy("rank").collect()
    assert [(r.chunk_id, r.stage, round(r.score, 2)) for r in out] == [(1, 0, 1.0), (2, 1, 0.88)]
    raw = spark.createDataFrame([(1, "Vis-M4", "x", 0.4, 0), (1, "vis m4", "x", 2.0, 1), (1, "?", "x", 1.0, 2), (1, "Vis M4", "y", None, 3)], "chunk_id long, name string, entity_type string, importance double, pos long")
    assert {(r.name, r.entity_type, r.importance) for r in graph.canonical(raw).collect()} == {("vis m4", "x", 1.0), ("Vis M4", "y", 1.0)}
    assert one(spark, graph.preview("t", 60), t="mot " * 30) == ("mot " * 15)[:59] + "…"


def test_parents(spark):
    nodes = spark.createDataFrame([(1, "w", "t", True), (1, "t", "s", True), (1, "s", None, False)], "document_id long, node_id string, parent_node_id string, is_leaf boolean")
    leaves = spark.createDataFrame([(9, 1, "w", 1, 0.9, 3), (9, 1, "t", 2, 0.8, 4), (9, 1, "gone", 3, 0.1, 5)], "query_id long, document_id long, node_id string, rank long, score double, page_no long")
    out = {r.target_id: r for r in parents.one_each(parents.resolve(leaves, nodes)).collect()}
    assert (out["s"].rank, out["s"].score, out["s"].page_no, out["s"].leaves) == (1, 0.9, 4, 2) and out["gone"].leaves == 1
    passages = spark.createDataFrame([(9, 1, "T", "body", 0.5), (9, 2, "U", "more", 0.25)], "query_id long, rank long, title string, passage string, score double")
    assert parents.context(passages).first().context == "[1] (0.50) T\nbody\n\n---\n[2] (0.25) U\nmore\n\n\n(2 passages.)"
    assert one(spark, parents.passage_text("t", "h", F.lit("body")), t="T", h="") == "**T**\nbody"
    assert one(spark, parents.passage_text("t", "h", F.lit("body"), F.lit("Fig")), t="T", h="S") == "**T**\n[Section: S] Fig\n\nbody"
    pics = spark.createDataFrame([(1, 2, 5, "n1"), (1, 2, 6, "n2")], "document_id long, page_no long, chunk_index long, node_id string")
    images = spark.createDataFrame([(1, 2, 9.0, "i2"), (1, 2, 1.0, "i1"), (1, 2, 20.0, "i3")], "document_id long, page_no long, top double, image_id string")
    assert {(r.node_id, r.image_id) for r in parents.paired(pics, images).collect()} == {("n1", "i1"), ("n2", "i2")}


def test_folders(spark):
    f = spark.createDataFrame([(1, None, "root"), (2, 1, "a"), (3, 2, "b"), (8, 9, "x"), (9, 8, "y")], "folder_id long, parent_id long, name string")
    assert {r.folder_id: r.path for r in catalog.paths(f.where("folder_id < 8")).collect()} == {1: "root", 2: "root/a", 3: "root/a/b"}
    moves = spark.createDataFrame([(2, 3), (3, 1), (2, 2)], "folder_id long, target_id long")
    assert {(r.folder_id, r.target_id): r.allowed for r in catalog.move_allowed(f, moves).collect()} == {(2, 3): False, (3, 1): True, (2, 2): False}


def test_status_stream_equals_batch(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    rows = [(i, at(i), i % 3, k, 1.0, "{}") for i, k in enumerate(["signup", "view", "click", "purchase", "error", "view", "click", "signup", "view"])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    gone = spark.createDataFrame([(2,)], "document_id long")
    query = status.start(status.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), gone)
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()}
    assert got == {tuple(r) for r in catalog.status_fold(events.where("user_id <> 2")).collect()} and len(got) == 2
    assert status.windowed(events).count() == 5


def test_awkward_tables(spark):
    empty = docs(spark, "x").limit(0)
    for f in (lambda d: chunking.fixed_windows(d, 10, 2), lambda d: chunking.sliding_windows(d, 10, 2), chunking.adaptive, chunking.h2_sections, chunking.sentence_chunks, tables.parse):
        assert f(empty).count() == 0
        f(docs(spark, None, "", " ", "été " * 50)).count()


def test_folders_at_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None, f"n{i}") for i in range(1, 41)] + [(50, 51, "x"), (51, 50, "y"), (52, 50, "z")], "folder_id long, parent_id long, name string")
    paths = {r.folder_id: (r.path, r.depth) for r in catalog.paths(chain).collect()}
    assert paths[40] == ("/".join(f"n{i}" for i in range(1, 41)), 39)
    assert {r.ancestor_id for r in catalog.ancestors(chain).where("folder_id = 52").collect()} == {50, 51, 52}  # a cycle ends
    moves = spark.createDataFrame([(1, 40), (40, 1), (50, 51)], "folder_id long, target_id long")
    assert {(r.folder_id, r.target_id): r.allowed for r in catalog.move_allowed(chain, moves).collect()} == {(1, 40): False, (40, 1): True, (50, 51): False}
    left, docs = catalog.after_delete(chain, chain.select("folder_id"), spark.createDataFrame([(3,)], "folder_id long"))
    assert {r.folder_id for r in left.collect()} == {1, 2, 50, 51, 52} == {r.folder_id for r in docs.collect()}


def test_extraction(spark):
    texts = ['```json\n[{"name": " A b ", "type": "Norme_Doc", "importance": 0.2}, {"name": "x", "type": "norme_doc"}, {"name": "cc", "type": "other"}, {"name": "dd", "type": "regle_pose", "importance": 7}]\n```', "so: [1, 2", None, "[]"]
    out = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(extraction.entities("t").alias("e")).collect()]
    assert [tuple(x) for x in out[0]] == [("A b", "norme_doc", 1.0), ("dd", "regle_pose", 1.0)] and not out[1] and not out[2] and out[3] == []
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "bad"), (5, "cd")], "id long, content string").coalesce(1)

    def embedder(batch):
        if "bad" in batch:
            raise ValueError("no")
        return [[float(len(t))] for t in batch]

    found = {r.id: r.embedding for r in extraction.embed(rows, embedder, batch=1, tries=2, wait=0).collect()}
    assert found == {1: [1.0], 2: None, 3: None, 4: None, 5: [2.0]}


def test_nearest_rows_in_bounded_memory(monkeypatch):
    """2,048 queries over five batches of 10,000 rows, many of them equal: small products, and the same rows as all scores sorted."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    monkeypatch.setattr(vectors, "WAITING", 200_000, raising=False)
    rng = np.random.default_rng(5)
    units = rng.integers(-1, 2, (50_000, 8)).astype(np.float64)
    units[0] = 1.0, *[0.0] * 7
    units = units[np.linalg.norm(units, axis=1) > 0]
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    queries, k = rng.normal(size=(2048, 8)), 15
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    batches = [pd.DataFrame({"id": np.arange(a, min(a + 10_000, len(units))), "embedding": list(units[a : a + 10_000]), "by": 0}) for a in range(0, len(units), 10_000)]
    tracemalloc.start()
    out = pd.concat(vectors._keeper(np.arange(2048), queries, np.zeros(2048, np.int64), k)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print("peak MB", peak / 1e6)
    assert peak < 100e6
    for q in range(0, 2048, 97):
        scores = np.round(units @ queries[q], 9)
        assert out[out.query_id == q].row_id.tolist() == np.lexsort((np.arange(len(units)), -scores))[:k].tolist()


def test_names_meet_their_best_chunks_alone(spark):
    """A name of 400 chunks, 40 questions: what meets isn't all of both; the result is that of all meetings."""
    import random

    from pyspark.sql import Window

    pick = random.Random(2)
    names = ["everywhere"] + [f"name{i}" for i in range(60)]
    rows = [(0, c, n, pick.randint(1, 5) / 5) for c in range(400) for n in {"everywhere" if c % 4 else "name0", *pick.choices(names[1:], k=2)}]
    mentions = spark.createDataFrame(rows + rows[:9], "space_id int, chunk_id long, name string, relevance double")
    terms = spark.createDataFrame([(q, 0, n) for q in range(40) for n in ({names[q % 61]} if q % 3 else {names[q], "nowhere", names[0]})] + [(50, 0, "nowhere")], "query_id int, space_id int, name string")
    for k in (4, 25):
        held = mentions.distinct()
        exact = held.join(terms, ["space_id", "name"]).selectExpr("query_id", "space_id", "chunk_id", "relevance", "0 AS stage")
        second = held.join(graph.mentioned_with(held, terms), ["space_id", "name"]).selectExpr("query_id", "space_id", "chunk_id", "relevance * 0.88D AS relevance", "1 AS stage")
        all_of = exact.union(second).groupBy("query_id", "space_id", "chunk_id").agg(F.min("stage").alias("stage"), F.max_by("relevance", F.struct(-F.col("stage"), F.col("relevance"))).alias("score"))
        by = Window.partitionBy("query_id").orderBy("stage", F.desc(F.round("score", 9)), "chunk_id")
        want = all_of.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        keyed = lambda x: sorted((r.query_id, r.chunk_id, r.stage, round(r.score, 9), r["rank"]) for r in x.collect())
        assert keyed(graph.retrieve(terms, mentions, k)) == keyed(want)
    assert graph._best_of_names(held, 8).count() == sum(min(8, len({c for _, c, n, _ in rows if n == name})) for name in {n for _, _, n, _ in rows})


def test_canonical_of_arrays(spark):
    """The same as canonical(), but no row leaves its chunk."""
    found = [("Vis-M4", "x", 0.4), ("vis m4", "x", 2.0), ("VIS_M4", "x", 1.0), ("?", "x", 1.0), ("Vis M4", "y", None), (None, "x", 1.0), (" été ", None, -1.0), ("ete", None, 0.0), ("a", "x", 1.0), ("ab1", "x", 0.5), ("ab1", "x", 0.5)]
    chunks = spark.createDataFrame([(1, found), (2, found[::-1]), (3, []), (4, None)], "chunk_id long, mentions array<struct<name:string,entity_type:string,importance:double>>")
    held, rows = graph.canonical_of(chunks), chunks.select("chunk_id", F.posexplode("mentions").alias("pos", "m")).select("chunk_id", "m.*", "pos")
    assert held.count() == 8 and sorted(map(str, held.collect())) == sorted(map(str, graph.canonical(rows).collect()))
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_title_boosts_are_counted_in_arrays(spark, monkeypatch):
    """Pairs of titles and questions don't become rows before they are counted, few are held at once; repeated and null ids count as SQL counts them."""
    from collections import Counter

    import pyarrow as pa

    words = ["stone", "garden", "facade", "timber", "copper", "window"]
    titles = [(i if i % 40 else None, " ".join(w for j, w in enumerate(words) if (i >> j) % 2)) for i in range(200)] + [(7, "Façade timber the"), (8, None)]
    asked = [(0, "garden stone garden"), (0, "facade"), (50, "copper window timber facade stone garden"), (100, "nowhere"), (150, ""), (200, None)]
    docs, questions = spark.createDataFrame(titles, "document_id long, title string"), spark.createDataFrame(asked, "query_id long, content string")
    own = lambda text: {w.lower().replace("ç", "c") for w in (text or "").split()} - {"the"}
    shared = Counter((q, d) for d, title in titles for q, content in asked for _ in own(title) & own(content))
    want = {pair: min(0.5 * n, 2.0) for pair, n in shared.items()}
    out = fusion.title_boosts(questions, docs)
    assert {(r.query_id, r.document_id): r.boost for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "query_id, document_id" not in plan.split("MapInArrow", 1)[1]
    assert fusion.title_boosts(questions.limit(0), docs).count() == 0 and fusion.title_boosts(questions, docs.limit(0)).count() == 0
    monkeypatch.setattr(fusion, "MEETINGS", 20)
    monkeypatch.setattr(fusion, "BLOCK", 2)
    batch = pa.table({"document_id": pa.array([d for d, _ in titles]), "words": pa.array([sorted(own(t)) for _, t in titles])}).combine_chunks().to_batches()
    held = list(fusion._boosting(pa.table({"query_id": pa.array([q for q, _ in asked]), "words": pa.array([sorted(own(c)) for _, c in asked])}))(iter(batch)))
    assert len(held) > 20 and max(map(len, held)) <= 40
    assert fusion.title_boosts(questions, docs).count() == len(want)


def test_letters_of_a_text_are_counted_once(spark):
    """Not once a window, which made long texts take time by the square of their length."""
    out = spark.createDataFrame([("ab " * 50,)], "t string").select(chunking.windows_of(F.col("t"), F.lit(20), F.lit(15)).alias("w"))
    assert out._jdf.queryExecution().analyzed().toString().count("length(t#") == 1
    assert [(w.start_char, w.end_char) for w in out.first().w] == [(s, min(s + 20, 150)) for s in range(0, 136, 15)]


def test_words_meet_their_neighbours_in_arrays(spark, monkeypatch):
    """Meetings of neighbours and questions don't become rows, and few are held at once; the result is that of a plain count."""
    import random
    from collections import Counter, defaultdict

    import pyarrow as pa

    pick = random.Random(4)
    known = [f"name{i}" for i in range(30)]
    chunks = [(s, c, pick.sample(known, pick.randrange(0, 6))) for c in range(120) for s in (c % 3 if c % 10 else None, 7)] + [(0, 999, ["name1"]), (0, 1000, None)]
    asked = [(q, n) for q in range(0, 400, 10) for n in pick.sample(known + ["nowhere"], 3)] * 2
    words, weight = defaultdict(set), Counter((s, a, b) for s, _, x in chunks for a in x or [] for b in x or [] if a != b)
    for q, n in asked:
        words[q].add(n)
    want = {}
    for (s, a, b), n in weight.items():
        for q, own in words.items():
            if a in own and b not in own:
                want[q, s, b] = max(want.get((q, s, b), 0), n)
    names, questions = spark.createDataFrame(chunks, "space_id int, chunk_id long, names array<string>"), spark.createDataFrame(asked, "query_id long, name string")
    out = graph.beside_words(names, questions)
    keyed = lambda x: {(r.query_id, r.space_id, r.name): r.weight for r in x.collect()}
    assert keyed(out) == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(space_id" in plan and "hashpartitioning(query_id" not in plan
    assert graph.beside_words(names.limit(0), questions).count() == 0 and graph.beside_words(names, questions.limit(0)).count() == 0
    monkeypatch.setattr(graph, "BLOCK", 15)
    assert keyed(graph.beside_words(names, questions)) == want
    block = pa.table({"query_id": [q for q, x in words.items() for _ in x], "name": [n for x in words.values() for n in x]})
    places = {n: i for i, n in enumerate(block["name"].unique().to_pylist())}
    edges = defaultdict(list)
    for (s, a, b), n in weight.items():
        if a in places:
            edges[s, b] += [(places[a], n - 1), (places[a], 1)]  # in two parts, as two batches give them
    rows = [(s, b, [x for x, _ in e], [n for _, n in e]) for (s, b), e in edges.items()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["space_id", "name", "seeds", "weights"])
    for few in (1, 60, 10**6):
        monkeypatch.setattr(graph, "MEETINGS", few)
        held = [x.to_pylist() for x in graph._asked_beside(block)(iter([batch]))]
        assert {(m["query_id"], r["space_id"], r["name"]): m["weight"] for x in held for r in x for m in r["met"]} == want
        assert few > 1 or all(len(x) == 1 for x in held)
