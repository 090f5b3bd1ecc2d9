"""Trees of sections from structured leaves and elements."""

from pyspark.sql import functions as F

from quarry.operators import hierarchy as H, parents, tables
from quarry.plans import documents, queries

LEAF = "document_id long, pos int, content string, headings array<string>, caption string, page_no int, label string"


def tree(spark, leaves, **how):
    rows = [(1, i, *(x + (None,) * (5 - len(x)))) for i, x in enumerate(leaves)]
    return sorted(H.chunks(spark.createDataFrame(rows, LEAF), **how).collect(), key=lambda r: r.chunk_index)


def test_nothing_and_blank(spark):
    assert tree(spark, []) == []
    assert tree(spark, [(" ", ["1 Intro"]), (None, ["2"])]) == []


def test_one_heading_two_leaves(spark):
    section, a, b = tree(spark, [("Premier paragraphe.", ["1 Introduction"]), ("Deuxième paragraphe.", ["1 Introduction"])])
    assert not section.is_leaf and section.content == "Premier paragraphe.\n\nDeuxième paragraphe." and section.parent_node_id is None
    assert [a.content_type, b.content_type] == ["text_full"] * 2 and a.parent_node_id == b.parent_node_id == section.node_id
    assert a.heading_path == ["1 Introduction"] and a.content == "Fil d'Ariane : 1 Introduction\n\nPremier paragraphe."
    assert [r.chunk_index for r in (section, a, b)] == [0, 1, 2]


def test_table_of_two_columns(spark):
    md = "| Col1 | Col2 |\n| --- | --- |\n| x | y |\n| a | b |\n"
    found = tree(spark, [(md, ["1 Drainage"], "Légende", 22, "table")])
    assert [r.content_type for r in found] == ["section", "table_full", "table_summary", "table_row", "table_row"]
    section, full, short, row, _ = found
    assert section.page_start == section.page_end == 22 and section.image_anchor == section.figure_title == "Légende" and section.contains_image
    assert full.content.startswith("[1 Drainage] Tableau : Légende (p.22)\n\n| Col1") and short.content.startswith("[1 Drainage] Tableau clé-valeur : Légende (p.22)\n\nCol1 → Col2\n\nx → y")
    assert short.parent_node_id == row.parent_node_id == full.node_id and full.parent_node_id == section.node_id and row.row_index == 0
    assert row.content == "[1 Drainage] Tableau (Légende) — p.22 — Ligne 1/2: col1:Col1=x | col2:Col2=y"


def test_wide_and_broken_tables(spark):
    wide = "| A | B | C |\n|---|---|---|\n| 1 | 2 |\n"
    assert [(r.content_type, r.suspicious) for r in tree(spark, [(wide, None)])] == [("section", None), ("table_full", None), ("table_row", True)]
    for text in ("| only | heading |\n|---|---|", "| a | b |", "no table | here"):
        assert [r.content_type for r in tree(spark, [(text, None, None, None, "table")])] == ["section", "text_full"]
    late = "intro\n\n| a | b |\n| c | d |"
    assert [r.content_type for r in tree(spark, [(late, None, None, None, "table")])] == ["section", "text_full"]
    parted = "| a | b |\n\n| c | d |"
    assert [r.content_type for r in tree(spark, [(parted, None, None, None, "table")])] == ["section", "table_full", "table_summary", "table_row"]


def test_windows_lists_and_pictures(spark):
    found = tree(spark, [("x" * 200, ["1 Intro"]), ("* one", ["1 Intro", " Deep "], None, 3, "list"), ("A drawing", ["1 Intro"], "Fig. 1", 2, "picture")], threshold=80, overlap=10)
    kinds = [r.content_type for r in found]
    assert kinds == ["section", "text_full", "text_window", "text_window", "text_window", "text_full", "section", "text_full"]
    assert all(r.parent_node_id == found[1].node_id and r.hierarchy_level == 2 for r in found[2:5]) and found[2].content.startswith("(Fenêtre 1/3)\n\nFil d'Ariane : 1 Intro\n\nxx")
    assert found[5].content == "Fil d'Ariane : 1 Intro\np.2\n\nA drawing\n\nFig. 1" and found[5].contains_image and found[1].image_anchor == "Fig. 1"
    assert found[7].content == "Fil d'Ariane : 1 Intro > Deep\np.3\n\n[Liste: Deep]\n* one" and found[6].heading == "1 Intro Deep" and found[0].page_start == found[0].page_end == 2


def test_captions(spark):
    schema = "m map<string, string>, i array<struct<label: string, caption: string, title: string>>"
    rows = [({"figure_title": " F ", "image_caption": "I"}, None), ({"caption": " "}, [("text", None, "T"), ("table", None, "U")]), (None, [("text", " c ", None)]), ({}, [("picture", "", " ")]), (None, None)]
    found = [r.c for r in spark.createDataFrame(rows, schema).select(H.caption_of(F.col("m"), F.col("i")).alias("c")).collect()]
    assert found == ["F", "U", "c", None, None]


def test_outline(spark):
    rows = [("text", None, "before"), ("title", 1, "A"), ("title", 3, "A.x.1"), ("text", None, "t1"), ("title", 2, "A.y"), ("text", None, "t2"), ("title", 2, " "), ("table", None, "| a |"), ("caption", None, "Cap"), ("title", 1, "B"), ("caption", None, "lone"), ("text", None, "t3")]
    held = spark.createDataFrame([(d, i, *r, 7) for d in (1, 2) for i, r in enumerate(rows)], "document_id long, pos int, kind string, level int, content string, page_no int")
    found = [(r.content, r.headings, r.caption, r.label) for r in H.outline(held).where("document_id = 2").orderBy("pos").collect()]
    assert found == [("before", [], None, "text"), ("t1", ["A", "A.x.1"], None, "text"), ("t2", ["A", "A.y"], None, "text"), ("| a |", ["A", "A.y"], "Cap", "table"), ("t3", ["B"], None, "text")]
    assert H.outline(held).columns == ["document_id", "pos", "label", "content", "page_no", "caption", "headings"]


def test_climb(spark):
    nodes = [("s", None, False, "Section "), ("t", "s", True, " Table "), ("r", "t", True, "Row"), ("b", "s", True, "  "), ("x", "b", True, "X"), ("lost", "gone", True, "L"), ("c1", "c2", True, "1"), ("c2", "c1", True, "2"), ("d1", "r", True, "d1"), ("d2", "d1", True, "d2")]
    held = spark.createDataFrame([(1, *n) for n in nodes] + [(2, "t", None, False, "other")], "document_id long, node_id string, parent_node_id string, is_leaf boolean, content string")
    leaves = spark.createDataFrame([(i, 1, p) for i, p in enumerate(["s", "t", "r", "x", "lost", "c1", None, "none", "d1", "d2", "t"])], "leaf long, document_id long, parent_node_id string")
    found = {r.leaf: (r.target_id, r.content, r.climbed) for r in parents.climb(leaves, held).collect()}
    line = "\n\n---\n\n"
    lost = (None, None, None)
    assert found == {
        0: ("s", "Section", 1), 1: ("s", f"Table{line}Section", 2), 2: ("s", f"Table{line}Row{line}Section", 3), 3: ("s", f"X{line}Section", 3), 4: lost, 5: lost, 6: lost, 7: lost,
        8: ("s", f"Table{line}Row{line}d1{line}Section", 4), 9: lost, 10: ("s", f"Table{line}Section", 2),
    }


def computed(df, what):
    """How often the optimised plan computes an expression."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_tables_are_parsed_once(spark):
    text = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| c | d |")], "document_id long, content string")
    parsed = tables.parse(text).where("size(lines) > 0").select("headers", "lines", tables.canonical(F.col("headers"), F.col("lines")).alias("grid"))
    assert computed(parsed, "split(content") == 1 and computed(parsed, "rpad(") == 2
    assert parsed.collect() == [(["a", "b"], [["c", "d"]], "| a | b |\n|---|---|\n| c | d |")]
    leaves = spark.createDataFrame([(1, 0, "| a |\n| c |", None, None, None, "table")], LEAF)
    assert computed(H.chunks(leaves), "split(") <= 40


def test_cells_and_blanks(spark):
    text = "|\u00a0x | a \u2013 b \\| c |\t\n"
    assert [r.c for r in spark.createDataFrame([(text,)], "t string").select(tables.cells(F.col("t")).alias("c")).collect()] == [["x", "a - b \\| c"]]


def test_rows_of_one_file_are_parsed_by_many_tasks(spark):
    assert queries._table_rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_climb_reads_texts_of_parents_alone(spark):
    """The texts of rows and summaries aren't kept, and a section's is hashed once."""
    held = []
    climb, parents.climb = parents.climb, lambda leaves, nodes: held.append((leaves, nodes)) or climb(leaves, nodes)
    try:
        documents.parent_climb(spark, "/root/testdata/sf0.001")
    finally:
        parents.climb = climb
    leaves, nodes = held[0]
    assert leaves.count() == leaves.select("document_id", "parent_node_id").distinct().count()
    assert nodes.where("content_type IN ('table_row', 'table_summary')").count() == 0
