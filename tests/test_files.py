"""Uploaded files through landing, MIME types, parsers and storage figures."""

import csv
import io
import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quarry.sources import files


def parsed(spark, rows):
    return {r["name"]: r for r in files.parse(spark.createDataFrame(rows, "name string, content binary")).collect()}


def test_files_of_a_folder(spark, tmp_path):
    below = tmp_path / "user_3" / "project_8"
    below.mkdir(parents=True)
    (below / "a.txt").write_bytes(b"one\r\ntwo")
    (below / "b.csv").write_bytes(b"a,b\n1,\"x, y\"\n")
    (tmp_path / "user_3" / "c.json").write_bytes('{"z": 1, "a": ["é"]}'.encode())
    (tmp_path / "user_3" / "d.txt").write_bytes(b"")
    rows = files.uploads(spark, f"file://{tmp_path}")
    got = {r["name"]: r for r in files.parse(rows).collect()}
    assert got["a.txt"]["parsed"] == "one\ntwo"
    assert got["b.csv"]["parsed"] == "| a | b |\n| --- | --- |\n| 1 | x, y |\n"
    assert (got["b.csv"]["elements"][0]["rows"], got["b.csv"]["elements"][0]["cols"]) == (2, 2)
    assert got["c.json"]["parsed"] == json.dumps({"z": 1, "a": ["é"]}, indent=2, ensure_ascii=False)
    assert "d.txt" not in got  # empty files aren't listed
    stats = {(r["user_id"], r["project_id"]): (r["file_count"], r["total_size"]) for r in files.storage_stats(rows).collect()}
    size = lambda folder: sum(p.stat().st_size for p in folder.rglob("*.*"))
    assert stats == {(3, None): (3, size(tmp_path / "user_3")), (3, 8): (2, size(below))}


def test_fallback_row_by_row(spark):
    got = parsed(spark, [
        ("sections.html", b"<h1>T</h1><p>a &amp; b</p>"), ("bare.html", b"<div>only text</div>"), ("blank.html", b"<div> </div>"), ("broken.json", b'{"a": '), ("deep.json", b"[" * 100_000),
        ("latin.txt", "é".encode("latin-1")), ("none.txt", None), ("page.pdf", b"%PDF-1.7"), ("picture.txt", bytes.fromhex("89504E470D0A1A0A")), ("noext", b"x"), ("empty.txt", b""), ("empty.csv", b""), (None, b"x"),
    ])
    why = {n: (r["parser"], r["error"]) for n, r in got.items()}
    assert why == {
        "sections.html": ("sections", None), "bare.html": ("page", None), "blank.html": (None, "invalid"), "broken.json": (None, "invalid"), "deep.json": (None, "invalid"),
        "latin.txt": (None, "encoding"), "none.txt": (None, "no content"), "page.pdf": (None, "unsupported"), "picture.txt": (None, "unsupported"), "noext": (None, "unsupported"), "empty.txt": ("text", None), "empty.csv": ("grid", None),
        None: (None, "unsupported"),
    }
    assert got["bare.html"]["parsed"] == "only text" and got["picture.txt"]["mime"] == "image/png" and got["empty.csv"]["elements"] == []
    assert [(e["index"], e["type"]) for e in got["sections.html"]["elements"]] == [(0, "title"), (1, "paragraph")]


def test_repeats_clashes_and_empty_tables(spark):
    rows = spark.createDataFrame([("a.txt", b"x", "kept", 1), ("a.txt", b"x", "kept", 1)], "name string, content binary, other string, elements int")
    assert [(r["parsed"], r["other"], len(r["elements"])) for r in files.parse(rows).collect()] == [("x", "kept", 1)] * 2
    assert files.parse(rows.limit(0)).count() == 0 and files.storage_stats(spark.createDataFrame([], "path string, length long")).count() == 0


def test_long_csv(spark):
    """Many quoted cells and doubled quotes in one text."""
    text = "a,b\n" + "".join(f'{i},"q ""{i}"" {"x" * 20}"\n' for i in range(20_000)) + '1,"' + '""' * 50_000 + '"\n'
    got = parsed(spark, [("l.csv", text.encode())])["l.csv"]
    assert got["elements"][0]["rows"] == 20_002 and got["parsed"].endswith("| 1 | " + '"' * 50_000 + " |\n")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab ,"\n', max_size=25), min_size=1, max_size=200))
def test_csv_as_the_standard_reader(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", files.csv_records("t").alias("r"))
    got = {r["i"]: r["r"] for r in frame.collect()}
    assert [got[i] for i in range(len(texts))] == [list(csv.reader(io.StringIO(t))) for t in texts]


@pytest.mark.parametrize("mime, ok", [("text/html", True), ("application/pdf", True), ("application/zip", False), (None, None)])
def test_supported(spark, mime, ok):
    assert spark.createDataFrame([(mime,)], "m string").select(files.is_supported("m")).first()[0] is ok


def test_landing(spark, tmp_path):
    rows = spark.createDataFrame([("a.b.txt", b"x"), ("noext", b"y"), ("none.txt", None)], "name string, content binary")
    got = files.land(rows, f"file://{tmp_path}/landed").orderBy("name").collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("a.b.txt", b"x"), ("noext", b"y")]
    assert got[0]["stored_name"].endswith(".txt") and len(got[0]["stored_name"]) == 40 and len(got[1]["stored_name"]) == 36
    assert files.land(rows.where(F.lit(False)), f"file://{tmp_path}/landed").count() == 2
