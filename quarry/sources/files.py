"""Uploaded files: landing, MIME types, parsers in order with a fallback for each row, storage figures.

Files are rows of name and content (binary). Nothing here shuffles but storage_stats, and no file leaves its task.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as T
from quarry.operators import structure

#: The largest upload.
MOST_BYTES = 50 * 1024 * 1024
#: First bytes of formats, in hex.
SIGNATURES = {
    "25504446": "application/pdf",
    "89504E47": "image/png",
    "FFD8FF": "image/jpeg",
    "47494638": "image/gif",
    "424D": "image/bmp",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
}
#: What can be parsed at all, here or by a converter.
SUPPORTED = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
    "application/vnd.ms-word.document.macroEnabled.12",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.ms-excel",
    "text/csv",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.ms-powerpoint",
    "image/png",
    "image/jpeg",
    "image/jpg",
    "image/tiff",
    "image/bmp",
    "text/plain",
    "text/markdown",
    "application/json",
    "text/html",
)
_ELEMENT = "struct<index:int,type:string,content:string,rows:int,cols:int>"
_RESULT = f"struct<parser:string,content:string,elements:array<{_ELEMENT}>>"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length, modificationTime, content of all files below folder; content isn't read where it isn't used. Spark leaves empty files out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", "content")


def land(files: DataFrame, folder: str) -> DataFrame:
    """Writes files of at most 50 MiB as Parquet below folder, each under a random name with its suffix, and reads them: stored_name, name, content."""
    suffix = F.regexp_extract("name", r"(\.[^./]*)$", 1)
    files.where(F.octet_length("content") <= MOST_BYTES).select(F.concat(F.uuid(), suffix).alias("stored_name"), "name", "content").write.mode("append").parquet(folder)
    return files.sparkSession.read.parquet(folder)


def mime_type(name: Column | str, content: Column | str) -> Column:
    """By the first bytes, else by the extension."""
    head = F.hex(F.substring(T.col(content), 1, 8))
    known = [F.when(head.startswith(first), F.lit(kind)) for first, kind in SIGNATURES.items()]
    return F.coalesce(*known, T.mime_type(name))


def is_supported(mime: Column | str) -> Column:
    return T.col(mime).isin(*SUPPORTED)


@F.pandas_udf(StringType())
def _pretty(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return texts.map(one, na_action="ignore").astype(object)


def csv_records(text: Column | str) -> Column:
    """Records of comma-separated text as arrays of cells.

    Cells in quotes may hold commas, line ends and doubled quotes; a quote within a bare cell is a sign like others; an
    open quote goes to the end. A blank line is a record without cells. Null gives null, an empty text no records.
    """
    cell = r'(?:"(?:[^"]++|"")*+"?[^,\n]*+|[^,\n]*+)'
    raw = F.regexp_extract_all(F.concat(F.lit("\n"), T.col(text)), F.lit(rf"\n({cell}(?:,{cell})*+)"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(f",({cell})"), F.lit(1))
    quoted = r'(?s)\A"((?:[^"]++|"")*+)"?(.*)\z'
    value = lambda x: F.when(x.startswith('"'), F.concat(F.replace(F.regexp_extract(x, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(x, quoted, 2))).otherwise(x)
    raw = F.when(F.element_at(raw, -1) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)  # what follows the last line end
    records = F.transform(raw, lambda r: F.when(r == "", F.array().cast("array<string>")).otherwise(F.transform(cells(r), value)))
    return records


def grid(records: Column) -> Column:
    """Records as a table of Markdown, the first as its header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |\n"))
    rule = line(F.transform(F.get(records, F.lit(0)), lambda x: F.lit("---")))
    return F.when(F.size(records) == 0, "").otherwise(F.concat(line(F.get(records, F.lit(0))), rule, F.array_join(F.transform(F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0))), line), "")))


def _markdown(found: Column) -> Column:
    mark = lambda x: F.when(x["kind"] == "title", "# ").when(x["kind"] == "list", "- ").otherwise("")
    return F.array_join(F.transform(found, lambda x: F.concat(mark(x), x["content"])), "\n\n")


def _result(parser: str, content: Column, elements: Column) -> Column:
    return F.struct(F.lit(parser).alias("parser"), content.alias("content"), elements.cast(f"array<{_ELEMENT}>").alias("elements"))


def _one(kind: str, content: Column, rows: Column | None = None, cols: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.array(F.struct(F.lit(0).alias("index"), F.lit(kind).alias("type"), content.alias("content"), (none if rows is None else rows).alias("rows"), (none if cols is None else cols).alias("cols")))


def parse(files: DataFrame) -> DataFrame:
    """files and mime, parser, parsed (text), elements (index, type, content, rows, cols), error.

    Parsers are tried in order for each row, the first with a result counts: pages by their elements, then by their text;
    comma-separated values as a grid; JSON with indents, its keys in their order; plain text and Markdown as they are. Line ends become \\n.
    Without a result parsed and elements are null, and error is no content (null), unsupported (no parser for the type),
    encoding (not UTF-8) or invalid (no parser could read it). Empty texts are texts; repeated rows stay; columns of these
    names are replaced. A file is held by its task as a whole.
    """
    plain = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), r"\r\n?", "\n")
    rows = files.withColumn("mime", mime_type("name", "content")).withColumn("_text", plain)
    of = lambda *kinds: F.col("mime").isin(*kinds)
    text = F.col("_text")
    rows = rows.withColumns({
        "_json": _pretty(F.when(of("application/json"), text)),
        "_csv": F.when(of("text/csv"), csv_records(text)),
        "_found": F.when(of("text/html"), structure.element_list(text)),
    })
    rows = rows.withColumn("_grid", F.when(F.col("_csv").isNotNull(), grid(F.col("_csv"))))
    found, records = F.col("_found"), F.col("_csv")
    none = F.lit(None).cast("int")
    listed = F.transform(found, lambda x, i: F.struct(i.alias("index"), x["kind"].alias("type"), x["content"].alias("content"), none.alias("rows"), none.alias("cols")))
    page = T.html_text(F.when(of("text/html") & (F.size(found) == 0), text))
    table = F.when(F.size(records) == 0, F.array().cast(f"array<{_ELEMENT}>")).otherwise(_one("table", F.col("_grid"), F.size(records), F.size(F.get(records, F.lit(0)))))
    tried = F.coalesce(
        F.when(F.size(found) > 0, _result("sections", _markdown(found), listed)),
        F.when(page != "", _result("page", page, _one("text", page))),
        F.when(F.col("_grid").isNotNull(), _result("grid", F.col("_grid"), table)),
        F.when(F.col("_json").isNotNull(), _result("json", F.col("_json"), _one("text", F.col("_json")))),
        F.when(of("text/plain", "text/markdown") & text.isNotNull(), _result("text", text, _one("text", text))),
        F.lit(None).cast(_RESULT),
    )
    parsers = of("text/html", "text/csv", "application/json", "text/plain", "text/markdown")
    why = F.when(F.col("content").isNull(), "no content").when(~parsers, "unsupported").when(text.isNull(), "encoding").when(F.col("_tried").isNull(), "invalid")
    rows = rows.withColumn("_tried", tried).withColumn("error", why)
    rows = rows.withColumns({"parser": F.col("_tried.parser"), "parsed": F.col("_tried.content"), "elements": F.col("_tried.elements")})
    return rows.drop("_text", "_json", "_csv", "_found", "_grid", "_tried")


def elements_of(elements: Column | str, kind: str) -> Column:
    """The elements of one type."""
    return F.filter(T.col(elements), lambda x: x["type"] == kind)


def storage_stats(files: DataFrame) -> DataFrame:
    """Of files (path, length) below user_N and user_N/project_M: user_id, project_id (null: all of the user's), file_count, total_size, total_size_mb."""
    below = lambda name: F.expr(f"try_cast(regexp_extract(path, '(?:^|/){name}_([0-9]+)/', 1) AS BIGINT)")
    rows = files.select(below("user").alias("user_id"), below("project").alias("project_id"), "length").where("user_id IS NOT NULL")
    rows = rows.rollup("user_id", "project_id").agg(F.grouping_id().alias("_level"), F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_size"))
    rows = rows.where("_level = 1 OR _level = 0 AND project_id IS NOT NULL").drop("_level")
    return rows.withColumn("total_size_mb", F.round(F.col("total_size") / (1024 * 1024), 2))
