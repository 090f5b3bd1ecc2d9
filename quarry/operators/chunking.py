"""Chunking: one row of text to many, in closed form where the cut points allow it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T


def windows_of(text: Column, size: Column, step: Column, trim: bool = True) -> Column:
    """Windows as an array of start_char, end_char (untrimmed), content; the last is the first that reaches the end. They overlap by a step at most.

    The text is cut into steps in one pass, and each window is a step and the start of the next.
    """
    steps = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), step.cast("string"), F.lit("}")), F.lit(0))
    joined = T.let(steps, lambda x: F.zip_with(x, F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))), lambda p, q: F.concat(p, F.coalesce(q.substr(F.lit(1), size - step), F.lit("")))))

    def placed(n: Column) -> Column:
        count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
        return F.transform(F.slice(joined, F.lit(1), count), lambda w, i: F.struct((i * step).cast("long").alias("start_char"), F.least(i * step + size, n).cast("long").alias("end_char"), (T.strip(w) if trim else w).alias("content")))

    return T.let(F.length(text), placed)  # counted once, not once a window


def _full(windows: Column) -> Column:
    return F.filter(windows, lambda w: w["content"] != "")


def fixed_windows(docs: DataFrame, size: int, overlap: int, text: str = "content") -> DataFrame:
    """docs, with text replaced by trimmed windows: chunk_index, start_char, end_char (untrimmed). Blank windows go. No shuffle; overlap is half of size at most."""
    key = [c for c in docs.columns if c != text]
    windows = _full(windows_of(F.col(text), F.lit(size), F.lit(size - overlap)))
    rows = docs.where(F.length(text) > 0).select(*key, F.posexplode(windows).alias("chunk_index", "_w"))
    return rows.select(*key, F.col("_w.content").alias(text), "_w.start_char", "_w.end_char", F.col("chunk_index").cast("long").alias("chunk_index"))


def sliding_windows(blocks: DataFrame, size: int, overlap: int, text: str = "content") -> DataFrame:
    """Windows of blocks that are longer than size, untrimmed: window_index, window_count, content."""
    overlap = max(0, min(overlap, size // 2))
    key = [c for c in blocks.columns if c != text]
    rows = blocks.where(F.length(text) > size).select(*key, windows_of(F.col(text), F.lit(size), F.lit(size - overlap), trim=False).alias("_w"))
    rows = rows.select(*key, F.size("_w").cast("long").alias("window_count"), F.posexplode("_w").alias("window_index", "_x"))
    return rows.select(*key, F.col("window_index").cast("long").alias("window_index"), "window_count", F.col("_x.content").alias(text))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Non-blank paragraphs of documents, trimmed: part, content."""
    rows = docs.select("document_id", F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\n\s*\n+")).alias("part", "content"))
    return rows.select("document_id", F.col("part").cast("long").alias("part"), T.strip("content").alias("content")).where("content <> ''")


def adaptive(docs: DataFrame) -> DataFrame:
    """Windows of paragraphs whose size and overlap depend on the paragraph's class: document_id, part, content_type, content, start_char, end_char, chunk_index. No shuffle."""
    by = lambda kind, procedure, normative, other: F.when(kind == "procedure", procedure).when(kind == "normative", normative).otherwise(other)
    parts = F.transform(F.split(F.coalesce("content", F.lit("")), r"\n\s*\n+"), lambda p, i: F.struct(i.cast("long").alias("part"), T.strip(p).alias("content")))
    parts = F.transform(F.filter(parts, lambda p: p["content"] != ""), lambda p: F.struct(p["part"].alias("part"), T.content_class(p["content"]).alias("kind"), p["content"].alias("content")))
    rows = docs.select("document_id", parts.alias("_parts"))

    def cut(p: Column) -> Column:
        size, step = by(p["kind"], 900, 2000, 4000), by(p["kind"], 675, 1800, 3400)
        return F.transform(_full(windows_of(p["content"], size, step)), lambda w: F.struct(p["part"].alias("part"), p["kind"].alias("content_type"), w["content"].alias("content"), w["start_char"].alias("start_char"), w["end_char"].alias("end_char")))

    rows = rows.select("document_id", F.posexplode(F.flatten(F.transform("_parts", cut))).alias("chunk_index", "_w"))
    return rows.select("document_id", "_w.*", F.col("chunk_index").cast("long").alias("chunk_index"))


def h2_sections(docs: DataFrame) -> DataFrame:
    """Sections from "## " lines, if there are two or more; offsets add up the sections' own lengths and 2."""
    rows = docs.where(F.col("content").contains("\n## ")).select("document_id", F.posexplode(F.split("content", "\n## ")).alias("part", "content"))
    rows = rows.select("document_id", "part", T.strip(F.when(F.col("part") > 0, F.concat(F.lit("## "), "content")).otherwise(F.col("content"))).alias("content")).where("content <> ''")
    by = Window.partitionBy("document_id").orderBy("part")
    before = F.coalesce(F.sum(F.length("content") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"chunk_index": F.row_number().over(by).cast("long") - 1, "start_char": before.cast("long"), "n": F.count("*").over(Window.partitionBy("document_id"))})
    return rows.where("n >= 2").select("document_id", "chunk_index", "content", "start_char", (F.col("start_char") + F.length("content")).alias("end_char"))


def sentences(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Pieces of about size characters that end with a sentence or a word if one ends near there."""
    if not text or len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while start + size < len(text):
        piece = text[start : start + size]
        stop = max(piece.rfind(mark) for mark in (". ", "! ", "? ", "\n\n"))
        space = piece.rfind(" ")
        length = stop + 1 if stop > size - 100 else space if space > size - 50 else size
        out.append(text[start : start + length].strip())
        start += max(length - overlap, 1) if length > overlap else length
    return [x for x in [*out, text[start:].strip()] if x]


def sentence_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """document_id, chunk_index, content: where a piece starts depends on where the last one ended, so this one is in Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = batch["content"].map(lambda t: sentences(t, size, overlap))
            out = batch[["document_id"]].assign(content=cut, chunk_index=cut.map(lambda x: list(range(len(x)))))
            out = out[cut.map(len) > 0].explode(["content", "chunk_index"])
            yield out[["document_id", "chunk_index", "content"]].astype({"chunk_index": "int64"})

    return docs.select("document_id", "content").mapInPandas(run, "document_id long, chunk_index long, content string")
