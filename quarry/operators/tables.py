"""Markdown tables in texts, in array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text as T


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, each computed once a row: as they come out of a generator, filters on them and later uses don't repeat them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def cells(line: Column) -> Column:
    """Cells of a line; a pipe after a backslash doesn't part cells."""
    inner = F.translate(F.regexp_replace(T.strip(line), r"^\||\|$", ""), "\u00a0\u202f\u2009\u200b\u2013\u2014\u2015", "    ---")
    return F.transform(F.split(inner, r"(?<!\\)\|", -1), T.strip)


def parse(rows: DataFrame, text: str = "content") -> DataFrame:
    """rows that hold a table, with headers, lines (padded cells of each data row), suspicious and empty (row numbers; row to columns)."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), T.strip), lambda x: x != "")
    rows = once(rows, _all=lines).where((F.size("_all") >= 2) & F.get("_all", F.lit(0)).startswith("|"))
    rows = once(rows, _lines=F.filter("_all", lambda x: x.startswith("|"))).where(F.size("_lines") >= 2)
    rows = once(rows, headers=cells(F.get("_lines", F.lit(0)))).where(F.exists("headers", lambda h: h != ""))
    ruled = F.replace(F.get("_lines", F.lit(1)), F.lit(" "), F.lit("")).rlike(r"^\|?[\s\-:|]+\|[\s\-:|]*$")
    raw = F.transform(F.slice("_lines", F.when(ruled, 3).otherwise(2), F.size("_lines")), cells)
    rows = once(rows, _cells=F.filter(raw, lambda r: F.exists(r, lambda c: c != ""))).where(F.size("_cells") > 0)
    width = F.size("headers")
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    numbered = F.transform("_cells", lambda r, i: F.struct(i.alias("i"), F.size(r).alias("n")))
    rows = once(rows, lines=F.transform("_cells", fit), suspicious=F.transform(F.filter(numbered, lambda r: r["n"] != width), lambda r: r["i"]))
    empty = F.transform("lines", lambda r, i: F.struct(i, F.filter(F.transform(r, lambda c, j: F.when(c == "", j)), lambda j: j.isNotNull())))
    return rows.withColumn("empty", F.map_from_entries(F.filter(empty, lambda e: F.size(e["col2"]) > 0))).drop("_all", "_lines", "_cells")


#: The words of row texts and summaries are those that readers of the tables expect: col, [vide], [décalage probable], Tableau, Ligne, p., →.


def row_text(headers: Column, line: Column, number: Column, total: Column, heading: Column, caption: Column, page: Column, suspicious: Column) -> Column:
    """A row as a sentence that repeats its headers."""
    pairs = F.transform(F.arrays_zip(headers.alias("h"), line.alias("c")), lambda x, i: F.concat(F.lit("col"), (i + 1).cast("string"), F.when(x["h"] != "", F.concat(F.lit(":"), x["h"])).otherwise(""), F.lit("="), F.when(x["c"] != "", x["c"]).otherwise("[vide]")))
    where = F.concat_ws(" — ", F.when(caption.isNotNull() & (caption != ""), F.concat(F.lit("Tableau ("), caption, F.lit(")"))), F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))))
    where = F.concat(F.when(heading != "", F.concat(F.lit("["), heading, F.lit("] "))).otherwise(""), F.when(where != "", where).otherwise("Tableau"))
    label = F.concat(F.lit("Ligne "), (number + 1).cast("string"), F.when(total > 0, F.concat(F.lit("/"), total.cast("string"))).otherwise(""))
    return F.concat(F.when(suspicious, "[décalage probable] ").otherwise(""), where, F.lit(" — "), label, F.lit(": "), F.array_join(pairs, " | "))


def canonical(headers: Column, lines: Column) -> Column:
    """The table as Markdown with aligned columns."""
    widths = F.transform(headers, lambda h, i: F.greatest(F.length(h), F.array_max(F.transform(lines, lambda r: F.length(F.get(r, i))))))

    def grid(widths: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.arrays_zip(r.alias("c"), widths.alias("w")), lambda x: F.rpad(x["c"], x["w"], " ")), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w + 2)), "|"), F.lit("|"))
        return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(lines, line), "\n"))

    return T.let(widths, grid)


def summary(headers: Column, lines: Column, title: Column) -> Column:
    """For tables of two columns: one "key → value" line for each row."""
    named = lambda c: F.when(c != "", c).otherwise("[vide]")
    kept = F.filter(lines, lambda r: (F.get(r, F.lit(0)) != "") | (F.get(r, F.lit(1)) != ""))
    body = F.transform(kept, lambda r: F.concat(named(F.get(r, F.lit(0))), F.lit(" → "), named(F.get(r, F.lit(1)))))
    return F.when(F.size(headers) == 2, F.concat_ws("\n", title, F.lit(""), F.concat_ws(" → ", headers), F.lit(""), F.array_join(body, "\n")))
