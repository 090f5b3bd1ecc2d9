"""Documents as trees of sections, texts, tables and their rows, from structured elements.

Headings are kept as a stack: each level's last heading, which a heading of a higher level clears. Captions go to the pictures and
tables beside them and to their sections. A section is a parent; below it stand whole texts with windows of long ones, and whole
tables with a summary (of two columns) and a row each. All is made of windows and arrays within a document, which is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.operators import chunking, tables
from quarry.operators.structure import NO_HEADING

#: Where captions may stand, in order, and what has them.
CAPTION_KEYS, CAPTIONED = ("caption", "figure_title", "caption_text", "image_caption"), ("picture", "table", "figure")
#: The words around texts and tables: Fil d'Ariane, Liste, Fenêtre, Tableau, Tableau clé-valeur, p.


def outline(elements: DataFrame, levels: int = 6) -> DataFrame:
    """Leaves of documents with headings and caption.

    elements: document_id, pos, kind (title, caption or a leaf's label), level (of titles), content, and others. A title of a level stands
    until the next of its level or of a higher one; blank titles are none. A caption belongs to the picture or table before it.
    """
    order = Window.partitionBy("document_id").orderBy("pos")
    title = lambda n: (F.col("kind") == "title") & (F.col("level") == n) & (T.strip("content") != "")
    last = {f"_t{n}": F.max(F.when(title(n), F.struct("pos", T.strip("content").alias("content")))).over(order) for n in range(1, levels + 1)}
    following = F.when(F.lead("kind").over(order) == "caption", F.lead("content").over(order))
    rows = elements.withColumns({**last, "caption": F.when(F.col("kind").isin(*CAPTIONED), F.nullif(T.strip(following), F.lit("")))})
    stands, above = [], F.lit(None).cast("long")
    for n in range(1, levels + 1):
        own = F.col(f"_t{n}.pos").cast("long")
        stands.append(F.when(own > F.coalesce(above, F.lit(-1)), F.col(f"_t{n}.content")))
        above = F.greatest(above, own)
    rows = rows.withColumn("headings", F.filter(F.array(*stands), lambda h: h.isNotNull()))
    return rows.where(~F.col("kind").isin("title", "caption")).drop(*last, "level").withColumnRenamed("kind", "label")


def path(headings: Column) -> Column:
    """Headings without blank ones, trimmed."""
    return F.filter(F.transform(F.coalesce(headings, F.array().cast("array<string>")), lambda h: T.strip(h)), lambda h: h != "")


def heading_label(headings: Column) -> Column:
    """What a section is called: all its headings in a row."""
    joined = F.array_join(path(headings), " ")
    return F.when(joined == "", NO_HEADING).otherwise(joined)


def caption_of(metadata: Column, items: Column) -> Column:
    """A leaf's caption: by the keys of its metadata, else the first of its items that has one, or a title if it is a picture or table."""
    text = lambda c: F.nullif(T.strip(c), F.lit(""))
    own = [text(F.try_element_at(metadata, F.lit(k))) for k in CAPTION_KEYS]
    of = lambda x: F.coalesce(text(x["caption"]), F.when(x["label"].isin("picture", "table") & (F.coalesce(x["caption"], F.lit("")) == ""), text(x["title"])))
    return F.coalesce(*own, F.get(F.filter(F.transform(items, of), lambda c: c.isNotNull()), F.lit(0)))


def holds_table(text: Column) -> Column:
    """Whether a text begins with a table of a heading and a row that isn't blank."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), T.strip), lambda x: x != "")
    full = lambda x: F.exists(tables.cells(x), lambda c: c != "")

    def holds(barred: Column) -> Column:
        ruled = F.replace(F.get(barred, F.lit(1)), F.lit(" "), F.lit("")).rlike(r"^\|?[\s\-:|]+\|[\s\-:|]*$")
        data = F.slice(barred, F.when(ruled, 3).otherwise(2), F.greatest(F.size(barred), F.lit(1)))
        return F.when(F.size(barred) >= 2, F.when(full(F.get(barred, F.lit(0))), F.exists(data, full)))

    return F.coalesce(F.when(T.strip(text).startswith("|"), T.let(F.filter(lines, lambda x: x.startswith("|")), holds)), F.lit(False))


def text_block(body: Column, headings: Column, page: Column) -> Column:
    """The path of headings and the page, a blank line if there is either, the text."""
    top = F.concat_ws("\n", F.when(F.size(headings) > 0, F.concat(F.lit("Fil d'Ariane : "), F.array_join(headings, " > "))), F.when(page.isNotNull(), F.concat(F.lit("p."), page.cast("string"))))
    return F.concat(F.when(top == "", "").otherwise(F.concat(top, F.lit("\n\n"))), T.strip(body))


def _table_title(kind: str, heading: Column, caption: Column, page: Column) -> Column:
    named = F.when(caption.isNotNull(), F.concat(F.lit(f"{kind} : "), caption)).otherwise(F.lit(kind))
    return F.concat_ws(" ", F.when(heading != "", F.concat(F.lit("["), heading, F.lit("]"))), named, F.when(page.isNotNull(), F.concat(F.lit("(p."), page.cast("string"), F.lit(")"))))


def _part(suffix: Column | str, above: Column | str, level: int, kind: str, content: Column, row: Column | None = None, odd: Column | None = None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        text(suffix).alias("suffix"), text(above).alias("above"), F.lit(level).alias("hierarchy_level"), F.lit(kind).alias("content_type"), content.alias("content"),
        (F.lit(None) if row is None else row).cast("long").alias("row_index"), (F.lit(None) if odd is None else odd).cast("boolean").alias("suspicious"),
    )


def chunks(leaves: DataFrame, threshold: int = 0, overlap: int = 200) -> DataFrame:
    """The tree of each document, in order.

    leaves: document_id, pos, content, headings (array), caption, page_no, label. Result: document_id, chunk_index, node_id, parent_node_id,
    hierarchy_level, is_leaf, content_type (section, text_full, text_window, table_full, table_summary, table_row), heading, heading_path, page_no,
    page_start, page_end, image_anchor, figure_title, contains_image, row_index, suspicious, content. Windows are made of texts of more
    than threshold characters if it isn't 0. Sections of blank leaves alone are left out, as are blank leaves.
    """
    rows = tables.once(leaves.repartition("document_id"), _path=path(F.col("headings")), _body=T.strip(F.coalesce("content", F.lit(""))))
    joined = F.array_join("_path", " ")
    rows = tables.once(rows, _label=F.when(joined == "", NO_HEADING).otherwise(joined), heading=joined)
    own = Window.partitionBy("document_id", "_label")
    held = F.array_sort(F.collect_list(F.when(F.col("caption").isNotNull(), F.struct("pos", "caption"))).over(own))
    rows = rows.withColumns({"_first": F.min("pos").over(own), "_anchors": F.array_distinct(F.transform(held, lambda x: x["caption"]))})
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "_body"))), lambda x: x["_body"])
    parents = rows.groupBy("document_id", "_first", "heading", "_anchors").agg(T.strip(F.array_join(texts, "\n\n")).alias("content"), F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    section = F.concat_ws(":", "document_id", "_first")
    none = F.lit(None)
    anchor, first = F.when(F.size("_anchors") > 0, F.array_join("_anchors", " ; ")), F.get("_anchors", F.lit(0))
    parents = parents.where("content <> ''").select(
        "document_id", "_first", F.lit(-1).cast("long").alias("_pos"), F.lit(0).alias("_sub"), section.alias("node_id"), none.cast("string").alias("parent_node_id"), F.lit(0).alias("hierarchy_level"), F.lit(False).alias("is_leaf"), F.lit("section").alias("content_type"),
        "heading", none.cast("array<string>").alias("heading_path"), F.col("page_start").alias("page_no"), "page_start", "page_end", anchor.alias("image_anchor"), first.alias("figure_title"), (F.size("_anchors") > 0).alias("contains_image"),
        none.cast("long").alias("row_index"), none.cast("boolean").alias("suspicious"), "content",
    )
    body, page, captioned = F.col("_body"), F.col("page_no"), F.coalesce(F.col("label").isin(*CAPTIONED), F.lit(False))
    body = F.when(captioned & F.col("caption").isNotNull(), F.concat(body, F.lit("\n\n"), "caption")).otherwise(body)
    title = F.coalesce(F.try_element_at("_path", F.lit(-1)), F.col("heading"))
    body = F.when((F.col("label") == "list") & (title != ""), F.concat(F.lit("[Liste: "), title, F.lit("]\n"), body)).otherwise(body)
    rows = tables.once(rows.where("_body <> ''"), _raw=body)
    tabled = (F.col("label") == "table") | F.col("_raw").startswith("|")
    rows = tables.once(rows, _start=F.when(tabled, T.strip(F.get(F.split("_raw", "\n\n"), F.lit(0)))))
    source = F.when(holds_table(F.col("_start")), F.col("_start")).when(holds_table(F.col("_raw")), F.col("_raw"))
    rows = tables.once(rows, _table=F.when(tabled, source))

    plain = rows.where("_table IS NULL")
    parts = F.array(_part("", "", 1, "text_full", text_block(F.col("_raw"), F.col("_path"), page)))
    if threshold > 0:
        step = threshold - max(0, min(overlap, threshold // 2))
        plain = plain.withColumn("_w", F.when(F.length("_raw") > threshold, chunking.windows_of(F.col("_raw"), F.lit(threshold), F.lit(step), trim=False)))
        window = lambda w, i: _part(F.concat(F.lit(":w"), i.cast("string")), "", 2, "text_window", F.concat(F.lit("(Fenêtre "), (i + 1).cast("string"), F.lit("/"), F.size("_w").cast("string"), F.lit(")\n\n"), text_block(w["content"], F.col("_path"), page)))
        parts = F.concat(parts, F.coalesce(F.transform("_w", window), F.slice(parts, 1, 0)))
    keep = ["document_id", "_first", "pos", "heading", "_path", "page_no", "_anchors", "label"]
    plain = plain.select(*keep, F.posexplode(parts).alias("_sub", "_x"))

    parsed = tables.parse(rows.where("_table IS NOT NULL"), "_table")
    headers, lines, caption, heading = F.col("headers"), F.col("lines"), F.col("caption"), F.col("heading")
    whole = _part("", "", 1, "table_full", F.concat(_table_title("Tableau", heading, caption, page), F.lit("\n\n"), tables.canonical(headers, lines)))
    summary = tables.summary(headers, lines, _table_title("Tableau clé-valeur", heading, caption, page))
    short = F.when(F.size(headers) == 2, F.array(_part(":s", "", 2, "table_summary", summary))).otherwise(F.slice(F.array(whole), 1, 0))
    odd = lambda i: F.array_contains("suspicious", i)
    each = F.transform(lines, lambda line, i: _part(F.concat(F.lit(":r"), i.cast("string")), "", 2, "table_row", tables.row_text(headers, line, i, F.size(lines), heading, caption, page, odd(i)), i, odd(i)))
    tabled = parsed.select(*keep, F.posexplode(F.concat(F.array(whole), short, each)).alias("_sub", "_x"))

    both = plain.unionByName(tabled)
    leaf, kind = F.concat_ws(":", section, "pos"), F.col("_x.content_type")
    marked = kind.isin("text_full", "table_full", "table_row")
    both = both.select(
        "document_id", "_first", F.col("pos").cast("long").alias("_pos"), "_sub", F.concat(leaf, "_x.suffix").alias("node_id"), F.when(F.col("_x.hierarchy_level") == 1, section).otherwise(leaf).alias("parent_node_id"), "_x.hierarchy_level", F.lit(True).alias("is_leaf"), "_x.content_type",
        "heading", F.when(kind.isin("text_full", "text_window"), F.col("_path")).alias("heading_path"), "page_no", none.cast(leaves.schema["page_no"].dataType).alias("page_start"), none.cast(leaves.schema["page_no"].dataType).alias("page_end"), F.when(marked, anchor).alias("image_anchor"), F.when(marked, first).alias("figure_title"),
        ((kind == "table_row") | (kind == "text_full") & ((F.size("_anchors") > 0) | captioned)).alias("contains_image"), "_x.row_index", "_x.suspicious", "_x.content",
    )
    order = Window.partitionBy("document_id").orderBy("_first", "_pos", "_sub")
    return parents.unionByName(both).withColumn("chunk_index", F.row_number().over(order).cast("long") - 1).drop("_first", "_pos", "_sub")
