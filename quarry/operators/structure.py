"""Elements of pages, sections by headings, chunks of sections, nested windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T

#: Sizes of nested windows, those of long texts, and from how many characters a text is long.
SIZES, LONG_SIZES, LONG_FROM = (3072, 1024, 384), (4096, 1536, 512), 200_000
#: The longest element that stays whole, and what stands for no heading.
WHOLE, NO_HEADING = 750, "__no_heading__"


def clean(html: Column) -> Column:
    """Text of a piece of HTML, with single spaces."""
    return T.strip(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def element_list(html: Column | str) -> Column:
    """Titles, paragraphs and list items of a page in order, as an array of kind and content; blank ones are left out."""
    marked = F.split(F.regexp_replace(T.col(html), r"(?i)<(h[1-6]|p|li)(\s[^>]*)?>", "\u0001$1\u0002"), "\u0001")
    parts = F.slice(marked, 2, F.size(marked))
    tag = lambda x: F.lower(F.split_part(x, F.lit("\u0002"), F.lit(1)))
    kind = lambda x: F.when(tag(x) == "p", "paragraph").when(tag(x) == "li", "list").otherwise("title")
    body = lambda x: clean(F.split_part(F.split_part(F.split_part(x, F.lit("\u0002"), F.lit(2)), F.lit("</ul>"), F.lit(1)), F.lit("</article>"), F.lit(1)))
    return F.filter(F.transform(parts, lambda x: F.struct(kind(x).alias("kind"), body(x).alias("content"))), lambda x: x["content"] != "")


def elements(pages: DataFrame) -> DataFrame:
    """The elements of pages (page_id, html): page_id, pos, kind, content; no shuffle."""
    return pages.select("page_id", F.posexplode(element_list("html")).alias("pos", "x")).select("page_id", "pos", "x.kind", "x.content")


def section_list(found: Column) -> Column:
    """Sections of a page's elements, element_list(), as an array of heading and items (pos, kind, content); titles themselves are left out.

    Sections of one heading are one, where it is first seen. Elements are parted at titles, and what lies between is put in order of headings.
    """
    item = lambda e, i: F.struct(i.alias("pos"), e["kind"].alias("kind"), e["content"].alias("content"))
    title = lambda e: e["kind"] == "title"
    full = lambda x: F.filter(x, lambda i: i.isNotNull())
    until = lambda starts, i, x: F.coalesce(F.get(starts, i + 1), F.size(x))

    def between(x: Column, starts: Column) -> Column:
        def run(s: Column, i: Column) -> Column:
            own = F.when(title(F.get(x, s)), 1).otherwise(0)
            items = F.slice(x, s + own + 1, until(starts, i, x) - s - own)
            return F.struct(F.when(own == 1, F.get(x, s)["content"]).otherwise(NO_HEADING).alias("heading"), s.alias("start"), items.alias("items"))

        return F.sort_array(F.filter(F.transform(starts, run), lambda r: F.size(r["items"]) > 0))

    def joined(x: Column, starts: Column) -> Column:
        one = lambda s, i: F.struct(F.get(x, s)["start"].alias("start"), F.get(x, s)["heading"].alias("heading"), F.flatten(F.transform(F.slice(x, s + 1, until(starts, i, x) - s), lambda r: r["items"])).alias("items"))
        return F.sort_array(F.transform(starts, one))

    parted = T.let(F.transform(found, item), lambda x: T.let(full(F.transform(x, lambda e, i: F.when((i == 0) | title(e), i))), lambda starts: between(x, starts)))
    return T.let(parted, lambda x: T.let(full(F.transform(x, lambda r, i: F.when((i == 0) | (r["heading"] != F.get(x, i - 1)["heading"]), i))), lambda starts: joined(x, starts)))


def sections(pages: DataFrame) -> DataFrame:
    """Sections of pages (page_id, html): page_id, section (running number), heading, items (pos, kind, content); no shuffle, and a task holds a page."""
    return pages.select("page_id", F.posexplode(section_list(element_list("html"))).alias("section", "x")).select("page_id", "section", "x.heading", "x.items")


def _text(items: str = "items") -> Column:
    return F.array_join(F.transform(items, lambda e: e["content"]), "\n\n")


def section_parents(rows: DataFrame) -> DataFrame:
    """page_id, section, heading, leaves, first_pos, last_pos, content (the leaves' texts, parted by blank lines)."""
    return rows.select("page_id", "section", "heading", F.size("items").cast("long").alias("leaves"), F.get("items", F.lit(0))["pos"].alias("first_pos"), F.element_at("items", -1)["pos"].alias("last_pos"), _text().alias("content"))


def text_block(heading: Column, page: Column, body: Column) -> Column:
    """A breadcrumb line if there is a heading, the page's line, a blank line, the body."""
    return F.concat(F.when(heading != NO_HEADING, F.concat(heading, F.lit("\n"))).otherwise(""), F.lit("p."), page.cast("string"), F.lit("\n\n"), body)


def section_chunks(rows: DataFrame, limit: int, overlap: int) -> DataFrame:
    """A parent for each section, then its leaves in order; a leaf of more than limit characters is followed by windows.

    page_id, node_id, parent_id (null for parents), level (0, 1, 2), is_leaf, content. A leaf with windows isn't one itself.
    """
    node, step = F.concat_ws(":", "page_id", "section"), limit - overlap
    row = lambda own, parent, level, leaf, content: F.struct(own.alias("node_id"), parent.cast("string").alias("parent_id"), F.lit(level).alias("level"), leaf.alias("is_leaf"), content.alias("content"))

    def below(e: Column) -> Column:
        own, n = F.concat_ws(":", "page_id", "section", e["pos"]), F.length(e["content"])
        leaf = row(own, node, 1, n <= limit, text_block(F.col("heading"), F.col("page_id"), e["content"]))
        starts = F.when(n > limit, F.sequence(F.lit(0), F.ceil((n - limit) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(leaf), F.transform(starts, lambda i: row(F.concat_ws(":", own, i), own, 2, F.lit(True), T.strip(F.substring(e["content"], i * step + 1, F.lit(limit))))))

    nodes = F.concat(F.array(row(node, F.lit(None), 0, F.lit(False), _text())), F.flatten(F.transform("items", below)))
    return rows.select("page_id", F.inline(nodes))


def element_chunks(rows: DataFrame, size: int = WHOLE) -> DataFrame:
    """Each element a chunk with the title before it as section; longer ones in parts of size characters. page_id, chunk_index, kind, section, content."""
    order = Window.partitionBy("page_id").orderBy("pos")
    section = F.last(F.when(F.col("kind") == "title", F.col("content")), ignorenulls=True).over(order)
    rows = rows.withColumn("section", section)
    starts = F.sequence(F.lit(0), F.ceil(F.length("content") / size).cast("int") - 1)
    parts = rows.select("page_id", "pos", "kind", "section", "content", F.explode(starts).alias("part"))
    parts = parts.withColumn("content", T.strip(F.substring("content", F.col("part") * size + 1, F.lit(size)))).where("content <> ''")
    return parts.select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "part")) - 1).alias("chunk_index"), "kind", "section", "content")


def full_text(title: Column, content: Column) -> Column:
    """Title, a blank line and the content; the title alone if there is no content."""
    return F.when(F.coalesce(T.strip(content), F.lit("")) == "", title).otherwise(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), content))


def sizes(length: Column) -> Column:
    """Sizes of nested windows for a text of so many characters, largest first."""
    of = lambda xs: F.array(*map(F.lit, xs))
    return F.reverse(F.array_sort(F.array_distinct(F.when(length >= LONG_FROM, of(LONG_SIZES)).otherwise(of(SIZES)))))


def nested_windows(docs: DataFrame) -> DataFrame:
    """Windows within windows of texts (document_id, content): document_id, level, start, size, parent_start, is_leaf, content; blank ones are left out.

    Each row is made from its text alone, without a shuffle.
    """
    n = F.length("content")
    rows = docs.where(F.length("content") > 0).select("document_id", "content", n.alias("n"), sizes(n).alias("sizes"))
    cut = lambda start, size, end: F.transform(F.sequence(F.lit(0), F.ceil((end - start) / size).cast("int") - 1), lambda i: F.struct((start + i * size).alias("start"), F.least(start + (i + 1) * size, end).alias("end"), start.alias("parent")))
    s = [F.get("sizes", F.lit(i)) for i in range(3)]
    top = cut(F.lit(0), s[0], F.col("n"))
    rows = rows.withColumn("l0", top)
    rows = rows.withColumn("l1", F.flatten(F.transform("l0", lambda w: cut(w["start"], s[1], w["end"]))))
    rows = rows.withColumn("l2", F.flatten(F.transform("l1", lambda w: cut(w["start"], s[2], w["end"]))))
    level = lambda i: F.transform(f"l{i}", lambda w: F.struct(F.lit(i).alias("level"), w["start"].alias("start"), w["end"].alias("end"), F.when(F.lit(i > 0), w["parent"]).alias("parent_start"), T.strip(F.substring(F.col("content"), w["start"] + 1, w["end"] - w["start"])).alias("content")))
    windows = F.filter(F.concat(level(0), level(1), level(2)), lambda w: w["content"] != "")
    return rows.select("document_id", F.explode(windows).alias("w")).select("document_id", "w.level", "w.start", (F.col("w.end") - F.col("w.start")).alias("size"), "w.parent_start", (F.col("w.level") == 2).alias("is_leaf"), "w.content")
