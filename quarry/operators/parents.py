"""From leaves to passages: parents, climbs, passages, citations, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.session import cut


def resolve(leaves: DataFrame, nodes: DataFrame, hops: int = 4) -> DataFrame:
    """leaves (query_id, node_id, document_id, rank, score) with target_id: climbs parents while they are leaves themselves, hops times at most."""
    own = nodes.select("document_id", F.col("node_id").alias("_node"), F.col("parent_node_id").alias("_parent"), F.col("is_leaf").alias("_leaf"))
    out = leaves.withColumns({"target_id": F.col("node_id"), "climbed": F.lit(0)})
    for _ in range(hops):
        here = own.select("document_id", F.col("_node").alias("target_id"), "_parent", "_leaf")
        out = out.join(here, ["document_id", "target_id"], "left")
        up = F.coalesce(F.col("_leaf"), F.lit(False)) & F.col("_parent").isNotNull()
        out = out.withColumns({"climbed": F.col("climbed") + up.cast("int"), "target_id": F.when(up, F.col("_parent")).otherwise(F.col("target_id"))}).drop("_parent", "_leaf")
    return out


#: Fixed value: what stands between a section's text and the texts of what was climbed over.
BETWEEN = "\n\n---\n\n"


def climb(leaves: DataFrame, nodes: DataFrame, hops: int = 4) -> DataFrame:
    """leaves (document_id, parent_node_id, and others) with target_id, content and climbed: the first node above that isn't a leaf itself.

    nodes: document_id, node_id, parent_node_id, is_leaf, content. Texts of nodes that were climbed over stand before the target's,
    the outermost first; blank ones are left out. Where a node is missing, or none is found in so many hops, target_id and content are null. Each
    parent is climbed from once, however many leaves it has, and a level is only read for those that still climb.
    """
    own = nodes.select("document_id", F.col("node_id").alias("_at"), F.col("parent_node_id").alias("_up"), "is_leaf", F.trim(F.coalesce("content", F.lit(""))).alias("_text"))
    start = leaves.where("parent_node_id IS NOT NULL").select("document_id", "parent_node_id").distinct()
    open_rows, ended = start.select("document_id", "parent_node_id", F.col("parent_node_id").alias("_at"), F.array().cast("array<string>").alias("_over")), None
    for hop in range(1, hops + 1):
        here = cut(open_rows.join(own, ["document_id", "_at"]))
        text = F.concat_ws(BETWEEN, F.reverse("_over"), F.col("_text"))
        found = here.where("NOT is_leaf").select("document_id", "parent_node_id", F.col("_at").alias("target_id"), text.alias("content"), F.lit(hop).alias("climbed"))
        ended = found if ended is None else ended.union(found)
        over = F.when(F.col("_text") != "", F.concat("_over", F.array("_text"))).otherwise(F.col("_over"))
        open_rows = here.where("is_leaf AND _up IS NOT NULL").select("document_id", "parent_node_id", F.col("_up").alias("_at"), over.alias("_over"))
        if open_rows.isEmpty():
            break
    return leaves.drop("content").join(ended, ["document_id", "parent_node_id"], "left")


def one_each(resolved: DataFrame, page: str = "page_no") -> DataFrame:
    """One row for each question and target: the best leaf's rank and score, the last leaf's page."""
    by = ["query_id", "document_id", "target_id"]
    return resolved.groupBy(*by).agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score"), F.max_by(page, "rank").alias(page), F.count("*").alias("leaves"))


def passage_text(title: Column | str, heading: Column | str, content: Column | str, figure: Column | str | None = None) -> Column:
    """A passage as readers see it: its document's title, its section and figure, its text."""
    heading, figure = T.strip(heading), T.strip(figure) if figure is not None else F.lit("")
    prefix = F.concat_ws(" ", F.when(heading != "", F.concat(F.lit("[Section: "), heading, F.lit("]"))), F.when(figure != "", figure))
    body = F.when(prefix == "", T.col(content)).when(T.col(content) == "", prefix).otherwise(F.concat(prefix, F.lit("\n\n"), T.col(content)))
    return F.concat(F.lit("**"), F.coalesce(T.col(title), F.lit("Document sans titre")), F.lit("**\n"), body)


def context(passages: DataFrame, most: int = 3) -> DataFrame:
    """The numbered passages of a question (query_id, rank, title, passage, score) as one text, and how many they are."""
    rows = passages.where(F.col("rank") <= most)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.format_number(F.col("score"), 2), F.lit(") "), F.col("title"), F.lit("\n"), F.col("passage"), F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n---\n")
    return rows.groupBy("query_id").agg(F.concat(text, F.lit("\n\n("), F.count("*").cast("string"), F.lit(" passages.)")).alias("context"), F.count("*").alias("n_passages"))


def citation(content: Column | str, most: int = 200) -> Column:
    content = T.col(content)
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)


def rebuild(leaves: DataFrame) -> DataFrame:
    """Parents' texts from their leaves, in order: document_id, parent_node_id, content, n_leaves."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "node_id", "content")))
    return leaves.groupBy("document_id", "parent_node_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("content"), F.count("*").alias("n_leaves"))


def siblings(chunks: DataFrame, reach: int = 2, each: int = 260, most: int = 900) -> DataFrame:
    """For each chunk, excerpts of its neighbours in the document within reach, in order, until most characters are reached."""
    by = Window.partitionBy("document_id").orderBy("chunk_index").rangeBetween(-reach, reach)
    near = F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("content", 1, each).alias("part"))).over(by))
    rows = chunks.select("document_id", "chunk_index", F.filter(near, lambda x: x["chunk_index"] != F.col("chunk_index")).alias("near"))
    step = lambda acc, x: F.when(acc["n"] >= most, acc).otherwise(F.struct((acc["n"] + F.length(x["part"])).cast("int").alias("n"), F.concat(acc["text"], F.when(acc["n"] > 0, "\n").otherwise(""), x["part"]).alias("text")))
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))
    return rows.select("document_id", "chunk_index", F.aggregate("near", start, step)["text"].alias("context"))


def paired(leaves: DataFrame, images: DataFrame) -> DataFrame:
    """Picture leaves and images of a page, paired by their order; the surplus of either stays alone."""
    left = leaves.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "page_no").orderBy("chunk_index")))
    right = images.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "page_no").orderBy("top", "image_id")))
    return left.join(right, ["document_id", "page_no", "n"])
