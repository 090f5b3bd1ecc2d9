"""Registered queries over uploaded files and the stored index, beside their SQL. Files are made of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.operators import lexical
from quarry.plans.queries import _questions, _r, query
from quarry.session import shared_dir
from quarry.sources import files, views as V


def _name(folder: str, key: str, ending):
    return F.concat(F.lit(f"{folder}/"), F.col(key).cast("string"), ending).alias("name")


def made_files(s: SparkSession, d: str) -> DataFrame:
    """name, content: documents as text and Markdown, pages, JSON of events (every seventh one broken), customers of each nation
    as comma-separated values with quotes and line ends in cells, parts in a format that has no parser."""
    docs = V.table(s, d, "documents").select(_name("document", "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")), F.col("text").cast("binary").alias("content"))
    pages = V.table(s, d, "pages").select(_name("page", "page_id", F.lit(".html")), F.col("html").cast("binary").alias("content"))
    props = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    events = V.table(s, d, "events").select(_name("event", "event_id", F.lit(".json")), props.cast("binary").alias("content"))
    between = F.when(F.col("c_custkey") % 10 == 0, ",\n").otherwise(", ")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", between, F.lit('""'), "c_mktsegment", F.lit('"""'))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\r\n")
    nations = V.table(s, d, "customer").groupBy("c_nationkey").agg(lines.alias("lines"))
    nations = nations.select(_name("nation", "c_nationkey", F.lit(".csv")), F.concat(F.lit("key,label\r\n"), "lines", F.lit("\r\n")).cast("binary").alias("content"))
    parts = V.table(s, d, "part").select(_name("part", "p_partkey", F.lit(".docx")), F.col("p_name").cast("binary").alias("content"))
    return docs.unionByName(pages).unionByName(events).unionByName(nations).unionByName(parts)


_PARSED = """
    SELECT 'document/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'text/markdown' ELSE 'text/plain' END AS mime,
        CASE WHEN text IS NOT NULL THEN 'text' END AS parser, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content, CASE WHEN text IS NOT NULL THEN 1 END AS n_elements, NULL AS n_rows,
        CASE WHEN text IS NULL THEN 'no content' END AS error FROM documents
    UNION ALL SELECT 'page/' || page_id || '.html', 'text/html', 'sections', string_agg(CASE kind WHEN 'title' THEN '# ' WHEN 'list' THEN '- ' ELSE '' END || content, chr(10) || chr(10) ORDER BY pos), count(*), NULL, NULL FROM element GROUP BY page_id
    UNION ALL SELECT 'event/' || event_id || '.json', 'application/json', CASE WHEN event_id % 7 > 0 THEN 'json' END, CASE WHEN event_id % 7 > 0 THEN '{' || chr(10) || '  "k": ' || json_extract_string(props, '$.k') || chr(10) || '}' END,
        CASE WHEN event_id % 7 > 0 THEN 1 END, NULL, CASE WHEN event_id % 7 = 0 THEN 'invalid' END FROM events
    UNION ALL SELECT 'nation/' || c_nationkey || '.csv', 'text/csv', 'grid', '| key | label |' || chr(10) || '| --- | --- |' || chr(10)
        || string_agg('| ' || c_custkey || ' | ' || c_name || CASE WHEN c_custkey % 10 = 0 THEN ',' || chr(10) ELSE ', ' END || '"' || c_mktsegment || '" |' || chr(10), '' ORDER BY c_custkey), 1, count(*) + 1, NULL FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'part/' || p_partkey || '.docx', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', NULL, NULL, NULL, NULL, 'unsupported' FROM part"""


@query(f"SELECT * FROM ({_PARSED})")
def parsed_uploads(s, d):
    """Files of all kinds through the parsers."""
    rows = files.parse(made_files(s, d))
    return rows.select("name", "mime", "parser", F.col("parsed").alias("content"), F.size("elements").alias("n_elements"), F.get("elements", F.lit(0))["rows"].alias("n_rows"), "error").withColumn("n_elements", F.when(F.col("parser").isNotNull(), F.col("n_elements")))


@query("SELECT 'page/' || page_id || '.html' AS name, count(*) FILTER (kind = 'title') AS titles, count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'list') AS items FROM element GROUP BY page_id")
def elements_by_type(s, d):
    """How many elements of each type a page has."""
    pages = V.table(s, d, "pages").select(_name("page", "page_id", F.lit(".html")), F.col("html").cast("binary").alias("content"))
    count = lambda kind: F.size(files.elements_of("elements", kind)).cast("long")
    return files.parse(pages).select("name", count("title").alias("titles"), count("paragraph").alias("paragraphs"), count("list").alias("items"))


@query("""SELECT user_id, project_id, file_count, total_size, round(total_size / 1048576.0, 2) AS total_size_mb FROM
    (SELECT doc_id % 7 AS user_id, doc_id % 4 AS project_id, count(*) AS file_count, sum(strlen(coalesce(text, ''))) AS total_size FROM documents WHERE doc_id % 4 > 0 GROUP BY ALL
    UNION ALL SELECT doc_id % 7, NULL, count(*), sum(strlen(coalesce(text, ''))) FROM documents GROUP BY ALL)""")
def storage_stats(s, d):
    """Files and bytes of users and of their projects; a fourth of the files is in no project."""
    project = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("project_"), (F.col("doc_id") % 4).cast("string"), F.lit("/"))).otherwise("")
    path = F.concat(F.lit("store/user_"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), project, F.col("doc_id").cast("string"), F.lit(".txt"))
    return files.storage_stats(V.table(s, d, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("length")))


@query("SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ltop WHERE rank <= 15")
def lexical_stored(s, d):
    """Full text over an index that is written as a bucketed table first."""
    name = f"postings_{uuid.uuid4().hex}"
    stored = lexical.store(V.chunk(s, d), name, f"{shared_dir(s).rstrip('/')}/{name}")
    return lexical.top_k_stored(_questions(s, d), stored, 15).select("query_id", "chunk_id", _r("score"), F.col("rank").cast("long").alias("rank"))
