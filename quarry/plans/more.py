"""Further registered queries beside their SQL: sections, extraction, reranking, lifecycle, listings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quarry.functions import text as T
from quarry.operators import catalog, chunking, extraction, graph, rerank, structure, tables, vectors
from quarry.plans import oracle as O
from quarry.plans import queries as Q
from quarry.plans import retrieval
from quarry.plans.queries import query
from quarry.sources import views as V

_TYPES = "[" + ", ".join(f"'{t}'" for t in extraction.TYPES) + "]"


def _sections(s, d):
    return structure.sections(V.table(s, d, "pages"))


# elements and sections


@query("SELECT page_id, pos, kind, content FROM element")
def page_elements(s, d):
    return structure.elements(V.table(s, d, "pages"))


@query("SELECT page_id, section, heading, count(*) AS leaves, min(pos) AS first_pos, max(pos) AS last_pos, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content FROM headed GROUP BY page_id, section, heading")
def section_parents(s, d):
    return structure.section_parents(_sections(s, d))


@query("""SELECT page_id, page_id || ':' || section AS node_id, NULL AS parent_id, 0 AS level, false AS is_leaf, string_agg(content, chr(10) || chr(10) ORDER BY pos) AS content FROM headed GROUP BY page_id, section
    UNION ALL SELECT page_id, page_id || ':' || section || ':' || pos, page_id || ':' || section, 1, length(content) <= 200, CASE WHEN heading <> '__no_heading__' THEN heading || chr(10) ELSE '' END || 'p.' || page_id || chr(10) || chr(10) || content FROM headed
    UNION ALL SELECT page_id, node || ':' || i, node, 2, true, trim(substr(content, i * 180 + 1, 200)) FROM (SELECT page_id, page_id || ':' || section || ':' || pos AS node, content, unnest(range(0, CAST(ceil((length(content) - 200) / 180.0) AS BIGINT) + 1)) AS i FROM headed WHERE length(content) > 200)""")
def section_chunks(s, d):
    return structure.section_chunks(_sections(s, d), 200, 20)


@query("""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, part) - 1 AS chunk_index, kind, section, content FROM (SELECT page_id, pos, kind, section, part, trim(substr(content, part * 750 + 1, 750)) AS content FROM
    (SELECT *, unnest(range(0, CAST(ceil(length(content) / 750.0) AS BIGINT))) AS part FROM (SELECT *, last_value(CASE WHEN kind = 'title' THEN content END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM element))) WHERE content <> ''""")
def element_chunks(s, d):
    return structure.element_chunks(structure.elements(V.table(s, d, "pages")))


@query(f"""WITH RECURSIVE d AS (SELECT document_id, content AS t, length(content) AS n, CASE WHEN length(content) >= 200000 THEN 4096 ELSE 3072 END AS s0, CASE WHEN length(content) >= 200000 THEN 1536 ELSE 1024 END AS s1, CASE WHEN length(content) >= 200000 THEN 512 ELSE 384 END AS s2 FROM (SELECT doc_id AS document_id, text AS content FROM documents) WHERE length(content) > 0),
    w0 AS (SELECT *, i * s0 AS b, least((i + 1) * s0, n) AS e FROM (SELECT *, unnest(range(0, CAST(ceil(n / CAST(s0 AS DOUBLE)) AS BIGINT))) AS i FROM d)),
    w1 AS (SELECT * EXCLUDE (b, e, i, j), b AS p, b + j * s1 AS b, least(b + (j + 1) * s1, e) AS e FROM (SELECT *, unnest(range(0, CAST(ceil((e - b) / CAST(s1 AS DOUBLE)) AS BIGINT))) AS j FROM w0)),
    w2 AS (SELECT * EXCLUDE (b, e, j), b AS q, b + j * s2 AS b, least(b + (j + 1) * s2, e) AS e FROM (SELECT *, unnest(range(0, CAST(ceil((e - b) / CAST(s2 AS DOUBLE)) AS BIGINT))) AS j FROM w1))
    SELECT document_id, level, b AS start, e - b AS size, parent AS parent_start, level = 2 AS is_leaf, content FROM (SELECT document_id, level, b, e, parent, {O.strip("substr(t, CAST(b + 1 AS BIGINT), CAST(e - b AS BIGINT))")} AS content FROM
    (SELECT document_id, t, 0 AS level, b, e, NULL AS parent FROM w0 UNION ALL SELECT document_id, t, 1, b, e, p FROM w1 UNION ALL SELECT document_id, t, 2, b, e, q FROM w2)) WHERE content <> ''""")
def nested_windows(s, d):
    return structure.nested_windows(V.document(s, d))


@query(f"SELECT document_id, CASE WHEN coalesce({O.strip('content')}, '') = '' THEN title ELSE coalesce(title, '') || chr(10) || chr(10) || content END AS content FROM doc")
def note_text(s, d):
    return V.document(s, d).select("document_id", structure.full_text(F.col("title"), F.col("content")).alias("content"))


@query("SELECT folder_id, max(distance) AS level, folder_id NOT IN (SELECT parent_id FROM folder WHERE parent_id IS NOT NULL) AS is_leaf FROM up GROUP BY folder_id")
def tree_levels(s, d):
    return catalog.levels(Q._folders(s, d))


_H2, _ADAPTIVE = Q.SQL["h2_sections"], Q.SQL["adaptive_chunks"]


@query(f"SELECT document_id, chunk_index, content FROM ({_H2}) UNION ALL SELECT document_id, chunk_index, content FROM ({_ADAPTIVE}) WHERE document_id NOT IN (SELECT document_id FROM ({_H2}))")
def fallback_chunks(s, d):
    """By headings of the second level where a document has such sections, else by the class of its paragraphs."""
    lines = V.document(s, d).select("document_id", F.replace("content", F.lit("\n"), F.lit("\n## ")).alias("content"))
    first = chunking.h2_sections(lines).select("document_id", "chunk_index", "content")
    rest = Q._paragraphed(s, d).join(first.select("document_id").distinct(), "document_id", "left_anti")
    return first.union(chunking.adaptive(rest).select("document_id", "chunk_index", "content"))


@query("""SELECT chunk_id, CASE WHEN meta = '' THEN content ELSE '*[' || meta || ']*' || chr(10) || content END AS markdown FROM (SELECT chunk_id, content, concat_ws(', ', 'Page ' || (chunk_index + 1), CASE WHEN title <> '' THEN 'Section: ' || title END, CASE WHEN lang <> 'en' THEN 'Type: ' || lang END) AS meta FROM chunk JOIN doc USING (document_id))""".replace("SELECT chunk_id, content, concat_ws", "SELECT chunk_id, chunk.content AS content, concat_ws"))
def chunk_markdown(s, d):
    """Chunks with a line of what is known of them; the language stands for the kind of a chunk."""
    rows = V.chunk(s, d).join(V.document(s, d).select("document_id", "title", "lang"), "document_id")
    page, section = F.concat(F.lit("Page "), (F.col("chunk_index") + 1).cast("string")), F.when(F.col("title") != "", F.concat(F.lit("Section: "), "title"))
    meta = F.concat_ws(", ", page, section, F.when(F.col("lang") != "en", F.concat(F.lit("Type: "), "lang")))
    return rows.select("chunk_id", F.when(meta == "", F.col("content")).otherwise(F.concat(F.lit("*["), meta, F.lit("]*\n"), "content")).alias("markdown"))


# tables and files


@query("""SELECT p_partkey, '{"' || 'Clé":"' || p_name || '","Valeur":"' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END || '","Type":"' || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_type END || '"}' AS json FROM part""")
def table_json(s, d):
    """Each row of a table as an object of its headers."""
    rows = Q._table_rows(s, d).select("p_partkey", "headers", F.explode("lines").alias("line"))
    return rows.select("p_partkey", F.to_json(F.map_from_arrays("headers", "line")).alias("json"))


@query("""SELECT n_nationkey, 'Clients' || chr(10) || chr(10) || 'Client → Segment' || chr(10) || chr(10) || string_agg(c_name || ' → ' || c_mktsegment, chr(10) ORDER BY c_custkey) AS summary FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def table_summaries(s, d):
    """A table of two columns for each nation, of as many rows as it has customers, parsed and summarised."""
    rows = V.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(F.lit("| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |")).alias("line")))).alias("x"))
    text = F.concat(F.lit("| Client | Segment |\n|---|---|\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    return tables.parse(rows.select("n_nationkey", text.alias("content"))).select("n_nationkey", tables.summary(F.col("headers"), F.col("lines"), F.lit("Clients")).alias("summary"))


@query("""SELECT c_nationkey, '| name | segment |' || chr(10) || string_agg('| ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey) AS grid FROM customer GROUP BY c_nationkey""")
def csv_grid(s, d):
    """Comma-separated texts as grids."""
    rows = V.table(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", F.concat_ws(",", "c_name", "c_mktsegment").alias("line")))).alias("x"))
    csv = rows.select("c_nationkey", F.concat(F.lit("name,segment\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("csv"))
    line = lambda x: F.concat(F.lit("| "), F.array_join(F.split(x, ","), " | "), F.lit(" |"))
    return csv.select("c_nationkey", F.array_join(F.transform(F.filter(F.split("csv", r"\r?\n"), lambda x: x != ""), line), "\n").alias("grid"))


@query("""SELECT event_type, count(k) AS n, sum(k) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""")
def event_properties(s, d):
    """The JSON properties of events, parsed."""
    rows = V.table(s, d, "events").select("event_type", F.from_json("props", "k long").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query(f"""SELECT conv_id, string_agg('## Page ' || (turn + 1) || chr(10) || chr(10) || t, chr(10) || chr(10) ORDER BY turn, t) AS content FROM (SELECT conv_id, turn, {O.strip('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id""")
def page_texts(s, d):
    """Texts of pages (here: turns of conversations) under their numbers, blank ones left out."""
    rows = V.table(s, d, "conversations").select("conv_id", "turn", T.strip("text").alias("t")).where("t <> ''")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: F.concat(F.lit("## Page "), (x["turn"] + 1).cast("string"), F.lit("\n\n"), x["t"]))
    return rows.groupBy("conv_id").agg(F.array_join(pages, "\n\n").alias("content"))


_NAME = "regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '[/\\\\:*?\"<>|]', '_', 'g')"


@query(f"SELECT page_id, 'original_' || page_id || '_' || {_NAME} || '.html' AS stored_name, octet_length(encode(html)) AS size, 'text/html' AS mime FROM pages WHERE octet_length(encode(html)) <= 50 * 1024 * 1024")
def stored_uploads(s, d):
    """Pages as uploads of 50 MiB at most under safe names."""
    rows = V.table(s, d, "pages").where(F.octet_length("html") <= 50 * 1024 * 1024)
    name = F.concat(F.lit("original_"), F.col("page_id").cast("string"), F.lit("_"), T.safe_filename("url"), F.lit(".html"))
    return rows.select("page_id", name.alias("stored_name"), F.octet_length("html").cast("long").alias("size"), T.mime_type(name).alias("mime"))


# extraction

_KINDS = ["gamme_systeme", "profil_code", "norme_doc", "unknown", "Regle_Pose ", "performance_test"]
_WEIGHTS = ["-0.5", "0.25", "1.5", "0.75"]
_WORDS = "regexp_extract_all(lower(text), '[a-z]{1,12}')[1:16]"


@query(f"""SELECT document_id, i, name, type, CASE WHEN type IN ('garantie_duree', 'performance_test', 'norme_doc') THEN 1.0 ELSE greatest(0.0, least(1.0, importance)) END AS importance FROM
    (SELECT document_id, w AS name, trim(lower(({_KINDS})[(p - 1) % 6 + 1])) AS type, CAST(({_WEIGHTS})[(p - 1) % 4 + 1] AS DOUBLE) AS importance, row_number() OVER (PARTITION BY document_id ORDER BY p) - 1 AS i FROM
    (SELECT doc_id AS document_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS p FROM documents WHERE length({O.strip('text')}) >= 20)
    WHERE length(w) >= 2 AND ({_KINDS})[(p - 1) % 6 + 1] <> 'unknown') WHERE i < 10""")
def extracted_entities(s, d):
    """Fenced JSON as a model would return it, made of each document's first words, parsed and checked."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{1,12}"), F.lit(0)), 1, 16)
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i % len(values) + 1)
    items = F.transform(words, lambda w, i: F.concat(F.lit('{"name": "'), w, F.lit('", "type": "'), pick(_KINDS, i), F.lit('", "importance": '), pick(_WEIGHTS, i), F.lit("}")))
    response = F.concat(F.lit("```json\n["), F.array_join(items, ", "), F.lit("]\n```\nDone."))
    rows = V.table(s, d, "documents").where(extraction.asked("text", extraction.ENTITY_TEXT).isNotNull()).select(F.col("doc_id").alias("document_id"), F.posexplode(extraction.entities(response)).alias("i", "e"))
    return rows.select("document_id", "i", "e.name", "e.type", "e.importance")


@query(f"""SELECT document_id, coalesce(w[1], '') AS summary, list_filter(w[2:4], lambda x: true) AS q FROM (SELECT doc_id AS document_id, {_WORDS} AS w FROM documents WHERE length({O.strip('text')}) >= 30)""".replace("list_filter(w[2:4], lambda x: true) AS q", "array_to_string(w[2:4], '|') AS questions"))
def summary_questions(s, d):
    """A summary and at most three questions out of JSON with blank ones."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{1,12}"), F.lit(0)), 1, 16)
    quoted = F.transform(F.flatten(F.transform(F.slice(words, 2, 16), lambda w: F.array(w, F.lit("  ")))), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    response = F.concat(F.lit('Voici: {"summary": " '), F.coalesce(F.get(words, F.lit(0)), F.lit("")), F.lit(' ", "questions": ['), F.array_join(quoted, ", "), F.lit("]} fin"))
    rows = V.table(s, d, "documents").where(extraction.asked("text", extraction.SUMMARY_TEXT).isNotNull()).select(F.col("doc_id").alias("document_id"), extraction.summary_questions(response).alias("x"))
    return rows.select("document_id", "x.summary", F.array_join("x.questions", "|").alias("questions"))


@query(f"""SELECT query_id, string_agg(name, '|' ORDER BY p) AS pivots FROM (SELECT query_id, name, min(p) AS p, row_number() OVER (PARTITION BY query_id ORDER BY min(p)) AS r FROM
    (SELECT query_id, {O.normalized('w')} AS name, p FROM (SELECT query_id, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS p FROM question)) WHERE name <> '' GROUP BY query_id, name) WHERE r <= 12 GROUP BY query_id""")
def query_pivots(s, d):
    return Q._questions(s, d).select("query_id", F.array_join(extraction.pivots(F.split("content", " ")), "|").alias("pivots")).where("pivots <> ''")


@query("SELECT doc_id AS id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN length(text) END AS e0, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN length(text) - length(replace(text, 'e', '')) END AS e1 FROM documents")
def embedded_documents(s, d):
    """Vectors by an embedder that is given: here, the number of letters and of the letter e."""
    rows = V.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    out = extraction.embed(rows, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    return out.select("id", F.get("embedding", F.lit(0)).alias("e0"), F.get("embedding", F.lit(1)).alias("e1"))


# retrieval


def _share(query, content):
    """The share of a question's terms that a text holds as words."""
    terms = F.array_distinct(T.query_terms(query))
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, T.words(content))) / F.size(terms)).otherwise(0.05)


def _share_sql(content: str) -> str:
    return f"CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, {O.words(content)})) / len(terms) ELSE 0.05 END"


_CANDIDATES = f"SELECT v.query_id, v.rank, v.score, c.chunk_id, c.content, list_distinct({O.terms('q.content')}) AS terms FROM vtop v JOIN question q ON q.query_id = v.query_id JOIN chunk c ON c.chunk_id = v.row_id * 1000000"


def _candidates(s, d, k=45):
    """Chunks near to questions by their vectors; vectors stand for the first chunks of documents."""
    rows = Q._vectors(s, d)
    near = vectors.top_k(rows.where("id % 50 = 0"), rows, k).select("query_id", (F.col("row_id") * 1_000_000).alias("chunk_id"), "score", "rank")
    return near.join(V.chunk(s, d).select("chunk_id", "content"), "chunk_id").join(Q._questions(s, d).select("query_id", F.col("content").alias("query")), "query_id")


@query(f"""SELECT query_id, chunk_id, round(first_score, 6) AS first_score, round(rerank_score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, chunk_id) AS rank FROM
    (SELECT query_id, chunk_id, first_score, {_share_sql('content')} AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(first_score, 9) DESC, chunk_id) AS r FROM
    (SELECT *, {_share_sql('left(content, 800)')} AS first_score FROM ({_CANDIDATES}))) WHERE r <= 25)) WHERE rank <= 10""")
def rerank_two_stages(s, d):
    return rerank.two_stages(_candidates(s, d), 10, _share).select("query_id", "chunk_id", Q._r("first_score"), Q._r("rerank_score"), F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT query_id, document_id, block, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank, way FROM (WITH
    c AS (SELECT x.*, document_id, chunk_index, content, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, chunk_id) AS place FROM skept x JOIN chunk USING (chunk_id) QUALIFY place <= 45),
    st AS (SELECT query_id, avg(coalesce(vector_similarity, 0)) >= 0.85 AS stop FROM c WHERE place <= 5 GROUP BY query_id),
    a AS (SELECT query_id, chunk_id, c.content AS content, terms FROM c JOIN st USING (query_id) JOIN (SELECT query_id, list_distinct({O.terms('content')}) AS terms FROM question) USING (query_id) WHERE NOT stop),
    a1 AS (SELECT *, {_share_sql('left(content, 800)')} AS s1 FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s1, 9) DESC, chunk_id) <= 25),
    a2 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round({_share_sql('content')}, 9) DESC, chunk_id) AS rank, 'rerank' AS way FROM a1 QUALIFY rank <= 10),
    b AS (SELECT query_id, chunk_id, place AS rank, 'direct' AS way FROM c JOIN st USING (query_id) WHERE stop AND place <= 10),
    f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n / n_terms DESC, chunk_id DESC) AS rank, 'fallback' AS way FROM (SELECT query_id, chunk_id, n_terms, count(*) AS n FROM (SELECT DISTINCT chunk_id, term FROM posting) JOIN term USING (term)
        WHERE chunk_id // 1000000 % 5 = query_id % 5 AND query_id NOT IN (SELECT query_id FROM c) GROUP BY ALL) QUALIFY rank <= 10)
    SELECT query_id, document_id, chunk_index // 4 AS block, min(rank) AS best, min(way) AS way FROM (SELECT * FROM a2 UNION ALL SELECT * FROM b UNION ALL SELECT * FROM f) JOIN chunk USING (chunk_id) GROUP BY ALL)""")
def answer_passages(s, d):
    """The whole way from questions to passages, within the questions' spaces."""
    v, space = Q._vectors(s, d), F.col("document_id") % 5
    q = Q._questions(s, d).join(v.select(F.col("id").alias("query_id"), "embedding"), "query_id", "left").withColumn("space_id", F.col("query_id") % 5)
    chunks = V.chunk(s, d).select("chunk_id", "document_id", "chunk_index", "content", space.alias("space_id"))
    held = v.select((F.col("id") * 1_000_000).alias("id"), "embedding", (F.col("id") % 5).alias("space_id"))
    return retrieval.answer(q, chunks, held, V.space_mention(s, d), _share)


@query("""SELECT query_id, name, n, rank FROM (SELECT query_id, name, count(*) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(v.rank), name) AS rank FROM vtop v JOIN mention m ON m.chunk_id = v.row_id * 1000000 GROUP BY query_id, name) WHERE rank <= 5""")
def candidate_names(s, d):
    """The names that most of a question's candidates mention; of equals the one first seen."""
    rows = Q._vectors(s, d)
    near = vectors.top_k(rows.where("id % 50 = 0"), rows, 45).select("query_id", (F.col("row_id") * 1_000_000).alias("chunk_id"), F.col("rank").alias("seen"))
    found = near.join(V.mention(s, d), "chunk_id").groupBy("query_id", "name").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n"), "seen", "name")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").drop("seen")


@query(f"""SELECT * FROM (WITH q5 AS (SELECT query_id, unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5]) AS term FROM (SELECT query_id, list_filter(regexp_extract_all(strip_accents(lower(content)), '[a-z0-9]+'), lambda w: length(w) > 3 AND NOT list_contains({O._STOP}, w)) AS w FROM question)),
    ex AS (SELECT query_id, chunk_id, max(relevance) AS score FROM mention JOIN q5 ON name = term GROUP BY query_id, chunk_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(max(relevance), 9) DESC, chunk_id) <= 15),
    few AS (SELECT query_id, count(ex.chunk_id) AS n FROM (SELECT DISTINCT query_id FROM q5) LEFT JOIN ex USING (query_id) GROUP BY query_id),
    pn AS (SELECT DISTINCT query_id, name FROM (SELECT DISTINCT name FROM mention) JOIN q5 ON contains(name, term)),
    pt AS (SELECT query_id, m.chunk_id, max(relevance) AS score FROM mention m JOIN pn USING (name) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = pn.query_id AND ex.chunk_id = m.chunk_id) GROUP BY ALL)
    SELECT query_id, chunk_id, round(score, 6) AS score, false AS partial FROM ex UNION ALL
    SELECT query_id, chunk_id, round(score, 6), true FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS r FROM pt JOIN few USING (query_id) WHERE n < 7) WHERE r <= 15 - n)""")
def partial_names(s, d):
    terms = Q._questions(s, d).select("query_id", F.explode(F.slice(T.meaningful_words("content"), 1, 5)).alias("term"))
    return graph.with_partial_names(terms, V.mention(s, d), 15).select("query_id", "chunk_id", Q._r("score"), "partial")


_HOP = """n{h} AS (SELECT query_id, name FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank), name) AS r FROM h{p} JOIN mention USING (chunk_id) GROUP BY query_id, name) WHERE r <= 6),
    h{h} AS (SELECT query_id, chunk_id, {h} AS hop, score, rank FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
    (SELECT query_id, chunk_id, max(relevance) AS score FROM mention JOIN n{h} USING (name) WHERE {seen} GROUP BY ALL)) WHERE rank <= 20)"""
_SEEN = "NOT EXISTS (SELECT 1 FROM h{i} z WHERE z.query_id = n{h}.query_id AND z.chunk_id = mention.chunk_id)"


@query(f"""SELECT query_id, chunk_id, hop, round(score, 6) AS score FROM (WITH h0 AS (SELECT query_id, chunk_id, 0 AS hop, score, rank FROM gtop WHERE rank <= 15),
    {", ".join(_HOP.format(h=h, p=h - 1, seen=" AND ".join(_SEEN.format(i=i, h=h) for i in range(h))) for h in (1, 2, 3))}
    SELECT * FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, rank, chunk_id) <= 80)""")
def multi_hop(s, d):
    """Candidates of the graph, and what three hops over their most frequent names add."""
    held = V.mention(s, d).withColumn("space_id", F.lit(0))
    names = Q._questions(s, d).select("query_id", F.lit(0).alias("space_id"), F.explode(T.meaningful_words("content")).alias("name"))
    return graph.hops(graph.retrieve(names, held, 15), held).select("query_id", "chunk_id", "hop", Q._r("score"))


@query("""SELECT space_id, alias, min(name) AS name FROM (SELECT DISTINCT space_id, name, left(name, 6) AS alias FROM sm) WHERE length(alias) >= 2 AND alias <> name GROUP BY space_id, alias""")
def alias_registration(s, d):
    """The first six letters of names as aliases; the first name in order keeps one that several have."""
    rows = V.space_mention(s, d).select("space_id", "name", F.substring("name", 1, 6).alias("alias"))
    return graph.register_aliases(rows, None)


@query("""SELECT query_id, row_id, round(score, 6) AS score, rank FROM (SELECT q.id AS query_id, r.id AS row_id, list_cosine_similarity(q.e, r.e) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, r.e), 9) DESC, r.id) AS rank FROM vec q JOIN vec r ON q.id % 5 = r.id % 5 WHERE q.id % 50 = 0) WHERE rank <= 15""")
def scoped_topk(s, d):
    """The nearest vectors of a question's own space; each space is searched by itself."""
    rows = Q._vectors(s, d).withColumn("space_id", F.col("id") % 5)
    return vectors.top_k_within(rows.where("id % 50 = 0"), rows, 15, "space_id").select("query_id", "row_id", Q._r("score"), "rank")


@query(f"""SELECT query_id, chunk_id, round({_share_sql('content')}, 6) AS score, left(content, 12000) AS content, round(top, 6) AS top FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM ({_CANDIDATES})) WHERE rank <= 80""")
def trace_rows(s, d):
    """What is kept of candidates for a trace: 80 at most, their first 12,000 letters, the top score."""
    rows = _candidates(s, d).where("rank <= 80").withColumn("top", F.max("score").over(Window.partitionBy("query_id")))
    return rows.select("query_id", "chunk_id", F.round(_share("query", "content"), 6).alias("score"), F.substring("content", 1, 12_000).alias("content"), Q._r("top"))


@query(f"""SELECT query_id, content <> '' AND (regexp_matches(lower(content), '(^|[^\\pL\\pN_])(et|comparaison|impact|cause|depend|dépend|influence|relation|lien|si|alors|pourquoi|comment|implique|nécessite|necessite|versus|vs|différence|difference|avantage|inconvénient|inconvenient)($|[^\\pL\\pN_])') OR n >= 2) AS several FROM
    (SELECT query_id, {O.strip('content')} AS content, len(list_distinct(list_filter(list_transform(string_split(content, ' '), lambda w: {O.normalized('w')}), lambda w: length(w) >= 12))) AS n FROM question)""")
def multi_step_trigger(s, d):
    """Whether a question needs several steps, by its words or by two pivots (here: long words)."""
    rows = Q._questions(s, d)
    n = F.size(F.array_distinct(F.filter(F.transform(F.split("content", " "), T.normalize_name), lambda w: F.length(w) >= 12)))
    return rows.select("query_id", T.needs_several_steps("content", n).alias("several"))


# lifecycle


@query("SELECT doc_id, vec_id IS NOT NULL AS updated, CASE WHEN vec_id IS NULL THEN 0 ELSE len(embedding) END AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vector_sink(s, d):
    """Rows with their vectors set from a batch; those that it lacks keep theirs (here: none)."""
    new = V.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = V.table(s, d, "documents").select("doc_id").join(new, "doc_id", "left")
    return rows.select("doc_id", F.col("embedding").isNotNull().alias("updated"), F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"))


@query("SELECT conv_id, turn, role FROM (SELECT CASE WHEN role = 'system' THEN NULL ELSE conv_id END AS conv_id, turn, role FROM conversations) c WHERE conv_id IS NULL OR conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphan_messages(s, d):
    """Messages that are to be deleted: without a conversation, or of one that isn't held (here: held ones are of good documents)."""
    rows = V.table(s, d, "conversations").select(F.when(F.col("role") != "system", F.col("conv_id")).alias("conv_id"), "turn", "role")
    return catalog.orphans(rows, "conv_id", V.table(s, d, "labels").where("quality = 1").select("doc_id"))


_SMALL = f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS chunk_index, content FROM (SELECT document_id, s, {O.strip("substr(t, s + 1, 600)")} AS content FROM ({O.windows("SELECT document_id, content AS t FROM doc WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 0)", "600", "540")})) WHERE content <> ''"""


@query(f"SELECT document_id, chunk_index, content FROM chunk WHERE document_id NOT IN (SELECT document_id FROM ({_SMALL})) UNION ALL {_SMALL}")
def recreated_chunks(s, d):
    """Chunks of documents of low quality made anew in smaller windows; all others stay."""
    low = V.table(s, d, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"))
    columns = ["document_id", "chunk_index", "content"]
    new = chunking.fixed_windows(V.document(s, d).select("document_id", "content").join(low, "document_id", "left_semi"), 600, 60).select(columns)
    return catalog.replaced(V.chunk(s, d).select(columns), new, "document_id")


@query("""SELECT folder_id, n FROM (SELECT folder_id FROM folder WHERE folder_id NOT IN (SELECT folder_id FROM up WHERE ancestor_id IN (3, 17))) LEFT JOIN (SELECT user_id AS folder_id, count(*) AS n FROM events GROUP BY ALL) USING (folder_id)""")
def folder_delete(s, d):
    """Two folders go with all below them and the documents in these (here: events)."""
    gone = s.createDataFrame([(3,), (17,)], "folder_id long")
    folders, documents = catalog.after_delete(Q._folders(s, d), V.table(s, d, "events").select(F.col("user_id").alias("folder_id")), gone)
    return folders.select("folder_id").join(documents.groupBy("folder_id").agg(F.count("*").alias("n")), "folder_id", "left")


@query("""SELECT document_id, space_id FROM (SELECT document_id, space_id FROM ds UNION SELECT doc_id, 7 FROM labels WHERE quality = 1) x WHERE NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND doc_id = x.document_id AND x.space_id < 5)""")
def space_links(s, d):
    """Good documents are linked to a space, toxic ones are unlinked from five."""
    held, labels = V.document_space(s, d), V.table(s, d, "labels")
    link = labels.where("quality = 1").select(F.col("doc_id").alias("document_id"), F.lit(7).cast("long").alias("space_id"))
    unlink = held.join(labels.where("toxic = 1").select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").where("space_id < 5")
    return catalog.linked(held, link, unlink)


@query("SELECT space_id, count(DISTINCT document_id) AS documents, count(*) AS mentions, count(DISTINCT name) AS names FROM sm WHERE space_id <> 3 GROUP BY space_id")
def space_cascade(s, d):
    """What is left of spaces when one is deleted with its links, mentions and names."""
    rows = V.space_mention(s, d).where("space_id <> 3")
    return rows.groupBy("space_id").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("mentions"), F.count_distinct("name").alias("names"))


@query("SELECT source, count(*) AS total, count(*) FILTER (ok) AS queued, count(*) FILTER (NOT ok) AS skipped FROM (SELECT source, coalesce(text, '') <> '' AND lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels) AS ok FROM documents) GROUP BY source")
def reindex_eligible(s, d):
    """Documents that may be indexed anew: with text and language, and known (here: labelled)."""
    labels = V.table(s, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = V.table(s, d, "documents").join(labels, "doc_id", "left")
    ok = (F.coalesce("text", F.lit("")) != "") & F.col("lang").isNotNull() & F.col("known").isNotNull()
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if(ok).alias("queued"), F.count_if(~ok).alias("skipped"))


@query("SELECT user_id % 10 AS run, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type IN ('signup', 'view')) AS skipped, coalesce(string_agg(CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id), '') AS failed FROM events GROUP BY run")
def run_summaries(s, d):
    """Of each run: successes, what was skipped, and the list of failures (here: events stand for documents of runs)."""
    rows = V.table(s, d, "events").withColumn("run", F.col("user_id") % 10)
    failed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id")))), ",")
    return rows.groupBy("run").agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type").isin("signup", "view")).alias("skipped"), failed.alias("failed"))


@query("SELECT document_id, title, folder, lang, row_number() OVER (PARTITION BY folder ORDER BY title, document_id DESC) AS position FROM doc")
def document_list(s, d):
    """Documents of folders by title, the newer first among equals; without the heavy content."""
    order = Window.partitionBy("folder").orderBy("title", F.desc("document_id"))
    return V.document(s, d).select("document_id", "title", "folder", "lang").withColumn("position", F.row_number().over(order).cast("long"))


@query("""SELECT p_brand, array_to_string(list_sort(list_distinct(list_concat(list(t) FILTER (t LIKE 'S%' AND t NOT LIKE '%PLATED%'), ['STANDARD DEFAULT']))), '|') AS models FROM (SELECT p_brand, p_type AS t FROM part) GROUP BY p_brand""".replace("list(t) FILTER (t LIKE 'S%' AND t NOT LIKE '%PLATED%')", "coalesce(list(t) FILTER (t LIKE 'S%' AND t NOT LIKE '%PLATED%'), [])"))
def model_list(s, d):
    """Of each provider (here: brand) the models with a prefix and without a substring, and the configured one, sorted."""
    rows = V.table(s, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"))
    kept = F.filter("t", lambda x: x.startswith("S") & ~x.contains("PLATED"))
    return rows.select("p_brand", F.array_join(F.array_sort(F.array_union(kept, F.array(F.lit("STANDARD DEFAULT")))), "|").alias("models"))


@query(f"""SELECT s.space_id, t.type, coalesce(n, 0) AS n FROM (SELECT DISTINCT space_id FROM ds) s, (SELECT unnest({_TYPES}) AS type) t LEFT JOIN
    (SELECT space_id, ({_TYPES})[length(name) % 8 + 1] AS type, count(DISTINCT name) AS n FROM sm GROUP BY ALL) c ON c.space_id = s.space_id AND c.type = t.type""")
def taxonomy_counts(s, d):
    """Names of each space by all ten classes, those without names too (here: classes by a name's length)."""
    kinds = F.array(*map(F.lit, extraction.TYPES))
    held = V.space_mention(s, d).select("space_id", F.element_at(kinds, F.length("name") % 8 + 1).alias("type"), "name").groupBy("space_id", "type").agg(F.count_distinct("name").alias("n"))
    all_ = V.document_space(s, d).select("space_id").distinct().select("space_id", F.explode(kinds).alias("type"))
    return all_.join(held, ["space_id", "type"], "left").select("space_id", "type", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT document_id, count(*) AS waiting, min(chunk_index) AS first FROM chunk WHERE NOT (chunk_index = 0 AND document_id IN (SELECT vec_id FROM embeddings)) AND document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id""")
def embedding_backlog(s, d):
    """Leaves that wait for a vector, of documents that haven't failed (here: that aren't toxic)."""
    done = V.table(s, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).cast("long").alias("chunk_index"))
    failed = V.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    rows = V.chunk(s, d).select("document_id", "chunk_index").join(done, ["document_id", "chunk_index"], "left_anti").join(failed, "document_id", "left_anti")
    return rows.groupBy("document_id").agg(F.count("*").alias("waiting"), F.min("chunk_index").alias("first"))
