"""SQL of the data model's views, from which the queries' SQL is put together."""

from __future__ import annotations

from quarry.functions.text import STOPWORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-zÀ-ÿ0-9]+'), lambda w: lower(w))"


def terms(x: str) -> str:
    return f"list_filter({words(x)}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))[1:8]"


def meaningful(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(strip_accents(lower({x})), '[a-z0-9]+'), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w)))"


def normalized(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({strip(x)})), '[-_]', ' ', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')")


def windows(rows: str, size: str, step: str) -> str:
    """Starts of windows of rows that have a text t."""
    return f"SELECT *, unnest(range(0, CASE WHEN length(t) <= {size} THEN 1 ELSE CAST(ceil((length(t) - {size}) / CAST({step} AS DOUBLE)) AS BIGINT) + 1 END)) * {step} AS s FROM ({rows}) WHERE length(t) > 0"


VIEWS = {
    "doc": "SELECT doc_id AS document_id, left(split_part(text, chr(10), 1), 200) AS title, text AS content, source AS folder, lang FROM documents",
    "ds": "SELECT doc_id AS document_id, unnest([doc_id % 5, 5 + doc_id % 3]) AS space_id FROM documents",
    "chunk": f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS chunk_index, content, s AS start_char, least(s + 1200, n) AS end_char,
        document_id * 1000000 + row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS chunk_id
        FROM (SELECT document_id, s, length(t) AS n, {strip("substr(t, s + 1, 1200)")} AS content FROM ({windows("SELECT document_id, content AS t FROM doc", "1200", "1050")})) WHERE content <> ''""",
    "posting": f"SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT chunk_id, {words('content')} AS w FROM chunk)",
    "found": "SELECT document_id, chunk_id, name, count(*) AS n FROM (SELECT document_id, chunk_id, unnest(regexp_extract_all(strip_accents(lower(content)), '[a-z0-9]{8,}')) AS name FROM chunk) GROUP BY ALL",
    "mention": """SELECT *, n / max(n) OVER (PARTITION BY chunk_id) AS relevance FROM (SELECT * FROM found WHERE name IN (SELECT name FROM found GROUP BY name HAVING count(DISTINCT document_id) >= 2)
        QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, name) <= 10)""",
    "sm": "SELECT m.*, space_id FROM mention m JOIN ds USING (document_id)",
    "edge": "SELECT x.space_id, x.name AS a, y.name AS b, count(*) AS weight FROM sm x JOIN sm y ON x.space_id = y.space_id AND x.chunk_id = y.chunk_id AND x.name < y.name GROUP BY ALL",
    "links": "SELECT space_id, a AS name, b AS neighbour, weight FROM edge UNION ALL SELECT space_id, b, a, weight FROM edge",
    "question": "SELECT document_id AS query_id, title AS content FROM doc WHERE document_id % 50 = 0",
    "vec": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings",
    "near": """SELECT q.id AS query_id, r.id AS row_id, list_cosine_similarity(q.e, r.e) AS score FROM vec q, vec r WHERE q.id % 50 = 0""",
    "vtop": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_id) AS rank FROM near QUALIFY rank <= 45",
    "term": f"SELECT query_id, len(w) AS n_terms, unnest(w) AS term FROM (SELECT query_id, list_distinct({terms('content')}) AS w FROM question)",
    "hit": "SELECT query_id, chunk_id, n_terms, term, pos FROM posting JOIN term USING (term) QUALIFY count(DISTINCT term) OVER (PARTITION BY query_id, chunk_id) = n_terms",
    "cover": """SELECT query_id, chunk_id, start, min(last) AS last FROM (SELECT query_id, chunk_id, last, min(pos) AS start FROM
        (SELECT a.query_id, a.chunk_id, a.pos AS last, b.n_terms, b.term, max(b.pos) AS pos FROM hit a JOIN hit b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL)
        GROUP BY query_id, chunk_id, last, n_terms HAVING count(*) = n_terms) GROUP BY ALL""",
    "ltop": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM
        (SELECT query_id, chunk_id, sum(1.0 / (last - start + 1)) AS score FROM cover GROUP BY ALL) QUALIFY rank <= 45""",
    "qname": f"SELECT query_id, unnest({meaningful('content')}) AS name FROM question",
    "gm": "SELECT 0 AS space_id, chunk_id, name, relevance FROM mention",
    "gedge": "SELECT x.name AS a, y.name AS b, count(*) AS weight FROM gm x JOIN gm y ON x.chunk_id = y.chunk_id AND x.name < y.name GROUP BY ALL",
    "gnear": """SELECT DISTINCT query_id, neighbour AS name FROM qname JOIN (SELECT a AS name, b AS neighbour FROM gedge UNION ALL SELECT b, a FROM gedge) USING (name)
        WHERE NOT EXISTS (SELECT 1 FROM qname x WHERE x.query_id = qname.query_id AND x.name = neighbour)""",
    "gtop": """SELECT query_id, chunk_id, score, stage, row_number() OVER (PARTITION BY query_id ORDER BY stage, round(score, 9) DESC, chunk_id) AS rank FROM
        (SELECT query_id, chunk_id, min(stage) AS stage, arg_min(r, stage) AS score FROM (SELECT query_id, chunk_id, stage, max(r) AS r FROM
        (SELECT query_id, chunk_id, relevance AS r, 0 AS stage FROM gm JOIN qname USING (name) UNION ALL SELECT query_id, chunk_id, relevance * 0.88, 1 FROM gm JOIN gnear USING (name)) GROUP BY ALL) GROUP BY query_id, chunk_id) QUALIFY rank <= 45""",
    "signals": """SELECT query_id, chunk_id, max(v) AS v, max(l) AS l, max(k) AS k FROM (SELECT query_id, row_id * 1000000 AS chunk_id, score AS v, NULL AS l, NULL AS k FROM vtop WHERE query_id IN (SELECT query_id FROM question)
        UNION ALL SELECT query_id, chunk_id, NULL, score, NULL FROM ltop UNION ALL SELECT query_id, chunk_id, NULL, NULL, score FROM gtop) GROUP BY ALL""",
    "scaled": "SELECT query_id, chunk_id, v AS vector_similarity, " + ", ".join(f"CASE WHEN {s} IS NULL THEN 0 WHEN max({s}) OVER w - min({s}) OVER w < 1e-9 THEN 1 ELSE ({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w) END AS {n}" for s, n in (("v", "vn"), ("l", "lexical_norm"), ("k", "kag_norm"))) + " FROM signals WINDOW w AS (PARTITION BY query_id)",
    "fused": "SELECT query_id, chunk_id, vector_similarity, lexical_norm, kag_norm, 0.60 * vn + 0.25 * lexical_norm + 0.15 * kag_norm AS hybrid_score FROM scaled",
    "strong": "SELECT *, coalesce(vector_similarity, -1) >= 0.25 OR hybrid_score >= 0.06 OR lexical_norm >= 0.12 OR kag_norm >= 0.12 AS s FROM fused",
    "kept": "SELECT * EXCLUDE (s) FROM strong QUALIFY s OR NOT bool_or(s) OVER (PARTITION BY query_id)",
    "page": r"SELECT page_id, regexp_replace(" + "regexp_replace(" * 10 + r"html, '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '&quot;?', '" + '"' + r"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&nbsp;?', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#39;?', '''', 'g'), '&amp;?', '&', 'g') AS t FROM pages",
    "element": f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, kind, content FROM (SELECT page_id, i, CASE lower(split_part(part, chr(2), 1)) WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' ELSE 'title' END AS kind,
        {strip("regexp_replace(regexp_replace(split_part(split_part(split_part(part, chr(2), 2), '</ul>', 1), '</article>', 1), '<[^>]*>', ' ', 'g'), '[[:space:]]+', ' ', 'g')")} AS content
        FROM (SELECT page_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '<(h[1-6]|p|li)([[:space:]][^>]*)?>', chr(1) || '\\1' || chr(2), 'gi'), chr(1))[2:] AS x FROM pages))) WHERE content <> ''""",
    "headed": """SELECT page_id, pos, kind, content, heading, dense_rank() OVER (PARTITION BY page_id ORDER BY first) - 1 AS section FROM (SELECT *, min(pos) OVER (PARTITION BY page_id, heading) AS first FROM
        (SELECT *, coalesce(last_value(CASE WHEN kind = 'title' THEN content END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '__no_heading__') AS heading FROM element) WHERE kind <> 'title')""",
    "folder": "SELECT user_id AS folder_id, CASE WHEN user_id > 0 THEN user_id // 4 END AS parent_id, 'f' || user_id AS name FROM (SELECT DISTINCT user_id FROM events UNION SELECT 0)",
    "up": "SELECT f.folder_id, f.folder_id AS ancestor_id, 0 AS distance FROM folder f UNION ALL SELECT u.folder_id, f.parent_id, u.distance + 1 FROM up u JOIN folder f ON f.folder_id = u.ancestor_id WHERE f.parent_id IS NOT NULL AND f.parent_id IN (SELECT folder_id FROM folder)",
}

#: The same within the question's space, one of a document's two.
VIEWS |= {
    "sv": "SELECT q.id AS query_id, r.id * 1000000 AS chunk_id, list_cosine_similarity(q.e, r.e) AS score FROM vec q JOIN vec r ON q.id % 5 = r.id % 5 JOIN question ON query_id = q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.e, r.e), 9) DESC, r.id) <= 45",
    "sl": """SELECT * FROM (SELECT query_id, chunk_id, sum(1.0 / (last - start + 1)) AS score FROM cover WHERE chunk_id // 1000000 % 5 = query_id % 5 GROUP BY query_id, chunk_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= 45""",
    "sseed": "SELECT DISTINCT query_id, query_id % 5 AS space_id, name FROM qname",
    "snear": """SELECT DISTINCT z.query_id, z.space_id, y.name FROM sseed z JOIN sm x ON x.name = z.name AND x.space_id = z.space_id JOIN sm y ON y.space_id = x.space_id AND y.chunk_id = x.chunk_id
        WHERE NOT EXISTS (SELECT 1 FROM sseed o WHERE o.query_id = z.query_id AND o.name = y.name)""",
    "sg": """SELECT * FROM (SELECT query_id, chunk_id, min(stage) AS stage, arg_min(r, stage) AS score FROM (SELECT query_id, chunk_id, stage, max(r) AS r FROM
        (SELECT query_id, chunk_id, relevance AS r, 0 AS stage FROM sm JOIN sseed USING (space_id, name) UNION ALL SELECT query_id, chunk_id, relevance * 0.88, 1 FROM sm JOIN snear USING (space_id, name)) GROUP BY ALL) GROUP BY query_id, chunk_id)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stage, round(score, 9) DESC, chunk_id) <= 45""",
    "ssignals": """SELECT query_id, chunk_id, max(v) AS v, max(l) AS l, max(k) AS k FROM (SELECT query_id, chunk_id, score AS v, NULL AS l, NULL AS k FROM sv
        UNION ALL SELECT query_id, chunk_id, NULL, score, NULL FROM sl UNION ALL SELECT query_id, chunk_id, NULL, NULL, score FROM sg) GROUP BY ALL""",
    "sscaled": VIEWS["scaled"].replace("FROM signals", "FROM ssignals"),
    "sfused": VIEWS["fused"].replace("FROM scaled", "FROM sscaled"),
    "sstrong": VIEWS["strong"].replace("FROM fused", "FROM sfused"),
    "skept": VIEWS["kept"].replace("FROM strong", "FROM sstrong"),
}


def sql(body: str) -> str:
    """body after the views that it names, directly or not."""
    import re

    used: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                used.append(name)
                visit(VIEWS[name])

    visit(body)
    order = [v for v in VIEWS if v in used]
    return (("WITH RECURSIVE " if "up" in order else "WITH ") + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " if order else "") + body
