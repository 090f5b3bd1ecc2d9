"""Registered searches over several stages and hops, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions import text as T
from quarry.operators import fusion, graph, lexical, multihop, vectors
from quarry.plans import oracle as O
from quarry.plans import queries as Q
from quarry.plans.queries import query
from quarry.session import cut
from quarry.sources import views as V

_K = 15


def _closure(terms: str, most: int) -> str:
    return f"""SELECT * FROM (SELECT query_id, space_id, name, row_number() OVER (PARTITION BY query_id ORDER BY min(pos) NULLS LAST, name) AS pos FROM (SELECT query_id, space_id, name, pos FROM {terms}
        UNION ALL SELECT t.query_id, t.space_id, b.term, NULL FROM {terms} t JOIN known a ON a.space_id = t.space_id AND a.term = t.name JOIN known b ON b.space_id = a.space_id AND b.entity = a.entity) GROUP BY query_id, space_id, name) WHERE pos <= {most}"""


def _first(names: str, most: str, count: str = "") -> str:
    """The first rows of chunks that mention names."""
    return f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 9) DESC, chunk_id, name) AS place FROM (SELECT t.query_id, t.space_id, m.chunk_id, m.name, m.relevance FROM (SELECT DISTINCT query_id, space_id, name FROM {names}) t
        JOIN sm m ON m.space_id = t.space_id AND m.name = t.name) {count} QUALIFY place <= {most}"""


def _other(rows: str, found: str) -> str:
    return f"SELECT query_id, space_id, chunk_id, name, relevance, place FROM {rows} r WHERE NOT EXISTS (SELECT 1 FROM {found} f WHERE f.query_id = r.query_id AND f.chunk_id = r.chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place) = 1"


def _beside(found: str) -> str:
    return f"""SELECT query_id, space_id, name FROM (SELECT query_id, space_id, name, max(w) AS w FROM (SELECT s.query_id, s.space_id, s.name AS seed, y.name, count(*) AS w FROM (SELECT DISTINCT query_id, space_id, name FROM {found}) s JOIN sm x ON x.space_id = s.space_id AND x.name = s.name
        JOIN sm y ON y.space_id = x.space_id AND y.chunk_id = x.chunk_id AND y.name <> s.name GROUP BY ALL) z WHERE NOT EXISTS (SELECT 1 FROM {found} f WHERE f.query_id = z.query_id AND f.name = z.name) GROUP BY query_id, space_id, name)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY w DESC, name) <= 40"""


O.VIEWS |= {
    "known": "SELECT DISTINCT space_id, name AS entity, name AS term FROM sm UNION SELECT space_id, min(name), alias FROM (SELECT DISTINCT space_id, name, left(name, 6) AS alias FROM sm) WHERE alias <> name GROUP BY space_id, alias",
    "qterm": f"SELECT query_id, query_id % 5 AS space_id, name, min(pos) AS pos FROM (SELECT query_id, unnest(w) AS name, generate_subscripts(w, 1) AS pos FROM (SELECT query_id, list_filter({O.words('content')}, lambda w: length(w) >= 3 AND NOT list_contains({O._STOP}, w)) AS w FROM question)) GROUP BY ALL",
    "gx": _closure("qterm", 120),
    "gexact": _first("gx", str(_K)),
    "gcount": "SELECT x.query_id, x.space_id, count(chunk_id) AS n FROM (SELECT DISTINCT query_id, space_id FROM gx) x LEFT JOIN gexact e ON e.query_id = x.query_id GROUP BY ALL",
    "gholding": f"SELECT DISTINCT g.query_id, g.space_id, m.name FROM gx g JOIN gcount c ON c.query_id = g.query_id AND c.n < {_K // 2} JOIN (SELECT DISTINCT space_id, name FROM sm) m ON m.space_id = g.space_id AND contains(m.name, g.name) WHERE g.pos <= 5 AND length(g.name) >= 3",
    "gpartial": _first("gholding", f"{_K} - n", "JOIN gcount USING (query_id, space_id)"),
    "gfound": f"SELECT query_id, space_id, chunk_id, name, relevance, 0 AS stage, place FROM gexact UNION ALL SELECT query_id, space_id, chunk_id, name, relevance, 1, place FROM ({_other('gpartial', 'gexact')})",
    "gleft": f"SELECT query_id, space_id, count(*) AS n FROM gfound GROUP BY ALL HAVING count(*) < {_K}",
    "gseed": "SELECT f.* FROM gfound f JOIN gleft USING (query_id)",
    "gbeside": _beside("gseed"),
    "glast": _first("gbeside", f"{_K} - n", "JOIN gleft USING (query_id, space_id)"),
    "gsearch": f"""SELECT query_id, space_id, chunk_id, arg_min(name, [stage, place]) AS name, max(relevance * CASE WHEN stage = 2 THEN 0.88 ELSE 1 END) AS score, min(stage) AS stage FROM
        (SELECT * FROM gfound UNION ALL SELECT query_id, space_id, chunk_id, name, relevance, 2, place FROM ({_other('glast', 'gfound')})) GROUP BY query_id, space_id, chunk_id""",
}


def _known(held: DataFrame) -> DataFrame:
    """Names, and the first six letters of each as an alias of the first name in order that has them."""
    names = held.select("space_id", F.col("name").alias("entity"), F.col("name").alias("term")).distinct()
    aliases = graph.register_aliases(held.select("space_id", "name", F.substring("name", 1, 6).alias("alias")), None)
    return cut(names.union(aliases.select("space_id", F.col("name").alias("entity"), F.col("alias").alias("term"))).distinct())


def _asked(s: SparkSession, d: str) -> DataFrame:
    return Q._questions(s, d).withColumn("space_id", F.col("query_id") % 5)


def _terms(questions: DataFrame) -> DataFrame:
    found = questions.select("query_id", "space_id", F.posexplode(T.query_terms("content", 1_000_000)).alias("pos", "name"))
    return found.groupBy("query_id", "space_id", "name").agg(F.min("pos").alias("pos"))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return cut(V.space_mention(s, d).select("space_id", "chunk_id", "name", "relevance"))


@query("SELECT query_id, chunk_id, name, round(score, 6) AS score, stage FROM gsearch")
def graph_search(s, d):
    """Names of questions in their spaces: closure over aliases, exact names, parts of names, names beside."""
    held = _mentions(s, d)
    return multihop.search(_terms(_asked(s, d)), held, _known(held), _K).select("query_id", "chunk_id", "name", Q._r("score"), "stage")


_PIVOTS = f"list_distinct(list_filter(list_transform(string_split(content, ' '), lambda w: {O.normalized('w')}), lambda w: length(w) >= 8))"
_HOP = {
    "open{h}{v}": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM rows{p}{v} WHERE query_id IN (SELECT query_id FROM new{p}{v})) WHERE n < 80",
    "top{h}{v}": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM open{h}{v} QUALIFY place <= 20",
    "seed{h}{v}": "SELECT query_id, space_id, name, pos FROM (SELECT query_id, space_id, name, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(place)) AS pos FROM top{h}{v} WHERE name IS NOT NULL GROUP BY query_id, space_id, name QUALIFY pos <= 12) z WHERE NOT EXISTS (SELECT 1 FROM names{p}{v} o WHERE o.query_id = z.query_id AND o.name = z.name)",
    "names{h}{v}": "SELECT * FROM names{p}{v} UNION SELECT query_id, name FROM seed{h}{v}",
    "closed{h}{v}": _closure("seed{h}{v}", 80),
    "exact{h}{v}": _first("closed{h}{v}", "40"),
    "near{h}{v}": _beside("exact{h}{v}"),
    "nrow{h}{v}": _first("near{h}{v}", "20"),
    "all{h}{v}": f"SELECT query_id, space_id, chunk_id, name, relevance, 0 AS stage, place FROM exact{{h}}{{v}} UNION ALL SELECT query_id, space_id, chunk_id, name, relevance, 2, place FROM ({_other('nrow{h}{v}', 'exact{h}{v}')})",
    "new{h}{v}": """SELECT query_id, space_id, chunk_id, name, score FROM (SELECT query_id, space_id, chunk_id, arg_min(name, [stage, place]) AS name, arg_min(relevance, [stage, place]) AS score, min([stage, place]) AS o FROM all{h}{v} GROUP BY query_id, space_id, chunk_id) z
        WHERE NOT EXISTS (SELECT 1 FROM rows{p}{v} r WHERE r.query_id = z.query_id AND r.chunk_id = z.chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) <= 20""",
    "rows{h}{v}": "SELECT * FROM rows{p}{v} UNION ALL SELECT n.query_id, n.space_id, n.chunk_id, 0, 0, n.score, (SELECT count(*) FROM qpivot v WHERE v.query_id = n.query_id AND contains(n.name, v.name)), {h}, n.name, n.score FROM new{h}{v} n",
}
O.VIEWS |= {
    "several": f"""SELECT * FROM (SELECT query_id, {O.strip('content')} AS content, {_PIVOTS} AS pivots FROM question) WHERE content <> '' AND (regexp_matches(lower(content), '(^|[^\\pL\\pN_])(et|comparaison|impact|cause|depend|dépend|influence|relation|lien|si|alors|pourquoi|comment|implique|nécessite|necessite|versus|vs|différence|difference|avantage|inconvénient|inconvenient)($|[^\\pL\\pN_])') OR len(pivots) >= 2)""",
    "qpivot": "SELECT query_id, unnest(pivots) AS name FROM several",
    "hsignals": """SELECT query_id, chunk_id, max(v) AS v, max(l) AS l, max(k) AS k, max(name) AS name FROM (SELECT query_id, chunk_id, score AS v, NULL AS l, NULL AS k, NULL AS name FROM sv
        UNION ALL SELECT query_id, chunk_id, NULL, score, NULL, NULL FROM sl UNION ALL SELECT query_id, chunk_id, NULL, NULL, score, name FROM gsearch) WHERE query_id IN (SELECT query_id FROM several) GROUP BY ALL""",
    "hscaled": O.VIEWS["scaled"].replace("FROM signals", "FROM hsignals"),
    "hfused": O.VIEWS["fused"].replace("FROM scaled", "FROM hscaled"),
    "rows0": "SELECT query_id, query_id % 5 AS space_id, chunk_id, coalesce(v, 0) AS vector, coalesce(l, 0) AS lexical, coalesce(k, 0) AS kag, 0 AS evidence, 0 AS hop, name, hybrid_score AS score FROM hsignals JOIN hfused USING (query_id, chunk_id)",
    "new0": "SELECT DISTINCT query_id FROM rows0",
    "names0": "SELECT DISTINCT query_id, name FROM rows0 WHERE name IS NOT NULL",
}
O.VIEWS |= {"rows0i": "SELECT * FROM rows0", "new0i": "SELECT * FROM new0", "names0i": "SELECT * FROM names0 WHERE false"}
for _v in ("", "i"):
    for _h in (1, 2, 3):
        O.VIEWS |= {name.format(h=_h, v=_v): text.format(h=_h, p=_h - 1, v=_v) for name, text in _HOP.items()}
_NORM = ", ".join(f"CASE WHEN max({c}) OVER w - min({c}) OVER w < 1e-9 THEN 1 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c[0]}" for c in ("vector", "lexical", "kag", "evidence"))


def several_steps(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions that need several steps, and their pivots (here: normalised words of eight letters and more)."""
    pivots = F.array_distinct(F.filter(F.transform(F.split("content", " "), T.normalize_name), lambda w: F.length(w) >= 8))
    rows = questions.withColumn("pivots", pivots).where(T.needs_several_steps("content", F.size("pivots")))
    return rows.drop("pivots"), rows.select("query_id", F.explode("pivots").alias("name"))


def first_candidates(s: SparkSession, d: str, questions: DataFrame, mentions: DataFrame, known: DataFrame, pool: int = 45) -> DataFrame:
    """What three signals find in the questions' spaces, fused: vector, lexical, kag, name, score."""
    v = Q._vectors(s, d).withColumn("space_id", F.col("id") % 5)
    asked = questions.join(v.select(F.col("id").alias("query_id"), "embedding"), "query_id").select(F.col("query_id").alias("id"), "embedding", "space_id")
    vector = vectors.top_k_within(asked, v.withColumn("id", F.col("id") * 1_000_000), pool, "space_id").select("query_id", F.col("row_id").alias("chunk_id"), "score")
    chunks = V.chunk(s, d).select("chunk_id", "content", (F.col("document_id") % 5).alias("space_id"))
    words = lexical.top_k(questions.select("query_id", "content", "space_id"), chunks, pool, "space_id").select("query_id", "chunk_id", "score")
    linked = cut(multihop.search(_terms(questions), mentions, known, _K))
    vector, words = cut(vector), cut(words)
    fused = fusion.fuse(vector, words, linked.select("query_id", "chunk_id", "score")).select("query_id", "chunk_id", F.col("hybrid_score").alias("score"))
    own = lambda x, c: x.select("query_id", "chunk_id", F.col("score").alias(c))
    rows = fused.join(own(vector, "vector"), ["query_id", "chunk_id"], "left").join(own(words, "lexical"), ["query_id", "chunk_id"], "left")
    rows = rows.join(linked.select("query_id", "chunk_id", F.col("score").alias("kag"), "name"), ["query_id", "chunk_id"], "left")
    return rows.join(questions.select("query_id", "space_id"), "query_id")


_SCORED = f"""SELECT query_id, chunk_id, hop, name, round(greatest(0, 0.55 * v + 0.20 * l + 0.20 * k + 0.05 * e - ([0.0, 0.05, 0.10, 0.15])[hop + 1]), 6) AS mh_score FROM (SELECT query_id, chunk_id, hop, name, {_NORM} FROM rows3{{v}} WINDOW w AS (PARTITION BY query_id))"""


def _hops(s: SparkSession, d: str, expanding: bool) -> DataFrame:
    questions, pivots = several_steps(_asked(s, d))
    questions, held = cut(questions), _mentions(s, d)
    known = _known(held)
    found = multihop.hops(first_candidates(s, d, questions, held, known), pivots, held, known, expanding)
    return found.select("query_id", "chunk_id", "hop", "name", Q._r("mh_score"))


@query(_SCORED.format(v=""))
def multi_hop_search(s, d):
    """Questions that need several steps: three signals, scored by depth; names of the first candidates aren't followed."""
    return _hops(s, d, False)


@query(_SCORED.format(v="i"))
def multi_hop_expanding(s, d):
    """The same, following the names of the first candidates over up to three hops."""
    return _hops(s, d, True)
