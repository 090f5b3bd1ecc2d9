"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import centroids, counts, decontaminate, dedup, jaccard, lattice, licenses, minhash, packing, pfor, pii, resample, tokens, toxicity
from quarry.llm.frames import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.annotate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    v = "decontamination"
    return out.select("doc_id", *(F.col(f"{v}.{c}") for c in ("n_words", "n_hit", "n_items")), decontaminate.digest(f"{v}.items").alias("items_sha256"), f"{v}.contaminated")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
s AS (SELECT item, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM s),
g AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM d JOIN k ON len(w) >= k),
h AS (SELECT r, i, k, item FROM g JOIN s USING (k, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""


def op2_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_read(spark, sf_dir, "documents"), tokens.vocabulary("piece_bpe_32k.model"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
u AS MATERIALIZED (SELECT min(r) AS a, any_value(len(s)) AS n, any_value(s) AS s, k FROM (SELECT r, s, md5(array_to_string(list_sort(s), chr(10))) AS k FROM x WHERE len(s) > 0) GROUP BY k),
e AS (SELECT a, n, unnest(s) AS h FROM u),
p AS MATERIALIZED (SELECT l.a, m.a AS b FROM e l JOIN e m ON l.h = m.h AND l.a < m.a AND 5 * least(l.n, m.n) >= 4 * greatest(l.n, m.n) GROUP BY l.a, m.a, l.n, m.n HAVING 5 * count(*) >= 4 * (l.n + m.n - count(*))),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT a, a AS o FROM u UNION SELECT q.b, c.o FROM c JOIN q USING (a)),
g AS (SELECT a, min(o) AS o FROM c GROUP BY a),
f AS (SELECT x.r, x.doc_id, len(x.s) AS n, g.o FROM x LEFT JOIN (SELECT k, a FROM u) u ON len(x.s) > 0 AND md5(array_to_string(list_sort(x.s), chr(10))) = u.k LEFT JOIN g USING (a))
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY o) END AS component_id FROM f
"""


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", *(pii.number_of(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op5_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    manifest = pfor.write(_read(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"), folder if "://" in folder else f"file://{folder}")
    return pfor.read(manifest)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.annotate(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokens.vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "tokens.n_bytes", "tokens.n_tokens", "tokens.over_limit", "tokens.fit_chars")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_read(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.identities(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.annotate(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))
    score = F.col("toxicity.score")
    return out.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP11_SQL = OP3_SQL.replace("5 * least(l.n, m.n) >= 4 * greatest(l.n, m.n)", "20 * least(l.n, m.n) >= 17 * greatest(l.n, m.n)").replace("5 * count(*) >= 4 * (l.n + m.n - count(*))", "20 * count(*) >= 17 * (l.n + m.n - count(*))")
OP11_SQL = f"SELECT *, doc_id = component_id AS kept FROM ({OP11_SQL})"


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.annotate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The bytes of each distinct word go through the table of CRC32.
_CRC_TABLE = "range(0, 256)"
for _ in range(8):
    _CRC_TABLE = f"list_transform({_CRC_TABLE}, lambda n: CASE WHEN n & 1 = 1 THEN xor(n >> 1, 3988292384) ELSE n >> 1 END)"
OP12_SQL = f"""
WITH k AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d),
bw AS MATERIALIZED (SELECT unnest(w) AS w FROM b),
x AS (SELECT w, list_prepend(4294967295, list_transform(range(1, length(hex(w)), 2), lambda i: CAST('0x' || substr(hex(w), i, 2) AS BIGINT))) AS bytes FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
c AS MATERIALIZED (SELECT w, xor(list_reduce(bytes, lambda c, y: xor(c >> 8, t[CAST(xor(c, y) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM x, k),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (w) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT count(*) FROM bw) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n FROM dw JOIN c USING (w) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT doc_id, len(w) AS n_features, CASE WHEN n > 0 THEN CAST((total - ((total % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS noise FROM d LEFT JOIN m USING (r)),
f AS (SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) END AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(place) * 10 // 100 FROM f) THEN place END AS rank FROM f
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.annotate(_read(spark, sf_dir, "embeddings"))


_NEAREST = """a{i} AS MATERIALIZED (SELECT r, vec_id, x, arg_min(k, [d, k]) AS k, min(d) AS d FROM
    (SELECT r, vec_id, v.x AS x, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, c{i} c) GROUP BY r, vec_id, x)"""
_MOVED = """c{j} AS MATERIALIZED (SELECT c{i}.k AS k, coalesce(m.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM
    (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m ON m.k = c{i}.k)"""
OP13_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda y: CAST(floor(256 * y) AS BIGINT)) AS x FROM e WHERE len(list_filter(e, lambda y: coalesce(isfinite(y), false))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x FROM v QUALIFY k < 40),
{", ".join(_NEAREST.format(i=i) + ", " + _MOVED.format(i=i, j=i + 1) for i in range(5))}, {_NEAREST.format(i=5)}
SELECT vec_id, CAST(a5.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a5.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.x, ',')) AS centroid_sha256 FROM a5 JOIN c5 ON a5.k = c5.k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_lattice_score, op3_jaccard_join, op4_personal_data, op5_binary_output, op6_token_counts, op7_packing, op8_exact_dedup, op9_toxicity, op10_license_scan, op11_minhash, op12_importance_resampling, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op8_exact_dedup": OP8_SQL, "op11_minhash": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_centroids": OP13_SQL}
