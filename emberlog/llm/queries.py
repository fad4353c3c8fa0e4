"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, graphindex, langid, linededup, mixing, packing, quality, simhash, toxicity, urlfilter, vectorcodes, vectordedup

#: The rules that op6 judges by.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Where the public vocabularies lie, on each machine.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_graph_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphindex.nearest(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.judge(_table(spark, sf_dir, "documents"), labels)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.judge(_table(spark, sf_dir, "documents"), labels)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(_table(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = [f"{TOKENIZERS}/{name}" for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_documents(_table(spark, sf_dir, "documents"), *vocabularies)


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_graph_nearest_neighbours": op2_graph_nearest_neighbours,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filter": op6_url_filter,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
    "op11_vector_codes": op11_vector_codes,
    "op12_line_dedup": op12_line_dedup,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_RULES = """(VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(h, p, v)"""



def _codes_sql(rounds: int = 4) -> str:
    """op11 in SQL: the rounds one after the other, each as tables of codes (a) and of entries (c)."""
    near = """a{r} AS MATERIALIZED (SELECT n, p, min({{'d': d, 'i': i}}) AS m FROM (
  SELECT w.n, w.p, c.i, list_sum(list_transform(range(1, 17), lambda j: (w.w[j] - c.w[j]) * (w.w[j] - c.w[j])))::BIGINT AS d FROM w JOIN c{r} c ON w.p = c.p) GROUP BY n, p)"""
    move = """s{r} AS (SELECT p, i, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.p, a.m.i AS i, unnest(range(1, 17)) AS j, unnest(w.w) AS x FROM a{r} a JOIN w ON a.n = w.n AND a.p = w.p) GROUP BY p, i, j),
c{next} AS MATERIALIZED (SELECT c.p, c.i, coalesce(l.w, c.w) AS w FROM c{r} c LEFT JOIN (SELECT p, i, list(x ORDER BY j) AS w FROM s{r} GROUP BY p, i) l ON c.p = l.p AND c.i = l.i)"""
    steps = [x.format(r=r, next=r + 1) for r in range(rounds) for x in (near, move)] + [near.format(r=rounds)]
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT n, p, v[p * 16 + 1 : p * 16 + 16] AS w FROM k, range(4) t(p)),
c0 AS MATERIALIZED (SELECT p, n - 1 AS i, w FROM w WHERE n <= 256),
{", ".join(steps)},
e AS (SELECT n, string_agg(lower(lpad(hex(m.i), 2, '0')), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY n),
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256, label FROM k JOIN e USING (n), h"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op12_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
l AS (SELECT DISTINCT doc_id, unnest(keys) AS key FROM k),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(*) > 1),
g AS (SELECT l.doc_id, list(l.key) AS gone FROM l JOIN r USING (key) WHERE l.doc_id > first GROUP BY 1),
f AS (SELECT k.doc_id, lines, CASE WHEN gone IS NULL THEN lines ELSE list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, keys[i])), lambda i: lines[i]) END AS stay FROM k LEFT JOIN g USING (doc_id))
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_dropped, sha256(array_to_string(stay, chr(10))) AS kept_sha256 FROM f""",
    "op6_url_filter": f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS cut,
         row_number() OVER () AS n
  FROM pages),
s AS (
  SELECT page_id, n,
         CASE WHEN cut = 0 THEN '' ELSE regexp_extract(substr(url, cut + 3), '^[^/?#]*') END AS host0,
         CASE WHEN cut = 0 THEN '' ELSE substr(url, cut + 3) END AS rest
  FROM u),
t AS (
  SELECT page_id, n, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path
  FROM s),
m AS (
  SELECT n, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS v
  FROM t JOIN {_RULES} ON (t.host = r.h OR ends_with(t.host, '.' || r.h)) AND starts_with(t.path, r.p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM t LEFT JOIN m USING (n)""",
    "op9_chat_formatting": """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY encode(CAST(to_json(text) AS VARCHAR))) = 1 AS main FROM m WHERE role = 'user'),
a AS (SELECT *, turn - 1 AS asked, row_number() OVER (PARTITION BY conv_id, turn ORDER BY encode(text)) = 1 AS main FROM m WHERE role = 'assistant'),
chain AS (SELECT conv_id, turn, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM
  (SELECT *, CASE WHEN turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) <= 2 THEN 0 ELSE 1 END AS fresh FROM u WHERE main)),
lv AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS INTEGER) AS level FROM chain),
r AS (
  SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.turn, a.asked) AS call, u.turn AS place, u.text AS prompt, a.text AS content, coalesce(u.copies, a.copies) AS copies,
         CASE WHEN u.turn IS NULL THEN 'no_call' WHEN a.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status
  FROM (SELECT * FROM u WHERE main) u FULL JOIN (SELECT * FROM a WHERE main) a ON u.conv_id = a.conv_id AND u.turn = a.asked
  UNION ALL SELECT conv_id, turn, turn, text, NULL, copies, 'repeated' FROM u WHERE NOT main
  UNION ALL SELECT conv_id, asked, NULL, NULL, text, copies, 'repeated' FROM a WHERE NOT main),
j AS (SELECT *, CASE WHEN prompt IS NOT NULL THEN '"arguments":{"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"turn":' || call || '}' END AS args,
      CASE WHEN prompt IS NOT NULL THEN '"name":"reply"' END AS name, '"result":' || CAST(to_json(content) AS VARCHAR) AS result FROM r),
k AS (SELECT *, CAST(call AS VARCHAR) || CASE WHEN status = 'repeated' THEN '~' || substr(md5('{' || concat_ws(',', args, name, result) || '}'), 1, 12) ELSE '' END AS call_id FROM j)
SELECT k.conv_id, call_id, coalesce(level, 0) AS level, place, status, CASE WHEN prompt IS NOT NULL THEN regexp_matches(prompt, '\\S') AND length(CAST(to_json(prompt) AS VARCHAR)) <= 8002 END AS valid, copies,
       '{' || concat_ws(',', args, '"id":"' || call_id || '"', name, result) || '}' AS json
FROM k LEFT JOIN lv ON k.conv_id = lv.conv_id AND k.call = lv.turn
UNION ALL SELECT conv_id, NULL, 0, turn, 'message', NULL, copies, '{' || concat_ws(',', '"content":' || CAST(to_json(text) AS VARCHAR), '"role":' || CAST(to_json(role) AS VARCHAR)) || '}'
FROM m WHERE coalesce(role, '') NOT IN ('user', 'assistant')""",
}
