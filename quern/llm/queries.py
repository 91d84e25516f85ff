"""The registered queries of the training-data operators and their DuckDB oracles.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, langid, licenses, quality, sentencepiece_codec, simhash, token_counts, topk, urlfilter
from quern.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs.select("doc_id", "text"), quality.fit(docs)).select("doc_id", "quality_score", "quality_keep")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, "text", ["doc_id"], with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(x) AS size, x FROM (
    SELECT item_id, w[i:i + least(10, len(w)) - 1] AS x
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, size, i, w[i:i + size - 1] AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), hits AS (
  SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.x = bw.x
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_spans")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", "dice", F.array_join("licenses", ",").alias("licenses"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP6_SQL = f"""
WITH t(name, text) AS (VALUES {", ".join(f"({_sql_text(name)}, {_sql_text(text)})" for name, text in licenses.TEMPLATES.items())}),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n\\s*\\n')), [text]))) AS u
  FROM documents WHERE text IS NOT NULL
), texts AS (
  SELECT doc_id, NULL AS name, 'unit' AS kind, u FROM units UNION ALL SELECT doc_id, NULL, 'text', text FROM documents WHERE text IS NOT NULL UNION ALL SELECT NULL, name, 'template', text FROM t
), worded AS (
  SELECT doc_id, name, kind, string_split(trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM texts
), sequences AS (
  SELECT doc_id, name, kind, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM worded WHERE len(w) > 1
), templates AS (
  SELECT name, list_distinct(g) AS b, len(list_distinct(g)) AS n FROM sequences WHERE kind = 'template'
), sized AS (
  SELECT name, b, n, (SELECT min(m) FROM range(1, 3 * n + 2) r(m) WHERE 2.0::DOUBLE * least(m, n) / (m + n) >= 0.8) AS low,
         (SELECT max(m) FROM range(1, 3 * n + 2) r(m) WHERE 2.0::DOUBLE * least(m, n) / (m + n) >= 0.8) AS high FROM templates
), windows AS (
  SELECT name, b, n, low, high, unnest(list_distinct([low, (low + n) // 2, n, (n + high) // 2, high])) AS wide FROM sized
), likely AS (
  SELECT d.doc_id, d.g, s.* FROM sequences d JOIN windows s ON d.kind = 'text' AND len(list_intersect(list_distinct(d.g), s.b)) >= s.low
), runs AS (
  SELECT doc_id, name, n, b, low, high, list_distinct(g[i:i + wide - 1]) AS a FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM likely) WHERE list_contains(b, g[i])
), pairs AS (
  SELECT doc_id, name, n, b, low, high, a FROM runs
  UNION ALL SELECT d.doc_id, s.name, s.n, s.b, s.low, s.high, list_distinct(d.g) FROM sequences d JOIN sized s ON d.kind = 'unit'
), scored AS (
  SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + n) AS dice FROM pairs WHERE len(a) BETWEEN low AND high
), best AS (
  SELECT doc_id, name, max(dice) AS dice FROM scored WHERE dice >= 0.8 GROUP BY ALL
), ranked AS (
  SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, string_agg(name, ',' ORDER BY name) AS licenses FROM best GROUP BY doc_id
)
SELECT d.doc_id, license, dice, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN ranked USING (doc_id)
"""

#: The rules (action, host, path) that op7 applies.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = f"""
WITH rules(action, h, p) AS (VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)
"""


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5
"""


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.TURN_SCHEMAS).withColumn("n_errors", F.size("errors")).drop("errors")


OP9_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id, conv_id || ':' || (turn - 2) AS w FROM conversations WHERE role IS DISTINCT FROM 'assistant'
), r AS (
  SELECT conv_id, turn, text, conv_id || ':' || (turn - 1) AS id FROM conversations WHERE role = 'assistant'
), checked AS (
  SELECT c.*, CAST(coalesce(text, '') = '' AS INTEGER) + CAST(role = 'user' AND turn >= 2 AND w NOT IN (SELECT id FROM c) AS INTEGER) AS n_errors,
         json_object('arguments', json_object('text', text, 'turn', turn), 'id', id, 'name', role, 'turn', turn) AS j FROM c
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS call_id, c.role AS name, c.turn AS turn,
       CASE WHEN c.id IS NULL THEN NULL ELSE 0 END AS place, CASE WHEN c.id IS NULL THEN NULL ELSE 0 END AS topo_level,
       CASE WHEN c.id IS NULL THEN 'no_call' WHEN r.id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       CAST(c.id IS NOT NULL AS BIGINT) AS copies, CAST(r.id IS NOT NULL AS BIGINT) AS answers, r.turn AS result_turn, c.id IS NOT NULL AND n_errors = 0 AS valid, coalesce(n_errors, 0) AS n_errors,
       CAST(CASE WHEN r.id IS NULL THEN json_object('call', j)
            WHEN c.id IS NULL THEN json_object('result', json_object('content', r.text, 'id', r.id, 'turn', r.turn))
            ELSE json_object('call', j, 'result', json_object('content', r.text, 'id', r.id, 'turn', r.turn)) END AS VARCHAR) AS message
FROM checked c FULL JOIN r ON c.id = r.id
"""


def op9_chat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.from_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.TURN_SCHEMAS, every=True).withColumn("n_errors", F.size("errors")).drop("errors")


OP9_LEVELS_SQL = f"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, role FROM conversations WHERE role IS DISTINCT FROM 'assistant'
), waits AS (
  SELECT c.conv_id, c.turn, w.turn AS w FROM calls c LEFT JOIN calls w ON c.conv_id = w.conv_id AND c.role = 'user' AND c.turn >= 2 AND w.turn = c.turn - 2
), levels AS (
  SELECT conv_id, turn, 0 AS level FROM waits WHERE w IS NULL
  UNION ALL SELECT k.conv_id, k.turn, level + 1 FROM waits k JOIN levels l ON k.conv_id = l.conv_id AND k.w = l.turn
)
SELECT flat.* REPLACE (CAST(level AS INTEGER) AS topo_level) FROM ({OP9_SQL}) flat LEFT JOIN levels ON flat.call_id = levels.conv_id || ':' || levels.turn
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "text", ["doc_id"])
    return counted.select("doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_licenses": op6_licenses,
    "op7_url_filter": op7_url_filter,
    "op8_topk": op8_topk,
    "op9_chat": op9_chat,
    "op9_chat_levels": op9_chat_levels,
    "op10_token_counts": op10_token_counts,
}
ORACLES: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op6_licenses": OP6_SQL, "op7_url_filter": OP7_SQL, "op8_topk": OP8_SQL, "op9_chat": OP9_SQL, "op9_chat_levels": OP9_LEVELS_SQL}
