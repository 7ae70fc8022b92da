"""The subpackage's queries and, where SQL expresses them, their DuckDB SQL."""

from kgeo.llm.ann import op8_learned_partitions
from kgeo.llm.bpe import op4_byte_bpe
from kgeo.llm.cap_join import op9_cap_filters
from kgeo.llm.chat import op5_chat_format
from kgeo.llm.language import op2_language_id
from kgeo.llm.line_dedup import op6_line_dedup
from kgeo.llm.minhash import op1_minhash_near_dedup
from kgeo.llm.packing import op7_packing
from kgeo.llm.token_records import op3_token_records
from kgeo.llm.url_filter import op10_url_filter

QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_language_id, op3_token_records, op4_byte_bpe, op5_chat_format, op6_line_dedup, op7_packing, op8_learned_partitions, op9_cap_filters, op10_url_filter)}

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
"""

ORACLE_SQL = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: list_aggregate(w[i:i + 2], 'string_agg', ' '))) AS s FROM cut WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),"""
    + _COMPONENTS
    + """SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, s.n""",
    "op5_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    coalesce(lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '') AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM rows),
judged AS (
  SELECT *, CASE WHEN (before = '' AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user') OR (before = 'user' AND role = 'assistant')
      OR (before = 'assistant' AND role = 'user') THEN NULL
    ELSE CASE WHEN role = '' THEN 'no role' ELSE role END || ' after ' || CASE WHEN before = '' THEN 'start' ELSE before END END AS problem,
    length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|<<ROLE>>|<<TEXT>>|<</ROLE>>|\[INST\]|\[/INST\]|<s>|</s>')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END)::BIGINT AS formatted_chars,
  count(problem) = 0 AS valid, min_by(problem, n) FILTER (problem IS NOT NULL) AS problem
FROM judged GROUP BY conv_id""",
    "op9_cap_filters": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v WHERE len(e) = len(list_filter(e, lambda x: isfinite(x))) AND list_dot_product(e, e) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.9),"""
    + _COMPONENTS
    + """, degree AS (SELECT a, count(*) AS n FROM links GROUP BY 1), least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM v LEFT JOIN degree d ON d.a = vec_id LEFT JOIN least_of l ON l.a = vec_id""",
}
