"""Queries and SQL of this subpackage, as __spark_entry__.py adds them."""

from __future__ import annotations

from .chat import OPENING, op1_schema_fingerprint_chat
from .gam import op6_additive_quality
from .hmm import op2_hidden_markov
from .imatch import op3_imatch_lexicons
from .langid import op5_language_mixture
from .mixing import op10_fair_queue_mix
from .packing import op4_vector_best_fit
from .pstable import op7_pstable_vectors
from .simhash import op9_simhash_byte_index
from .urlfilter import ORACLE as URL_ORACLE
from .urlfilter import op8_url_lm_ratio

QUERIES = {
    "op1_schema_fingerprint_chat": op1_schema_fingerprint_chat,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_imatch_lexicons": op3_imatch_lexicons,
    "op4_vector_best_fit": op4_vector_best_fit,
    "op5_language_mixture": op5_language_mixture,
    "op6_additive_quality": op6_additive_quality,
    "op7_pstable_vectors": op7_pstable_vectors,
    "op8_url_lm_ratio": op8_url_lm_ratio,
    "op9_simhash_byte_index": op9_simhash_byte_index,
    "op10_fair_queue_mix": op10_fair_queue_mix,
}

_ESCAPED = "length(regexp_replace(replace({0}, '\\', '\\\\'), '" + OPENING + "', '\\1\\\\', 'g'))"

#: SQL for the operators that it can express; the others are tested against plain code.
ORACLE_SQL = {
    "op1_schema_fingerprint_chat": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, 'turn_rows' AS layout FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'prompt_response'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'prompt_response')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + {_ESCAPED.format("r")} + {_ESCAPED.format("x")}) AS BIGINT) AS formatted_chars, any_value(layout) AS layout
FROM t GROUP BY conv_id""",
    "op7_pstable_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT id, b FROM reach JOIN links ON other = a),
lowest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM lowest LEFT JOIN counted ON id = a""",
    "op8_url_lm_ratio": URL_ORACLE,
}
