"""The registered corpus queries and, where SQL can express one, its SQL."""

from __future__ import annotations

import functools
import os

from weekloom.llm.ann import op2_nearest_neighbours
from weekloom.llm.chat import op5_chat_formatting
from weekloom.llm.embed_dedup import op10_embedding_near_dedup
from weekloom.llm.langid import op6_language_id
from weekloom.llm.mixing import op3_source_mixing
from weekloom.llm.packing import op13_best_fit_packing
from weekloom.llm.pii import op4_pii
from weekloom.llm.repair import op12_structure_repair
from weekloom.llm.runs import op11_periodic_runs
from weekloom.llm.secret_scan import op1_secret_scan
from weekloom.llm.simhash import op9_simhash_near_dedup
from weekloom.llm.spm_codec import op8_sentencepiece
from weekloom.llm.token_output import op7_token_output

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark) -> None:
    """Let Python workers that start from now on import this package from where the driver has it."""
    known = spark.sparkContext.environment
    if _ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (_ROOT, known.get("PYTHONPATH"))))


def importing(query):
    @functools.wraps(query)
    def run(spark, *rest):
        reachable(spark)
        return query(spark, *rest)

    return run


QUERIES = {
    f.__name__: importing(f)
    for f in (
        op1_secret_scan,
        op2_nearest_neighbours,
        op3_source_mixing,
        op4_pii,
        op5_chat_formatting,
        op6_language_id,
        op7_token_output,
        op8_sentencepiece,
        op9_simhash_near_dedup,
        op10_embedding_near_dedup,
        op11_periodic_runs,
        op12_structure_repair,
        op13_best_fit_packing,
    )
}

_USABLE = "list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0"

ORACLE_SQL: dict[str, str] = {
    "op2_nearest_neighbours": f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
""",
    "op5_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)|(\|)(>)|(\[)(/?INST\])', '\1\3\5\\\2\4\6', 'g'))
    + length(role) + 17 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op10_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
l AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.n * b.n) >= 0.93),
r AS (SELECT a AS x, b AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, least(e.vec_id, coalesce(m.c, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(m.c, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id
LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = e.vec_id
""",
}
