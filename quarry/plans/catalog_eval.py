"""Registered checks: evaluation records and the four lexical metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chat
from quarry.operators import evaluate as V
from quarry.plans.catalog_chat import PAIRS_SQL
from quarry.plans.registry import Tables, register
from quarry.plans.sqlparts import context_cte, embed_cte, supported_fraction_expr, term_set_expr

GOLDEN_SQL = "_gold AS (SELECT item_id, text FROM benchmark)"

# The golden set comes from `benchmark`: the passage is both the question
# and the ground truth (half of them occur verbatim in some document).
RECORDS_SQL = f"""{GOLDEN_SQL},
{context_cte('_gold', 'item_id')},
_rec AS (SELECT g.item_id AS query_id, g.text AS question, g.text AS ground_truth,
                coalesce(list(fmt.content ORDER BY fmt.rank) FILTER (WHERE fmt.rank IS NOT NULL), []) AS contexts
         FROM _gold g LEFT JOIN fmt ON fmt.query_id = g.item_id
         GROUP BY g.item_id, g.text)"""


from quarry.plans.evaluation import golden, records  # noqa: E402


@register("eval_records", ops=("V1", "V2", "S3"), sql=f"""
WITH {RECORDS_SQL}
SELECT query_id, question, ground_truth,
       coalesce(contexts[1], 'Error') AS answer, CAST(len(contexts) AS INTEGER) AS n_contexts,
       array_to_string(contexts, chr(10) || '---' || chr(10)) AS contexts_joined
FROM _rec""")
def q_eval_records(spark, sf):
    r = records(Tables(spark, sf))
    return r.select("query_id", "question", "ground_truth", "answer",
                    F.size("contexts").alias("n_contexts"),
                    F.array_join("contexts", "\n---\n").alias("contexts_joined"))


@register("faithfulness", ops=("V3",), sql=f"""
WITH {PAIRS_SQL}
SELECT conv_id, turn,
       round({supported_fraction_expr('answer', term_set_expr('question'))}, 6) AS faithfulness
FROM _pairs""")
def q_faithfulness(spark, sf):
    p = chat.reply_pairs(Tables(spark, sf).conversations)
    return p.select("conv_id", "turn", F.round(V.faithfulness("answer", "question"), 6).alias("faithfulness"))


REL_SQL = f"""{PAIRS_SQL},
_qsrc AS (SELECT CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR) AS pid, question AS text FROM _pairs),
_asrc AS (SELECT CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR) AS pid, answer AS text FROM _pairs),
{embed_cte('_qsrc', 'pid', name='embq')},
{embed_cte('_asrc', 'pid', name='emba')},
_dot AS (SELECT q.id, sum(q.value * a.value) AS d FROM embq q JOIN emba a ON a.id = q.id AND a.bucket = q.bucket
         GROUP BY q.id),
_hq AS (SELECT DISTINCT id FROM embq), _ha AS (SELECT DISTINCT id FROM emba),
_rel AS (SELECT p.conv_id, p.turn,
       CASE WHEN _hq.id IS NOT NULL AND _ha.id IS NOT NULL THEN
         CASE WHEN round(coalesce(_dot.d, 0.0), 6) = 0 THEN 0.0 ELSE round(coalesce(_dot.d, 0.0), 6) END END
         AS answer_relevancy
  FROM _pairs p
  LEFT JOIN _dot ON _dot.id = CAST(p.conv_id AS VARCHAR) || '|' || CAST(p.turn AS VARCHAR)
  LEFT JOIN _hq ON _hq.id = CAST(p.conv_id AS VARCHAR) || '|' || CAST(p.turn AS VARCHAR)
  LEFT JOIN _ha ON _ha.id = CAST(p.conv_id AS VARCHAR) || '|' || CAST(p.turn AS VARCHAR))"""


@register("answer_relevancy", ops=("V4",), sql=f"""
WITH {REL_SQL}
SELECT conv_id, turn, answer_relevancy FROM _rel""")
def q_answer_relevancy(spark, sf):
    p = chat.reply_pairs(Tables(spark, sf).conversations)
    return V.answer_relevancy(p, ["conv_id", "turn"])


@register("context_recall", ops=("V5",), sql=f"""
WITH {RECORDS_SQL}
SELECT query_id,
       round({supported_fraction_expr('ground_truth', term_set_expr("array_to_string(contexts, ' ')"))}, 6)
         AS context_recall
FROM _rec""")
def q_context_recall(spark, sf):
    r = records(Tables(spark, sf))
    return r.select("query_id", F.round(V.context_recall("ground_truth", F.array_join("contexts", " ")), 6)
                    .alias("context_recall"))


_V_SQL = ("list_transform(contexts, lambda h: CASE WHEN len(_tt) > 0 AND "
          "len(list_intersect(_tt, " + term_set_expr("h") + ")) / len(_tt) >= 0.6 THEN 1 ELSE 0 END)")


PREC_SQL = f"""_r2 AS (SELECT query_id, contexts, {term_set_expr('ground_truth')} AS _tt FROM _rec),
_v AS (SELECT query_id, {_V_SQL} AS v FROM _r2),
_prec AS (SELECT query_id,
       round(CASE WHEN coalesce(list_sum(v), 0) > 0 THEN
         list_sum(list_transform(range(1, len(v) + 1), lambda k: list_sum(v[1:k]) / k * v[k])) / list_sum(v)
         ELSE 0.0 END, 6) AS context_precision
  FROM _v)"""


@register("context_precision", ops=("V6",), sql=f"""
WITH {RECORDS_SQL},
{PREC_SQL}
SELECT query_id, context_precision FROM _prec""")
def q_context_precision(spark, sf):
    r = records(Tables(spark, sf))
    return r.select("query_id", F.round(V.context_precision("ground_truth", F.col("contexts")), 6)
                    .alias("context_precision"))


@register("eval_summary", ops=("V7",), sql=f"""
WITH {REL_SQL},
{RECORDS_SQL},
{PREC_SQL},
_f AS (SELECT {supported_fraction_expr('answer', term_set_expr('question'))} AS x FROM _pairs),
_c AS (SELECT {supported_fraction_expr('ground_truth', term_set_expr("array_to_string(contexts, ' ')"))} AS x
       FROM _rec)
SELECT 'faithfulness' AS metric, round(avg(x), 4) AS value, count(x) AS n FROM _f
UNION ALL SELECT 'answer_relevancy', round(avg(answer_relevancy), 4), count(answer_relevancy) FROM _rel
UNION ALL SELECT 'context_recall', round(avg(x), 4), count(x) FROM _c
UNION ALL SELECT 'context_precision', round(avg(context_precision), 4), count(context_precision) FROM _prec""")
def q_eval_summary(spark, sf):
    from quarry.plans.evaluation import summary
    return summary(Tables(spark, sf))
