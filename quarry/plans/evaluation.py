"""Evaluation run: the golden set through the question path, then the four
lexical metrics and their means (V1-V7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import chat
from quarry.operators import evaluate as V
from quarry.plans import answer


def golden(t) -> DataFrame:
    """The golden set from ``benchmark``: the passage is both the question
    and the ground truth."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"),
                              F.col("text").alias("ground_truth"))


def records(t) -> DataFrame:
    g = golden(t)
    hits = answer.chunk_hits(g.select("query_id", F.col("question").alias("text")), t.documents)
    return V.eval_records(g, hits)


def pair_metrics(t) -> DataFrame:
    """conv_id, turn, faithfulness, answer_relevancy for each reply pair."""
    p = chat.reply_pairs(t.conversations)
    faith = p.select("conv_id", "turn", V.faithfulness("answer", "question").alias("faithfulness"))
    return V.answer_relevancy(p, ["conv_id", "turn"]).join(faith, ["conv_id", "turn"])


def record_metrics(r: DataFrame) -> DataFrame:
    return r.select("query_id",
                    V.context_recall("ground_truth", F.array_join("contexts", " ")).alias("context_recall"),
                    F.round(V.context_precision("ground_truth", F.col("contexts")), 6)
                    .alias("context_precision"))


def _long(df: DataFrame, names: list[str]) -> DataFrame:
    """One aggregate pass over ``df`` for all ``names``, then one row per
    metric (``stack``), no join."""
    aggs = []
    for n in names:
        aggs += [F.round(F.avg(n), 4).alias(f"{n}__v"), F.count(n).alias(f"{n}__n")]
    row = df.agg(*aggs)
    pairs = ", ".join(f"'{n}', `{n}__v`, `{n}__n`" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value, n)")


def summary(t) -> DataFrame:
    """One row per metric: mean (4 places) and number of scored records."""
    return (_long(pair_metrics(t), ["faithfulness", "answer_relevancy"])
            .unionByName(_long(record_metrics(records(t)), ["context_recall", "context_precision"])))
