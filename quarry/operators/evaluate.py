"""Deterministic lexical retrieval / answer metrics as Spark expressions.

``support(s, T)``: the share of the distinct terms of ``s`` that occur in
``T``; a sentence is supported when the share reaches ``tau``. Sentences
without terms are left out. All metrics are row-local array expressions
over one evaluation record (question, answer, contexts, truth), so they
need no shuffle beyond assembling the record, and never pair terms across
records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import let, sentences
from quarry.functions.text import term_set as _term_set

TAU = 0.6  # fixed value: support threshold
ERROR_ANSWER = "Error"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def term_set(text) -> Column:
    return _term_set(text)


def _share(s_terms: Column, pool: Column) -> Column:
    return F.size(F.array_intersect(s_terms, pool)) / F.size(s_terms)


def supported_fraction(text, pool_terms: Column, tau: float = TAU) -> Column:
    """Supported sentences of ``text`` / sentences of ``text`` with terms;
    NULL when no sentence has a term."""
    toks = F.filter(F.transform(sentences(text), lambda s: term_set(s)), lambda t: F.size(t) > 0)

    def frac(pool, ts):
        ok = F.size(F.filter(ts, lambda t: _share(t, pool) >= tau))
        return F.when(F.size(ts) > 0, ok / F.size(ts))
    # bind the sentence terms and the pool once per row
    return let(F.struct(pool_terms.alias("p"), toks.alias("t")), lambda b: frac(b["p"], b["t"]))


# V3 -------------------------------------------------------------------------
def faithfulness(answer, contexts_text, tau: float = TAU) -> Column:
    """Answer sentences supported by the contexts / answer sentences."""
    return supported_fraction(answer, term_set(contexts_text), tau)


# V5 -------------------------------------------------------------------------
def context_recall(truth, contexts_text, tau: float = TAU) -> Column:
    """Ground-truth sentences supported by the contexts / all of them."""
    return supported_fraction(truth, term_set(contexts_text), tau)


# V6 -------------------------------------------------------------------------
def context_precision(truth, hits_sorted: Column, tau: float = TAU) -> Column:
    """sum_k precision@k * v_k / sum_k v_k, with v_k = 1 when hit k holds
    at least ``tau`` of the truth's terms; 0 when no hit is relevant.
    ``hits_sorted`` is ARRAY<STRING> in rank order."""
    return let(F.struct(term_set(truth).alias("tt"), _c(hits_sorted).alias("h")),
               lambda b: _precision(b["tt"], b["h"], tau))


def _precision(tt: Column, hits: Column, tau: float) -> Column:
    v = F.transform(hits, lambda h: F.when(
        (F.size(tt) > 0) & (_share(tt, term_set(h)) >= tau), F.lit(1)).otherwise(F.lit(0)))
    return let(v, lambda vv: _precision_of(vv))


def _precision_of(v: Column) -> Column:
    n = F.size(v)
    num = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0),
        lambda acc, k: acc + F.when(
            k <= n, F.aggregate(F.slice(v, 1, k), F.lit(0), lambda a, x: a + x) / k
            * F.element_at(v, k)).otherwise(F.lit(0.0)))
    den = F.aggregate(v, F.lit(0), lambda a, x: a + x)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


# V4 -------------------------------------------------------------------------
def answer_relevancy(pairs: DataFrame, key: list[str], question: str = "question",
                     answer: str = "answer", dim: int = 768, digits: int = 6) -> DataFrame:
    """Cosine of the hashed embeddings of question and answer per pair.

    Both sides' sparse vectors are unioned and summed per (pair, bucket),
    so only buckets of the same pair meet; NULL when a side has no term.
    """
    from quarry.operators.embed import hash_embed_sparse
    pid = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    base = pairs.select(*key, pid.alias("_pid"), question, answer)
    qe = hash_embed_sparse(base.select("_pid", F.col(question).alias("text")), "_pid", dim=dim)
    ae = hash_embed_sparse(base.select("_pid", F.col(answer).alias("text")), "_pid", dim=dim)
    both = qe.withColumn("_s", F.lit(0)).unionByName(ae.withColumn("_s", F.lit(1)))
    per_bucket = both.groupBy("_pid", "bucket").agg(
        F.sum(F.when(F.col("_s") == 0, F.col("value"))).alias("_a"),
        F.sum(F.when(F.col("_s") == 1, F.col("value"))).alias("_b"))
    per_pair = per_bucket.groupBy("_pid").agg(
        F.sum(F.coalesce(F.col("_a") * F.col("_b"), F.lit(0.0))).alias("_dot"),
        F.count("_a").alias("_nq"), F.count("_b").alias("_na"))
    out = base.select(*key, "_pid").join(per_pair, "_pid", "left")
    rel = F.when((F.col("_nq") > 0) & (F.col("_na") > 0), F.round("_dot", digits))
    return out.select(*key, rel.alias("answer_relevancy"))


# V1 / V2 --------------------------------------------------------------------
def eval_records(questions: DataFrame, hits: DataFrame, id_col: str = "query_id") -> DataFrame:
    """One record per question: contexts (hit texts in rank order) and the
    answer (the top context, or 'Error' with no contexts when retrieval
    found nothing). Needs hits(query_id, rank, content)."""
    ctx = (hits.groupBy(id_col)
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))),
                            lambda h: h["content"]).alias("contexts")))
    rec = questions.join(ctx, id_col, "left")
    return rec.select(id_col, "question", "ground_truth",
                      F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"),
                      F.coalesce(F.element_at("contexts", 1), F.lit(ERROR_ANSWER)).alias("answer"))
