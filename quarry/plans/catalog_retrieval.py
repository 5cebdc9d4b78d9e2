"""Registered checks: chunking for retrieval, full-text index, top-k
retrieval (sparse, dense, hybrid) and context formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.chunk import page_estimate, token_chunks
from quarry.operators.index import doc_freq, postings
from quarry.operators.retrieve import dense_topk, dense_topk_lsh, hybrid_merge
from quarry.plans import answer
from quarry.plans.registry import Tables, register, scratch
from quarry.plans.sqlparts import bm25_cte, context_cte, dense_cte, terms_expr, token_chunks_cte


@register("token_chunks", ops=("T3", "A9"), sql=f"""
WITH {token_chunks_cte()}
SELECT doc_id, chunk_index, chunk_id, text FROM chunks""")
def q_token_chunks(spark, sf):
    return token_chunks(Tables(spark, sf).documents).select("doc_id", "chunk_index", "chunk_id", "text")


@register("page_estimate", ops=("P10",), sql=f"""
WITH {token_chunks_cte()}
SELECT chunk_id, chunk_index,
       CAST(greatest(1, (chunk_index * 800) // 2000 + 1) AS INTEGER) AS page_number
FROM chunks""")
def q_page_estimate(spark, sf):
    ch = token_chunks(Tables(spark, sf).documents)
    return ch.select("chunk_id", "chunk_index", page_estimate("chunk_index").alias("page_number"))


@register("postings", ops=("R3",), sql=f"""
WITH t AS (SELECT doc_id, {terms_expr('text')} AS terms FROM documents)
SELECT doc_id, term, count(*) AS tf, CAST(any_value(len(terms)) AS INTEGER) AS doc_len
FROM (SELECT doc_id, terms, unnest(terms) AS term FROM t)
GROUP BY doc_id, term""")
def q_postings(spark, sf):
    return postings(Tables(spark, sf).documents).select("doc_id", "term", "tf", "doc_len")


@register("doc_freq", ops=("R4",), sql=f"""
WITH t AS (SELECT doc_id, {terms_expr('text')} AS terms FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t)
      GROUP BY doc_id, term)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term""")
def q_doc_freq(spark, sf):
    return doc_freq(postings(Tables(spark, sf).documents))


@register("sparse_topk", ops=("R5", "R6"), sql=f"""
WITH {bm25_cte('documents', 'doc_id', 'benchmark', 'item_id')}
SELECT query_id, rank, doc_id, score FROM hits""")
def q_sparse_topk(spark, sf):
    t = Tables(spark, sf)
    return answer.sparse_hits(t.benchmark, t.documents)


@register("format_context", ops=("R8", "P7", "E5", "A9"), sql=f"""
WITH {context_cte('benchmark', 'item_id')}
SELECT query_id, context FROM ctx""")
def q_format_context(spark, sf):
    t = Tables(spark, sf)
    return answer.retrieve_context(t.benchmark.withColumnRenamed("item_id", "query_id"), t.documents)


@register("context_from_index", ops=("R8", "K4", "R4"), sql=f"""
WITH {context_cte('benchmark', 'item_id')}
SELECT query_id, context FROM ctx""")
def q_context_from_index(spark, sf):
    """The same answers from a written index (chunk table + postings +
    statistics) in the shared checkpoint folder: index once, query many."""
    from quarry.plans import index_store
    t = Tables(spark, sf)
    path = scratch(spark, "index")
    index_store.build(t.documents, path)
    return index_store.answer(spark, path, t.benchmark.withColumnRenamed("item_id", "query_id"))


def _query_vectors(t):
    """Benchmark items as query vectors (their embeddings)."""
    return (t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
            .select(F.col("vec_id").alias("query_id"), "embedding"))


@register("dense_topk", ops=("R1",), sql=f"""
WITH {dense_cte()}
SELECT query_id, rank, doc_id, score FROM dense""")
def q_dense_topk(spark, sf):
    t = Tables(spark, sf)
    return dense_topk(_query_vectors(t), t.embeddings, k=2, exclude_self=True)


@register("hybrid_topk", ops=("R7",), sql=f"""
WITH {dense_cte()},
{bm25_cte('documents', 'doc_id', 'benchmark', 'item_id')},
_u AS (SELECT query_id, doc_id, rank, 0 AS source_order FROM dense
       UNION ALL SELECT query_id, doc_id, rank, 1 AS source_order FROM hits),
_f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY source_order, rank) AS n FROM _u)
SELECT query_id, doc_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY source_order, rank) AS INTEGER) AS rank,
       CASE WHEN source_order = 0 THEN 'dense' ELSE 'sparse' END AS source
FROM _f WHERE n = 1""")
def q_hybrid_topk(spark, sf):
    t = Tables(spark, sf)
    dense = dense_topk(_query_vectors(t), t.embeddings, k=2, exclude_self=True)
    sparse = answer.sparse_hits(t.benchmark, t.documents)
    return hybrid_merge(dense, sparse)


@register("dense_topk_lsh", ops=("R2",))
def q_dense_topk_lsh(spark, sf):
    """Queries are the benchmark items and every vector with an id divisible by 50."""
    t = Tables(spark, sf)
    more = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    queries = more.unionByName(_query_vectors(t).where("query_id % 50 <> 0"))
    return dense_topk_lsh(queries, t.embeddings, k=2, exclude_self=True)
