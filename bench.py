"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query runs to completion through the ``noop`` sink (every row is
computed, nothing is collected to the driver). A small warm-up on sf0.001
runs first so that JIT start-up is not billed to the first query; then
every query (construction included) runs ``BENCH_REPS`` times (default 2)
and the fastest run is reported, since single runs on a shared VM vary by
tens of percent. ``queries_first`` holds the first (cold) runs. Index
builds are their own entries; the indexed queries read what they wrote.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = "/root/testdata/sf0.001"


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from quarry.operators import chunk as C
    from quarry.operators import index as I
    from quarry.operators.convert import page_blocks
    from quarry.operators.embed import hash_embed_sparse
    from quarry.operators.retrieve import bm25_topk, dense_topk, dense_topk_lsh
    from quarry.plans import answer
    from quarry.plans.catalog_text import markdown_docs
    from quarry.plans.evaluation import summary
    from quarry.plans.ingest import contextual_index
    from quarry.plans.registry import Tables, load_all
    from quarry.session import get_spark

    spark = get_spark(f"local[{CPUS}]", app="quarry-bench", shuffle_partitions=int(CPUS) * 2,
                      extra={"spark.driver.memory": "16g"})
    checks = load_all()
    from quarry.plans import index_store
    from quarry.session import ensure_checkpoint_dir
    import uuid
    scratch = os.path.join(ensure_checkpoint_dir(spark), "bench-" + uuid.uuid4().hex)

    # warm-up (not timed)
    for name in ("token_chunks", "sparse_topk", "dense_topk", "page_blocks"):
        run(checks[name].fn(spark, WARM_DIR))

    t = Tables(spark, SF_DIR)
    qv = (t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
          .select(F.col("vec_id").alias("query_id"), "embedding"))
    bench_q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    postings_path = os.path.join(scratch, "postings")
    store_path = os.path.join(scratch, "store")

    def build_index():
        I.write_text_index(t.documents, postings_path)

    def bm25_indexed():
        posts, stats = I.read_text_index(spark, postings_path)
        run(bm25_topk(bench_q, t.documents, posts=posts, stats=stats))

    plan = {
        "token_chunks": lambda: run(C.token_chunks(t.documents)),
        "index_build": build_index,
        "sparse_topk_indexed": bm25_indexed,
        "sparse_topk": lambda: run(answer.sparse_hits(t.benchmark, t.documents)),
        "format_context": lambda: run(answer.retrieve_context(bench_q, t.documents)),
        "chunk_index_build": lambda: index_store.build(t.documents, store_path, dim=768),
        "format_context_indexed": lambda: run(index_store.answer(spark, store_path, bench_q)),
        "hybrid_context_indexed": lambda: run(index_store.answer(spark, store_path, bench_q, hybrid=True)),
        "dense_topk": lambda: run(dense_topk(qv, t.embeddings, k=2, exclude_self=True)),
        "dense_topk_lsh": lambda: run(dense_topk_lsh(qv, t.embeddings, k=2, exclude_self=True)),
        "hash_embed_docs": lambda: run(hash_embed_sparse(t.documents, "doc_id")),
        "page_blocks": lambda: run(page_blocks(t.pages)),
        "md_sections": lambda: run(C.markdown_sections(markdown_docs(t.documents))),
        "sentence_chunks": lambda: run(C.sentence_chunks(t.documents)),
        "ingest_chain": lambda: run(contextual_index(markdown_docs(t.documents))),
        "eval_summary": lambda: run(summary(t)),
    }
    only = os.environ.get("BENCH_ONLY")
    if only:
        plan = {k: v for k, v in plan.items() if re.fullmatch(only, k)}
    reps = max(1, int(os.environ.get("BENCH_REPS", "2")))
    times, first = {}, {}
    for name, fn in plan.items():
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn()
            runs.append(round(time.perf_counter() - t0, 3))
        first[name], times[name] = runs[0], min(runs)
        print(f"# {name}: {runs}s", file=sys.stderr, flush=True)
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else SF_DIR,
                      "cpus": int(CPUS), "reps": reps, "queries_first": first}))
    spark.stop()


if __name__ == "__main__":
    main()
