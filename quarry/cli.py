"""Command-line jobs: ingest a folder, answer questions, evaluate a golden
set. Each is one Spark application (``spark-submit -m``-style or
``python -m quarry.cli``); the session comes from the cluster config.

    python -m quarry.cli ingest   --input DOCS_DIR --index INDEX_DIR
    python -m quarry.cli ask      --index INDEX_DIR --question "..." [--question ...]
    python -m quarry.cli evaluate --index INDEX_DIR --golden golden.jsonl
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session(master: str | None) -> SparkSession:
    from quarry.session import get_spark
    return get_spark(master, app="quarry-cli")


def ingest(spark: SparkSession, input_dir: str, index_dir: str, dedupe: bool = False) -> dict:
    """Whole files (Markdown) -> sections -> chunks with context and page ->
    one text index and one vector table over context and text, under ``index_dir``. Every file is a document of its own; ``dedupe`` keeps
    the first of files with one content."""
    from quarry.plans import index_store
    from quarry.sources.files import dedup_keep_first, read_documents
    docs = read_documents(spark, input_dir).withColumn("source", F.col("file_name"))
    if dedupe:
        docs = dedup_keep_first(docs, "text", "doc_id")
    index_store.build(docs, index_dir, dim=768, contextual=True)
    chunks, _, stats = index_store.open_index(spark, index_dir)
    row = stats.first()            # the text index is over chunks
    return {"documents": chunks.select("doc_id").distinct().count(),
            "chunks": row["n_docs"], "terms": row["total_len"]}


def questions_frame(spark: SparkSession, questions: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "query_id long, text string")


def ask(spark: SparkSession, index_dir: str, questions: DataFrame, k: int = 2,
        hybrid: bool = True) -> DataFrame:
    """query_id, context (the formatted retrieval context; dense + sparse
    hits merged, as the original tool does, unless ``hybrid`` is off)."""
    from quarry.operators.retrieve import normalize_query
    from quarry.plans import index_store
    text, status = normalize_query("text")
    q = questions.select("query_id", text.alias("text"), status.alias("status"))
    ok = q.where(F.col("status") == "ok").select("query_id", "text")
    answered = index_store.answer(spark, index_dir, ok, k=k, hybrid=hybrid)
    rejected = q.where(F.col("status") != "ok").select("query_id", F.col("status").alias("context"))
    return answered.unionByName(rejected)


def evaluate(spark: SparkSession, index_dir: str, golden_path: str, k: int = 2) -> DataFrame:
    """metric, value, n of the four metrics over the golden set: contexts
    are retrieved from the index, answers are the golden file's ``answer``
    column (rows without one do not count for faithfulness and relevancy; a
    retrieved context is never scored as an answer against itself)."""
    from quarry.operators import evaluate as V
    from quarry.plans import index_store
    from quarry.plans.evaluation import _long
    from quarry.sources.files import read_golden
    from quarry.session import stage
    g = stage(read_golden(spark, golden_path).withColumn("query_id", F.monotonically_increasing_id()), "golden")
    h = index_store.hits(spark, index_dir, g.select("query_id", F.col("question").alias("text")), k=k)
    rec = V.eval_records(g.select("query_id", "question", "ground_truth"), h)
    m = rec.drop("answer").join(g.select("query_id", "answer"), "query_id").select(
        V.faithfulness("answer", F.array_join("contexts", " ")).alias("faithfulness"),
        V.context_recall("ground_truth", F.array_join("contexts", " ")).alias("context_recall"),
        V.context_precision("ground_truth", F.col("contexts")).alias("context_precision"))
    rel = V.answer_relevancy(g.where("answer is not null"), ["query_id"])
    return _long(m, ["faithfulness", "context_recall", "context_precision"]).unionByName(_long(rel, ["answer_relevancy"]))


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quarry")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--input", required=True)
    a.add_argument("--index", required=True)
    a.add_argument("--dedupe-content", action="store_true", help="keep the first of files with equal texts")
    b = sub.add_parser("ask")
    b.add_argument("--index", required=True)
    b.add_argument("--question", action="append", required=True)
    b.add_argument("--k", type=int, default=2)
    b.add_argument("--sparse-only", action="store_true")
    c = sub.add_parser("evaluate")
    c.add_argument("--index", required=True)
    c.add_argument("--golden", required=True)
    args = ap.parse_args(argv)
    spark = _session(args.master)
    if args.cmd == "ingest":
        print(json.dumps(ingest(spark, args.input, args.index, args.dedupe_content)))
    elif args.cmd == "ask":
        # a handful of questions: their answers are printed on the driver
        for r in ask(spark, args.index, questions_frame(spark, args.question), args.k,
                     hybrid=not args.sparse_only) \
                .orderBy("query_id").collect():
            print(f"### {args.question[r.query_id]}\n{r.context}\n")
    else:
        for r in evaluate(spark, args.index, args.golden).collect():
            print(f"{r.metric}: {r.value} (n={r.n})")
    return 0


if __name__ == "__main__":
    sys.exit(main())
