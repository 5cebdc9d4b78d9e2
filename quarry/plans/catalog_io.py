"""Registered checks of sources and sinks: rows are written to the shared
folder (or as catalog tables), read back by the library's readers, and
compared with the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.operators import index as I
from quarry.operators.convert import page_blocks
from quarry.plans.catalog_text import _blocks_cte, more_pages
from quarry.plans.registry import Tables, register
from quarry.session import ensure_checkpoint_dir
from quarry.sources import files, sinks


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("files_round_trip", ops=("S1", "K2", "P2"), sql="""
SELECT item_id, source, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest
FROM (SELECT item_id, 'set' || CAST(item_id % 3 AS VARCHAR) AS source, text FROM benchmark)""")
def q_files_round_trip(spark, sf):
    """One text file per item, in a folder per stem (several items share
    one), read back as whole documents."""
    out = _folder(spark, "files")
    b = Tables(spark, sf).benchmark.select(
        "item_id", F.concat(F.lit("set"), (F.col("item_id") % 3).cast("string")).alias("stem"), F.col("text").alias("markdown"))
    sinks.write_markdown(b, out, id_col="item_id")
    text = F.expr("substring(text, 1, length(text) - 1)")          # the writer ends each row with a line end
    return files.read_documents(spark, out).select(
        F.regexp_extract("file_path", r"/item_id=(\d+)/", 1).cast("long").alias("item_id"),
        F.regexp_extract("file_path", r"/stem=([^/]+)/", 1).alias("source"),
        F.length(text).alias("n_chars"), F.md5(text).alias("digest"))


@register("golden_round_trip", ops=("S3",), sql="""
SELECT text AS question, text AS ground_truth, CASE WHEN item_id % 4 = 0 THEN text END AS answer FROM benchmark""")
def q_golden_round_trip(spark, sf):
    out = _folder(spark, "golden")
    files.write_nested_json(Tables(spark, sf).benchmark.select(
        F.col("text").alias("question"), F.col("text").alias("ground_truth"),
        F.expr("case when item_id % 4 = 0 then text end").alias("answer")), out)
    return files.read_golden(spark, out)


@register("nested_json_round_trip", ops=("S7", "K1"), sql=f"""
WITH {_blocks_cte()}
SELECT page_id, 'text/html' AS mimetype, block_pos, kind, text FROM blocks""")
def q_nested_json_round_trip(spark, sf):
    out = _folder(spark, "nested")
    blocks = page_blocks(more_pages(Tables(spark, sf).pages))
    doc = (blocks.groupBy("page_id").agg(F.struct(F.lit("text/html").alias("mimetype")).alias("origin"),
                                         F.array_sort(F.collect_list(F.struct("block_pos", "kind", "text"))).alias("texts")))
    files.write_nested_json(doc, out)
    back = files.read_nested_json(spark, out, doc.schema)
    return back.select("page_id", "origin.mimetype", F.explode("texts").alias("t")).select("page_id", "mimetype", "t.*")


@register("vector_table_round_trip", ops=("K4", "A5", "P9"), sql="""
SELECT 'row' AS what, CAST(e.vec_id AS VARCHAR) AS name, CAST(len(e.embedding) AS VARCHAR) || ' ' || md5(d.text) AS value
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id
UNION ALL SELECT 'column', * FROM (VALUES ('1 chunk_id', 'string'), ('2 text', 'string'), ('3 embedding', 'array<float>'))""")
def q_vector_table_round_trip(spark, sf):
    """Vector table and chunk store from one frame, joined again, and the
    vector table's columns."""
    t, key = Tables(spark, sf), uuid.uuid4().hex
    rows = (t.documents.select("doc_id", "text").join(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id")
            .select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text", "embedding"))
    sinks.write_index(rows, f"quarry_vectors_{key}", f"quarry_store_{key}")
    vectors = spark.read.table(f"quarry_vectors_{key}")
    store = spark.read.table(f"quarry_store_{key}").withColumnRenamed("text", "stored")
    joined = vectors.join(store, "chunk_id").select(
        F.lit("row").alias("what"), F.col("chunk_id").alias("name"),
        F.concat(F.size("embedding").cast("string"), F.lit(" "), F.md5("stored")).alias("value"))
    listing = spark.createDataFrame([("column", f"{i} {n}", k) for i, n, k in I.schema_listing(vectors)], "what string, name string, value string")
    return joined.unionByName(listing)


@register("table_maintenance", ops=("K5", "K6", "K7"), sql="""
SELECT 'loaded' AS step, count(*) AS n FROM labels UNION ALL
SELECT 'reloaded', count(*) FROM labels WHERE quality = 1 UNION ALL
SELECT 'kept when not empty', 0 UNION ALL SELECT 'dropped when empty', 1 UNION ALL
SELECT 'failed drops', 0 UNION ALL SELECT 'left', 0""")
def q_table_maintenance(spark, sf):
    """Clear and load, drop if empty, and drop names that may not exist."""
    labels, name = Tables(spark, sf).labels, f"quarry_labels_{uuid.uuid4().hex}"
    steps = []
    for step, df in (("loaded", labels), ("reloaded", labels.where("quality = 1"))):
        I.replace_table(df, name)
        steps.append((step, spark.read.table(name).count()))
    steps.append(("kept when not empty", int(I.drop_if_empty(spark, name))))
    I.replace_table(labels.where("quality = 7"), name)
    steps.append(("dropped when empty", int(I.drop_if_empty(spark, name))))
    steps.append(("failed drops", len(I.drop_tables(spark, [name, name + "_missing"]))))
    steps.append(("left", int(sinks.table_exists(spark, name))))
    return spark.createDataFrame(steps, "step string, n long")
