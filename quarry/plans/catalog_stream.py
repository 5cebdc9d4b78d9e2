"""Registered check of the streaming ingest: the streamed table against the
batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.catalog_text import SENT_SQL
from quarry.plans.registry import Tables, register, scratch
from quarry.plans.sqlparts import token_chunks_cte
from quarry.streaming.ingest import ingest_documents


@register("stream_ingest", ops=("W1", "W2"), sql=f"""
WITH _p AS (SELECT '/in/' || CAST(doc_id AS VARCHAR) || '.md' AS doc_id, source || '.md' AS file_name, text FROM documents),
_d AS (SELECT *, {SENT_SQL.format(t='text')}[1] AS lead FROM _p QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
{token_chunks_cte(src='_d', extra='file_name, lead')},
_nc AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT c.chunk_id, 'Part of ' || c.file_name || ' (chunk ' || CAST(c.chunk_index + 1 AS VARCHAR) || ' of ' || CAST(_nc.n AS VARCHAR) || '). '
         || coalesce(c.lead, '') AS context,
       CAST(greatest(1, (c.chunk_index * 800) // 2000 + 1) AS INTEGER) AS page_number, md5(c.text) AS digest, CAST(64 AS INTEGER) AS dims
FROM chunks c JOIN _nc ON _nc.doc_id = c.doc_id""")
def q_stream_ingest(spark, sf):
    """All documents as a stream, offered by two queries with checkpoints of
    their own: of each content the smallest path is ingested, once."""
    out = scratch(spark, "stream")
    schema = Tables(spark, sf).documents.schema
    for _ in range(2):
        docs = spark.readStream.schema(schema).parquet(f"{sf.rstrip(chr(47))}/documents.parque[t]")  # a pattern: one file or a folder of files
        path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".md"))
        docs = docs.select(path.alias("file_path"), F.concat("source", F.lit(".md")).alias("file_name"), "text", F.lit(None).cast("timestamp").alias("mtime"))
        query = ingest_documents(docs, f"{out}/table", checkpoint=scratch(spark, "stream-checkpoint"), dim=64, key_col="text")
        query.awaitTermination()
    return spark.read.parquet(f"{out}/table").select("chunk_id", "context", "page_number", F.md5("text").alias("digest"),
                                                     F.size("embedding").alias("dims"))
