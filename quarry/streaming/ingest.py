"""Incremental ingest with Structured Streaming (W1, W2).

New files under a folder are read as whole documents, de-duplicated by path
(or content), chunked and enriched (stateless), and embedded inside
``foreachBatch`` (the embedding aggregates, which a streaming append query
cannot do before a sink). Which documents are known is keyed state
(``transformWithState``): a micro-batch looks up its own documents only,
however large the table is, and keys may expire. A query with a fresh
checkpoint takes what the table holds as its initial state, read once.

A micro-batch writes only its own partition, named by the query's id (which
lives in its checkpoint) and the batch number, so a retried batch replaces
its output.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.exprs import basename, decode_file_name
from quarry.operators.embed import EMBED_DIM, embed_input, with_vectors
from quarry.operators.enrich import extractive_context, lead_sentence
from quarry.operators.chunk import page_estimate, token_chunks
from quarry.sources.files import content_key
from quarry.sources.sinks import path_exists

DOCUMENT = "content_key string, file_path string, file_name string, text string, mtime timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                    recursive: bool = True) -> DataFrame:
    """Streaming whole-file documents: file_path, file_name, text, mtime."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.text(path, wholetext=True, recursiveFileLookup=recursive)
    fp = decode_file_name(F.col("_metadata.file_path"))
    return df.select(fp.alias("file_path"), basename(fp).alias("file_name"),
                     F.col("value").alias("text"),
                     F.col("_metadata.file_modification_time").alias("mtime"))


class FirstSeen(StatefulProcessor):
    """Passes the first document of each key: of a micro-batch the one with
    the smallest path, of later ones none until the key has expired."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "file_path string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            best = part.sort_values("file_path", kind="stable").iloc[:1]
            if first is None or best["file_path"].iloc[0] < first["file_path"].iloc[0]:
                first = best
        if first is not None and not self.seen.exists():
            self.seen.update((first["file_path"].iloc[0],))
            yield first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((initialState["file_path"].iloc[0],))

    def close(self) -> None:
        pass


def first_documents(stream: DataFrame, key_col: str = "file_path", ttl_ms: int | None = None,
                    known: DataFrame | None = None) -> DataFrame:
    """Never ingest the same path twice (W2); ``key_col="text"`` for contents.

    The state is a path for each key (a fixed-size hash), kept for ``ttl_ms``
    after it was written, or for good. ``known`` (content_key, file_path)
    are documents that count as seen from the start."""
    stream.sparkSession.conf.set(_STORE, _ROCKSDB)
    if ttl_ms:       # else a run over what is there would go on with empty batches to let keys expire, and never end
        stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    names = [c.split()[0] for c in DOCUMENT.split(", ")]
    keyed = stream.withColumn("content_key", content_key(key_col)).select(*names).groupBy("content_key")
    return keyed.transformWithStateInPandas(
        FirstSeen(ttl_ms), DOCUMENT, "Append", "ProcessingTime" if ttl_ms else "None",
        known.select("content_key", "file_path").groupBy("content_key") if known is not None else None)


def enrich_stream(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Stateless part of the ingest: token chunks, page and context."""
    keep = ("file_name", "_lead") + (("content_key",) if "content_key" in docs.columns else ())
    d = docs.withColumn("doc_id", F.col("file_path")).withColumn("_lead", lead_sentence("text"))
    ch = token_chunks(d, size, overlap, keep=keep)
    return ch.select("doc_id", "chunk_id", "chunk_index", "text", *[c for c in keep if c != "_lead"],
                     page_estimate("chunk_index").alias("page_number"),
                     extractive_context("file_name", "chunk_index", "n_chunks", "_lead").alias("context"))


def embed_batch(batch: DataFrame, dim: int = EMBED_DIM, embed_mode: str = "context+text") -> DataFrame:
    """Vector rows of one micro-batch (chunk columns + embedding); a text
    without terms has the zero vector."""
    rows = batch.withColumn("_embed_text", embed_input("text", F.col("context"), embed_mode))
    return with_vectors(rows, "chunk_id", "_embed_text", dim, joined=True).drop("_embed_text")


def _known(spark: SparkSession, table_path: str) -> DataFrame | None:
    """The documents that the table holds; None when nothing was written."""
    if not path_exists(spark, table_path):
        return None
    runs = [f for f in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .load(table_path).select("path").where(F.contains("path", F.lit("run_id="))).limit(1).collect()]
    if not runs:
        return None
    return spark.read.parquet(table_path).groupBy("content_key").agg(F.min("doc_id").alias("file_path"))


def ingest_documents(docs: DataFrame, table_path: str, checkpoint: str | None = None, dedupe: bool = True,
                     ttl_ms: int | None = None, available_now: bool = True, dim: int = EMBED_DIM, key_col: str = "file_path"):
    """Start the ingest of a stream of documents (file_path, file_name, text,
    mtime) into the table at ``table_path``; returns the StreamingQuery.

    The checkpoint is kept inside the table's own folder (whose readers skip
    names that begin with ``_``) unless one is given, so it is as durable as
    the table and never shared with another one.
    """
    spark = docs.sparkSession
    checkpoint = checkpoint or table_path.rstrip("/") + "/_ingest"
    if dedupe:
        fresh = not path_exists(spark, f"{checkpoint.rstrip('/')}/commits/0")
        docs = first_documents(docs, key_col, ttl_ms, _known(spark, table_path) if fresh else None)
    else:
        docs = docs.withColumn("content_key", content_key(key_col))
    chunks = enrich_stream(docs)
    run, known = [], threading.Event()

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        known.wait()
        batch = batch.persist()          # read and chunked once, used by the embedding and the rows
        try:
            (embed_batch(batch, dim).withColumn("run_id", F.lit(run[0])).withColumn("batch_id", F.lit(epoch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run_id", "batch_id").parquet(table_path))
        finally:
            batch.unpersist()

    writer = chunks.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    query = writer.start()
    run.append(str(query.id))
    known.set()
    return query


def start_ingest(spark: SparkSession, source_dir: str, table_path: str,
                 checkpoint: str | None = None, dedupe: bool = True,
                 ttl_ms: int | None = None, max_files_per_trigger: int | None = None,
                 available_now: bool = True, dim: int = EMBED_DIM, key_col: str = "file_path"):
    """``ingest_documents`` of the files under a folder."""
    return ingest_documents(document_stream(spark, source_dir, max_files_per_trigger), table_path, checkpoint, dedupe, ttl_ms,
                            available_now, dim, key_col)
