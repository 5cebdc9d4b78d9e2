"""Full-text index (postings, document frequencies) and index audits.

The postings table is the Spark form of a text-search index: one row per
(document, term) with the term frequency and the document length. Written
once (``write_text_index``) partitioned by a term hash, BM25 queries read
only the partitions of their terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import terms
from quarry.plans.joins import repeated_ids
from quarry.session import removing_shuffles

TERM_BUCKETS = 64


# R3 -------------------------------------------------------------------------
def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, terms array, doc length) per document; row-local, no shuffle."""
    return (docs.select(F.col(id_col).alias("doc_id"), terms(text_col).alias("terms"))
            .withColumn("doc_len", F.size("terms")))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, doc_len). Partial aggregation happens map side,
    so a frequent term costs one row per (document, term), not per token."""
    dt = doc_terms(docs, id_col, text_col)
    return (dt.select("doc_id", "doc_len", F.explode_outer("terms").alias("term"))
            .where(F.col("term").isNotNull())
            .groupBy("doc_id", "term", "doc_len")
            .agg(F.count(F.lit(1)).alias("tf")))


# R4 -------------------------------------------------------------------------
def doc_freq(posts: DataFrame) -> DataFrame:
    """(term, df, cf): documents containing the term and its total count.

    Grouped by term with map-side partial counts, so a term present in a
    third of all documents is reduced before the shuffle."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                     F.sum("tf").alias("cf"))


def corpus_stats(docs_terms: DataFrame) -> DataFrame:
    """One row: number of documents and their total length in terms (a
    global aggregate with map-side partial sums)."""
    return docs_terms.agg(F.count(F.lit(1)).alias("n_docs"),
                          F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"))


def term_bucket(term, buckets: int = TERM_BUCKETS):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


STATS_BUCKET = -1


def postings_and_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: DataFrame | None = None) -> DataFrame:
    """Postings, and one more row for every document with a NULL term that
    carries its length, so that one pass over the texts gives the corpus
    totals as well, documents without any term included.

    With ``wanted`` (distinct terms, of proven small size) tokens of other
    terms are left out before anything is counted or shuffled."""
    dt = doc_terms(docs, id_col, text_col)
    tokens = dt.select("doc_id", "doc_len", F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"))
    if wanted is not None:
        marked = tokens.join(F.broadcast(wanted.withColumn("_w", F.lit(1))), "term", "left")
        tokens = marked.where("term is null or _w = 1").drop("_w")
    return tokens.groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


#: (term, tf) of the sorted terms ``s``, one for each run
_RUNS = ("transform(array(filter(sequence(0, size(s)), i -> i = size(s) or i = 0 or get(s, i) <> get(s, i - 1))), "
         "b -> transform(slice(b, 1, size(b) - 1), (i, k) -> struct(get(s, i) as term, cast(get(b, k + 1) - i as bigint) as tf)))[0]")
_COUNTED = f"transform(array(array_sort(terms)), s -> {_RUNS})[0]"


def counted_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len, p): the terms of every row with a text, sorted and
    counted inside the row as an array of (term, tf); nothing is shuffled."""
    return doc_terms(docs, id_col, text_col).where("terms is not null").select("doc_id", "doc_len", F.expr(_COUNTED).alias("p"))


def _row_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``postings_and_lengths`` of documents whose ids do not repeat: the
    terms are sorted and counted inside the row, nothing is shuffled."""
    counted = f"concat(array(struct(cast(null as string) as term, 1L as tf)), {_COUNTED})"
    return (doc_terms(docs, id_col, text_col).select("doc_id", "doc_len", F.explode_outer(F.expr(counted)).alias("p"))
            .where("p is not null").select("doc_id", "p.term", "doc_len", "p.tf"))


def write_term_postings(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                        buckets: int = TERM_BUCKETS) -> None:
    """Postings at ``path``, partitioned by term bucket and sorted by term, in
    one pass over the corpus; the length rows are bucket -1. The rebalance
    sizes files from the data: a large bucket (a hot term, the length rows)
    is written by as many tasks as it needs.

    Postings are counted in the rows of the documents; only those of ids that
    repeat (or are NULL) are grouped by a shuffle. The ids are read once more
    for that."""
    docs = docs.select(id_col, text_col)
    again = repeated_ids(docs, id_col)
    alone, some = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    if again is not None:
        alone, some = (alone.join(again, F.col(id_col) == F.col("_again"), "left_anti"),
                       some.unionByName(alone.join(again, F.col(id_col) == F.col("_again"), "left_semi")))
    rows = _row_postings(alone, id_col, text_col).unionByName(postings_and_lengths(some, id_col, text_col))
    with removing_shuffles(docs.sparkSession):
        (rows.withColumn("term_bucket", F.when(F.col("term").isNull(), F.lit(STATS_BUCKET))
                         .otherwise(term_bucket(F.col("term"), buckets)))
         .hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term")
         .write.mode("overwrite").option("compression", "zstd").partitionBy("term_bucket").parquet(path))


def written_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row (n_docs, total_len) from the length rows of written postings."""
    lengths = spark.read.schema("doc_len int, term_bucket int").parquet(path).where(F.col("term_bucket") == STATS_BUCKET)
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("total_len"))


def write_text_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     buckets: int = TERM_BUCKETS) -> None:
    """``<path>/postings`` and ``<path>/stats``, one row."""
    write_term_postings(docs, f"{path}/postings", id_col, text_col, buckets)
    (written_totals(docs.sparkSession, f"{path}/postings").withColumn("buckets", F.lit(buckets))
     .write.mode("overwrite").parquet(f"{path}/stats"))


def read_text_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings with their ``term_bucket``, statistics) of a written index."""
    posts = spark.read.parquet(f"{path}/postings").where(F.col("term_bucket") != STATS_BUCKET)
    return posts, spark.read.parquet(f"{path}/stats")


def of_terms(posts: DataFrame, stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """The postings of a written index in the buckets of the terms
    ``wanted``: a partition filter on at most as many values as the index has
    buckets, so no other file is read."""
    n = stats.first()["buckets"]
    used = [r[0] for r in wanted.select(term_bucket(F.col("term"), n)).distinct().collect()]
    return posts.where(F.col("term_bucket").isin(used) if used else F.lit(False)).drop("term_bucket")


# A1-A3, P9 ------------------------------------------------------------------
def vector_audit(table: DataFrame, vec_col: str = "embedding", expected_dim: int | None = None,
                 context_col: str | None = None, page_col: str | None = None,
                 extra: tuple = ()) -> DataFrame:
    """Counts of the post-load audit in one pass: rows, rows with a vector,
    rows with a context, rows with a page number, wrong dimensions."""
    aggs = [*extra, F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col(vec_col).isNotNull()).alias("with_vector")]
    if expected_dim is not None:
        aggs.append(F.count_if(F.size(vec_col) != expected_dim).alias("bad_dims"))
    if context_col:
        aggs.append(F.count(F.when(F.col(context_col).isNotNull(), 1)).alias("with_context"))
    if page_col:
        aggs.append(F.count(F.when(F.col(page_col).isNotNull(), 1)).alias("with_page"))
    return table.agg(*aggs)


# A5 -------------------------------------------------------------------------
def schema_listing(df: DataFrame) -> list[tuple[int, str, str]]:
    """(ordinal position, column, type) from the schema, no data read."""
    return [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


# A6 -------------------------------------------------------------------------
def sample_row(df: DataFrame, order_by: str, preview_chars: int = 100,
               text_col: str = "text") -> DataFrame:
    """First row by key (a top-1, not a full sort) with a NULL-safe preview."""
    return (df.orderBy(order_by).limit(1)
            .withColumn(text_col, F.when(F.col(text_col).isNotNull(),
                                         F.substring(text_col, 1, preview_chars))))


# K5-K7 ----------------------------------------------------------------------
def drop_tables(spark: SparkSession, names) -> list[str]:
    """DROP TABLE IF EXISTS for each name, continuing past errors."""
    failed = []
    for n in names:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
        except Exception:  # noqa: BLE001 - keep going like the rebuild script
            failed.append(n)
    return failed


def drop_if_empty(spark: SparkSession, name: str) -> bool:
    """Drop a table only when it has no rows."""
    if spark.catalog.tableExists(name) and spark.read.table(name).isEmpty():
        spark.sql(f"DROP TABLE {name}")
        return True
    return False


def replace_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Clear-and-load in one step (overwrite keeps the table name)."""
    df.write.mode("overwrite").format(fmt).saveAsTable(name)
