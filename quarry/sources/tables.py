"""Readers for the parquet test tables and for vector / document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


# Keys by which a local run spreads the test tables.
KEYS = {
    "documents": "doc_id", "pages": "page_id", "embeddings": "vec_id",
    "benchmark": "item_id", "conversations": "conv_id", "labels": "doc_id",
    "events": "event_id",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """One parquet table of a scale-factor folder (column pruning and
    filters reach the scan because nothing is materialised here).

    With ``spread``, a table whose files give fewer scan partitions than
    one machine has cores is hash-partitioned by its key; on a cluster this
    never happens.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = KEYS.get(name)
    if spread and key is not None:
        df = ensure_parallelism(df, key)
    return df


def ensure_parallelism(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """On one machine, hash-partition by ``key`` when the scan has fewer
    partitions than cores (a single small file, say); never on a cluster. Deterministic (hash, not round robin), so a lost task is
    recomputed with the same rows, and later joins or aggregations keyed
    by ``key`` reuse the partitioning. No partition count is fixed: AQE
    coalesces the shuffle from its measured size, so a small lookup table
    on a large cluster does not become thousands of empty partitions."""
    try:
        if not df.sparkSession.sparkContext.master.startswith("local["):
            return df                # a cluster reads its tables as they are split
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): keep the scan as is
        return df
    if have < want:
        return df.repartition(key)
    return df


def scan_vectors(spark: SparkSession, source: str, **jdbc_options) -> DataFrame:
    """Vector table scan (S4).

    ``source`` is a catalog table name, a parquet path, or ``jdbc`` with the
    usual ``url``/``dbtable`` options for an external PostgreSQL table.
    """
    if source == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options).load()
    if spark.catalog.tableExists(source):
        return spark.read.table(source)
    return spark.read.parquet(source)
