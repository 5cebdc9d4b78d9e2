"""Helpers shared by the operators: staged tables in the shared folder,
connected components, and one total order with prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.session import ensure_checkpoint_dir, removing_shuffles, ship_package, unstage


def prepare(spark: SparkSession) -> None:
    """Workers import the package from a shipped zip; intermediates go to
    the folder in ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once under the shared folder and read it back: a lost
    executor re-reads files instead of recomputing the stage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with removing_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, key: str, values: tuple, name: str, codec: str = "snappy") -> list[DataFrame]:
    """``staged`` in one pass, as one table for each value of ``key``."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with removing_shuffles(spark):
        df.write.option("compression", codec).partitionBy(key).parquet(path)
    rest, there = df.drop(key), {r[0] for r in df.sparkSession.read.schema(df.schema).parquet(path).select(key).distinct().collect()}
    return [spark.read.schema(rest.schema).parquet(f"{path}/{key}={v}") if v in there else spark.createDataFrame([], rest.schema) for v in values]


#: Delete the files of a staged table that nothing reads any more.
dropped = unstage


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``staged`` with one bucket for each shuffle partition of ``key``: joins
    on the key read it without a shuffle. Rows are dealt by the key before,
    so a task writes one bucket, not a file for every bucket."""
    spark = df.sparkSession
    n, table_name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    with removing_shuffles(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", shared_path(spark, name)).saveAsTable(table_name)
    return spark.table(table_name)


def _edges(df: DataFrame) -> tuple[DataFrame, tuple]:
    """``staged`` links and their count and hash sum, observed by the write."""
    seen = Observation()
    noted = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
    out = staged(noted, "cc")
    return out, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (id, component) with the smallest id of each component.

    Large-star / small-star rounds: every round links each node's larger
    neighbours, then its smaller ones, to the smallest neighbour, until the
    forest is flat (logarithmically many rounds). A round is aggregations
    (combined map-side) and equi-joins, with repeated links removed once, so one hub with most of the links
    is an aggregation key and a splittable join key, never one group in
    one task. Each round is cut with a table in the shared folder. Only
    nodes that occur in a link come back; nulls link with nothing.
    """
    def canon(df, a, b):
        return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))

    e = canon(edges.where("u is not null and v is not null and u <> v"), F.col("u"), F.col("v")).distinct()
    e, seen = _edges(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u <> v").distinct())
        old = e
        e, now = _edges(small)
        dropped(old)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def ordered(df: DataFrame, keys: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, staged, with the
    partition number ``part``: partition p holds only keys up to those of
    p + 1, so global running values are a partition's offset plus a sum
    inside the partition."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = (df.repartitionByRange(n, *[F.col(k).asc_nulls_last() for k in keys])
           .sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys])
           .withColumn("part", F.spark_partition_id()))
    return staged(out, name)


def offsets(df: DataFrame, by: list[str], value, name: str) -> DataFrame:
    """Exclusive prefix sums of per-partition totals (at most a few rows
    for each partition, whatever the table's size) over ``part`` within
    the groups ``by``."""
    totals = df.groupBy("part", *by).agg(F.sum(value).alias("total"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return totals.select("part", *by, (F.sum("total").over(
        w.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("total")).alias(name))
