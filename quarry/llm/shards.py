"""Balanced contiguous shards by global byte-size prefix sums.

Every document gets a size; the sizes are summed per range partition, the
partition totals (one number each) are prefix-summed, and each document's
global start is its partition's offset plus a running sum inside the
partition. The total is cut at equal targets, so shard s holds the
documents whose midpoint lies in [s, s + 1) * total / shards: contiguous in
document order, each within one document of the target size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import offsets, ordered

ROW_BYTES = 16


def byte_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                row_bytes: int = ROW_BYTES, partitions: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    Documents are in order of id, then size, then checksum; null ids come
    last, repeated rows keep one slot each, null texts are empty (size
    ``row_bytes``, checksum 0). An empty table gives no rows. Other columns
    are ignored, whatever their names. Only ids, sizes and checksums are
    shuffled, never texts; the rows of one range partition are sorted, and
    nothing larger than one total per partition (and shard) leaves a task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = ordered(narrow, ["doc_id", "size", "text_crc32"], "shard-order", partitions)
    start = offsets(rows, [], F.col("size"), "before")
    grand = rows.agg(F.sum("size")).first()[0] or 1
    # one row per partition (and shard): bounded, so broadcasting is safe
    inside = W.partitionBy("part").orderBy(*[F.col(c).asc_nulls_last() for c in ("doc_id", "size", "text_crc32")])
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (rows.join(F.broadcast(start), "part")
              .withColumn("start", F.col("before") + F.sum("size").over(running) - F.col("size"))
              .withColumn("mid", (F.col("start") * 2 + F.col("size")).cast("decimal(38,0)") * shards)
              .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(mid div {2 * grand} as int)"))))
    first = offsets(placed, ["shard"], F.lit(1), "slots_before")
    in_shard = W.partitionBy("part", "shard").orderBy("start", "size")
    return (placed.join(F.broadcast(first), ["part", "shard"])
            .withColumn("slot", F.col("slots_before") + F.row_number().over(in_shard) - 1)
            .select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")))
