"""File sources: whole-document scans, suffix-filtered listings, JSONL and
nested JSON reads, path resolution, and keep-first de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import basename, decode_file_name


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# S1 -------------------------------------------------------------------------
def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per file: doc_id (= decoded path), file_path, file_name, text.

    ``wholetext`` must be passed as a keyword: ``option("wholetext", ...)``
    is overridden by the keyword default of ``text()``.
    """
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive)
    fp = decode_file_name(F.col("_metadata.file_path"))
    return df.select(fp.alias("file_path"), basename(fp).alias("file_name"),
                     F.col("value").alias("text")).withColumn("doc_id", F.col("file_path"))


# S2 -------------------------------------------------------------------------
def has_suffix(path, suffixes=(".pdf", ".docx"), case_sensitive: bool = False) -> Column:
    p = _c(path) if case_sensitive else F.lower(_c(path))
    sfx = [s if case_sensitive else s.lower() for s in suffixes]
    cond = F.lit(False)
    for s in sfx:
        cond = cond | p.endswith(s)
    return cond


def list_files(spark: SparkSession, path: str, suffixes=(".pdf", ".docx"),
               recursive: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Regular files under ``path`` with one of ``suffixes``: path,
    modificationTime, length. File bytes are not read (``content`` is
    pruned from the binaryFile scan)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(path).select("path", "modificationTime", "length"))
    return df.where(has_suffix("path", suffixes, case_sensitive))


# S3 -------------------------------------------------------------------------
GOLDEN_SCHEMA = T.StructType([T.StructField("question", T.StringType()),
                              T.StructField("ground_truth", T.StringType()),
                              T.StructField("answer", T.StringType())])   # the answer to score, where there is one


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN_SCHEMA).json(path)


# S5 -------------------------------------------------------------------------
def pick_table(spark: SparkSession, preferred: str, fallback: str) -> DataFrame:
    """The preferred (contextual) table when it exists, else the regular one."""
    name = preferred if spark.catalog.tableExists(preferred) else fallback
    return spark.read.table(name)


def prefer_rows(regular: DataFrame, preferred: DataFrame, key: str, cols: list[str],
                defaults: dict | None = None) -> DataFrame:
    """Row-level fallback: every regular row, with the preferred value of
    each column when the preferred table has the key."""
    defaults = defaults or {}
    p = preferred.select(key, *[F.col(c).alias(f"_p_{c}") for c in cols]) \
        .withColumn("_hit", F.lit(True))
    j = regular.join(p, key, "left")
    out = [F.coalesce(F.col(f"_p_{c}"), F.lit(defaults.get(c))).alias(c) for c in cols]
    return j.select(*[F.col(c) for c in regular.columns if c not in cols], *out,
                    F.when(F.col("_hit"), F.lit("preferred")).otherwise(F.lit("regular"))
                    .alias("origin"))


# S6 -------------------------------------------------------------------------
PATH_KEYS = ("file_path", "filepath", "path", "source", "filename", "file_name")


def resolve_paths(meta: DataFrame, listing: DataFrame, input_dir: str,
                  id_col: str = "doc_id", meta_col: str = "metadata",
                  keys=PATH_KEYS) -> DataFrame:
    """First metadata key (in ``keys`` order) whose value names an existing
    file; relative values are put under ``input_dir``; the document id is
    the last resort. ``listing(path)`` is the set of existing files.

    Output: id, path (NULL when nothing exists), key. Existence is a
    semi-join with the listing, the first hit is ``min(priority)`` per id:
    all keyed by id or path, no hot group.
    """
    prio = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    cand = meta.select(F.col(id_col), F.explode(F.col(meta_col)).alias("key", "value"))
    cand = cand.where(F.length("value") > 0).withColumn("priority", prio[F.col("key")]) \
        .where(F.col("priority").isNotNull())
    last = meta.select(F.col(id_col), F.lit("doc_id").alias("key"),
                       F.col(id_col).cast("string").alias("value"),
                       F.lit(len(keys)).alias("priority"))
    cand = cand.unionByName(last)
    root = input_dir.rstrip("/") + "/"
    cand = cand.withColumn("path", F.when(F.col("value").startswith("/"), F.col("value"))
                           .otherwise(F.concat(F.lit(root), F.col("value"))))
    # many documents may name the same file (a third of them, say): the
    # listing is broadcast when its size is proven small, else the
    # candidates are salted so one hot path spreads over many tasks
    from quarry.plans.joins import join_small
    found = join_small(cand, listing.select("path").distinct(), ["path"], how="left_semi")
    best = (found.groupBy(id_col)
            .agg(F.min_by(F.struct("path", "key"), F.col("priority")).alias("_b")))
    return (meta.select(id_col).join(best, id_col, "left")
            .select(id_col, F.col("_b.path").alias("path"), F.col("_b.key").alias("key")))


def paths_or_listing(resolved: DataFrame, listing: DataFrame) -> DataFrame:
    """Resolved paths, or the whole directory listing when no document
    resolved at all (the emptiness test is a bounded ``isEmpty`` job)."""
    hits = resolved.where(F.col("path").isNotNull()).select("path")
    return listing.select("path") if hits.isEmpty() else hits


# S7 / K1 --------------------------------------------------------------------
def read_nested_json(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     multi_line: bool = False) -> DataFrame:
    """Nested JSON documents. ``multi_line`` for one pretty-printed document
    per file (a converted document); JSON Lines (what ``write_nested_json``
    writes) otherwise. Pass the schema: inference reads all data twice."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def write_nested_json(df: DataFrame, path: str) -> None:
    """Nested rows as JSON; UTF-8, non-ASCII kept as is."""
    df.write.mode("overwrite").json(path)


# R13 / A7 -------------------------------------------------------------------
def content_key(c) -> Column:
    """Fixed-size key of a (possibly large) value, so grouping by content
    never shuffles whole texts; NULL for NULL."""
    return F.sha2(_c(c).cast("string"), 256)


def row_key(c, order_col: str) -> Column:
    """``content_key``, or a key of the row's own where there is no content:
    unknown contents are not copies of each other."""
    return F.coalesce(content_key(c), F.concat(F.lit("row "), F.col(order_col).cast("string")))


def dedup_keep_first(df: DataFrame, key, order_col: str) -> DataFrame:
    """Keep the first row (lowest ``order_col``) of each key.

    ``min`` per key is a partial aggregate (a key holding a third of the
    rows is reduced map side), and the rows are then picked by a join on
    the unique ``order_col``. ``dropDuplicates`` does not promise which
    row stays; this does."""
    firsts = (df.select(row_key(key, order_col).alias("_k"), F.col(order_col))
              .groupBy("_k").agg(F.min(order_col).alias(order_col)))
    return df.join(firsts.select(order_col), order_col, "left_semi")


def duplicate_counts(df: DataFrame, key, order_col: str) -> DataFrame:
    """Per duplicated key: the first row's id and how many later rows
    repeat it."""
    return (df.select(row_key(key, order_col).alias("_k"), F.col(order_col))
            .groupBy("_k").agg(F.min(order_col).alias("first_id"),
                               (F.count(F.lit(1)) - 1).alias("n_removed"))
            .where(F.col("n_removed") > 0).drop("_k"))


def duplicate_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("n_removed"), F.lit(0)).alias("total_removed"),
                      F.count(F.lit(1)).alias("keys_with_duplicates"))
