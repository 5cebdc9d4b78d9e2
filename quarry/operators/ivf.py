"""Approximate dense top-k by inverted lists (R2).

A coarse quantizer is fitted on a bounded sample; every vector is entered in
the lists of its nearest centroids; a question is scored exactly against the
entries of the lists nearest to it, and against no others. How many lists
there are follows from the number of vectors, how many are probed from a
calibration: the fewest that give the wanted recall on sampled questions,
whose true neighbours are found by one exact scan.

At scale: entries are shuffled once by (list, part of the list), where a part
holds at most ``PART_ROWS`` vectors, so a list that a third of all vectors
fall into is many groups. Questions are sent to the parts of the lists they
probe. Centroids (at most ``MAX_LISTS``) and list sizes are all that the
driver holds. Work for a question is the entries of its lists, a share of the
table that falls as lists grow with the square root of its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieve import TOP_K, _cell_topk, dense_topk, top_k
from quarry.session import stage

MAX_LISTS = 16_384
LISTS_PER_ROOT = 4            # lists for each square root of the number of vectors
SAMPLE_PER_LIST = 32          # vectors that the quantizer is fitted on, for each list
COPIES = 2                    # lists that a vector is entered in
PART_ROWS = 4096
QUESTIONS = 200               # of the calibration
TARGET = 0.95                 # recall that the calibration asks for


@dataclass
class InvertedLists:
    """Centroids (unit rows), the entries (list, id, v), the size of each
    list, and how many lists a question probes."""
    centroids: np.ndarray
    entries: DataFrame
    sizes: dict[int, int]
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def n_lists(vectors: int) -> int:
    return max(1, min(MAX_LISTS, round(LISTS_PER_ROOT * math.sqrt(vectors))))


def usable(df: DataFrame, vec_id: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of ``dim`` finite numbers, not all of them zero."""
    v = F.col("v")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.select(F.col(vec_id).cast("long").alias("id"), F.col(vec_col).alias("v"))
            .where((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)))


def vector_dim(vectors: DataFrame, vec_col: str) -> int:
    first = vectors.select(F.size(vec_col).alias("d")).where("d > 0").limit(1).collect()
    return first[0]["d"] if first else 0


def fit_centroids(vectors: DataFrame, lists: int, seed: int = 17) -> np.ndarray:
    """Spherical k-means on the vectors with the smallest id hashes, at most
    ``SAMPLE_PER_LIST`` for each list."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    chosen = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_PER_LIST * lists)
    sample = stage(chosen.select(F.col("v").cast("array<double>").alias("v")), "ivf-sample")
    model = KMeans(k=lists, seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine",
                   featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    c = np.array(model.clusterCenters(), dtype=np.float64)
    return c / np.linalg.norm(c, axis=1, keepdims=True)


def nearest_lists(v: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` lists nearest to a vector, nearest first."""
    n = min(n, len(centroids))
    c = centroids.astype(np.float32)

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.empty((len(s), n), dtype=np.int32)
            for i in range(0, len(s), 512):
                m = np.stack(s.iloc[i:i + 512].to_numpy()).astype(np.float32)
                sim = m @ c.T
                part = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                order = np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable")
                out[i:i + 512] = np.take_along_axis(part, order, 1)
            yield pd.Series(list(out))
    return near(v)


def _calibrated(vectors: DataFrame, entries: DataFrame, centroids: np.ndarray, k: int, target: float, seed: int) -> int:
    """The fewest lists that hold ``target`` of the sampled questions' true
    neighbours (at most ``QUESTIONS`` times ``k`` rows reach the driver)."""
    asked = stage(vectors.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(QUESTIONS), "ivf-questions")
    true = dense_topk(asked, vectors, k=k, query_id="id", query_vec="v", vec_id="id", vec_col="v", exclude_self=True)
    homes = (entries.select("list", F.col("id").alias("doc_id")).join(F.broadcast(true.select("query_id", "doc_id")), "doc_id")
             .groupBy("query_id", "doc_id").agg(F.collect_set("list").alias("lists")).collect())
    order = {r["id"]: {x: n for n, x in enumerate(r["near"])}
             for r in asked.select("id", nearest_lists(F.col("v"), centroids, len(centroids)).alias("near")).collect()}
    ranks = sorted(min(order[r["query_id"]][x] for x in r["lists"]) for r in homes)
    return ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)] + 1 if ranks else len(centroids)


def build_lists(vectors: DataFrame, vec_id: str = "vec_id", vec_col: str = "embedding", k: int = TOP_K, target: float = TARGET,
                lists: int | None = None, path: str | None = None, seed: int = 17) -> InvertedLists:
    """Fit, enter every usable vector, and calibrate. With ``path`` the index
    is kept there (``open_lists``); else its entries are an intermediate in
    the shared folder. Vectors that are NULL, zero, of another length or hold
    a NULL or a number that is not finite are in no list."""
    v = usable(vectors, vec_id, vec_col, vector_dim(vectors, vec_col))
    n = v.count()
    if n == 0:
        return InvertedLists(np.zeros((1, 1)), stage(v.select(F.lit(0).alias("list"), "id", "v"), "ivf-entries"), {}, 1)
    centroids = fit_centroids(v, lists or n_lists(n), seed)
    entered = v.select(F.explode(nearest_lists(F.col("v"), centroids, COPIES)).alias("list"), "id", "v")
    if path:
        entered.write.mode("overwrite").parquet(f"{path}/entries")
        entries = v.sparkSession.read.parquet(f"{path}/entries")
    else:
        entries = stage(entered, "ivf-entries")
    sizes = {r["list"]: r["n"] for r in entries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = InvertedLists(centroids, entries, sizes, _calibrated(v, entries, centroids, k, target, seed))
    if path:
        spark = v.sparkSession
        rows = [(i, [float(x) for x in c], sizes.get(i, 0), index.probes) for i, c in enumerate(centroids)]
        spark.createDataFrame(rows, "list int, centroid array<double>, entries long, probes int").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/centroids")
    return index


def open_lists(spark: SparkSession, path: str) -> InvertedLists:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()       # one row for each list
    return InvertedLists(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/entries"),
                         {r["list"]: r["entries"] for r in rows if r["entries"]}, rows[0]["probes"])


def dense_topk_ivf(queries: DataFrame, index: InvertedLists, k: int = TOP_K, query_id: str = "query_id", query_vec: str = "embedding",
                   probes: int | None = None, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, rank, doc_id, score: the best ``k`` of the entries of each
    question's nearest lists by exact cosine, ties by doc_id. With as many
    ``probes`` as lists the result is that of the exact search."""
    q = usable(queries, query_id, query_vec, index.dim)
    parts = {x: -(-n // PART_ROWS) for x, n in index.sizes.items()}
    of_list = F.create_map(*[F.lit(x) for kv in parts.items() if kv[1] > 1 for x in kv]) if any(n > 1 for n in parts.values()) else None
    n_parts = F.coalesce(F.element_at(of_list, F.col("list")), F.lit(1)) if of_list is not None else F.lit(1)
    asked = (q.select("id", "v", F.explode_outer(nearest_lists(F.col("v"), index.centroids, probes or index.probes)).alias("list"))
             .select("id", "v", F.col("list").alias("q_list"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("q_part")))
    held = index.entries.select("id", "v", "list", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"))
    best = (asked.groupBy("q_list", "q_part").cogroup(held.groupBy("list", "part"))
            .applyInPandas(lambda a, b: _cell_topk(k, exclude_self)(a, b), "query_id long, doc_id long, score double"))
    best = best.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), digits).alias("score"))
    return (top_k(best, k, "query_id", [F.col("score").desc(), F.col("doc_id")])
            .select("query_id", "rank", "doc_id", "score"))
