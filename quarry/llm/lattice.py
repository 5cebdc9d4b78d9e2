"""Near-duplicate vectors by lattice hashing.

Every table projects the vectors by random orthonormal directions into
blocks of 8 dimensions, decodes each block to its nearest E8 lattice point,
and takes the points of its blocks together as one key. One side of the
join also probes the neighbouring cells that lie nearly as close. Vectors
that share a cell are candidates; whatever they are, their cosine is
computed in double precision before they count as linked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected_components, staged
from quarry.llm.jaccard import forest
from quarry.llm.textbytes import U, mix

COSINE, PROBES, MISS = 0.98, 5, 1e-4
SCALE = 4.0
BLOCK_ROWS = 1024


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points (doubled, so integers) of rows of 8 numbers."""
    best, cost = None, None
    for shift in (0.0, 0.5):
        y = x - shift
        f = np.rint(y)
        err = y - f
        odd = (f.sum(axis=1).astype(np.int64) & 1).astype(bool)
        far = np.abs(err).argmax(axis=1)
        rows = np.flatnonzero(odd)
        f[rows, far[rows]] += np.where(err[rows, far[rows]] >= 0, 1.0, -1.0)
        d = ((y - f) ** 2).sum(axis=1)
        p = np.rint(2 * (f + shift)).astype(np.int64)
        if best is None:
            best, cost = p, d
        else:
            better = d < cost
            best[better], cost[better] = p[better], d[better]
    return best


_PAIRS = [(i, j) for i in range(8) for j in range(i + 1, 8)]
_FLIPS = np.zeros((1 + 8 + len(_PAIRS), 8))
for _n, _c in enumerate([(), *((i,) for i in range(8)), *_PAIRS]):
    _FLIPS[_n, list(_c)] = 1


def neighbours(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` nearest E8 points (doubled) of each row, nearest first,
    and their squared distances: roundings of both cosets with up to two
    coordinates rounded the other way."""
    points, dist = [], []
    for shift in (0.0, 0.5):
        y = x - shift
        f = np.rint(y)
        err = y - f
        step = np.where(err >= 0, 1.0, -1.0)
        base = (err ** 2).sum(axis=1)
        extra = 1 - 2 * np.abs(err)                       # cost of rounding one coordinate the other way
        odd = f.sum(axis=1).astype(np.int64) & 1
        flips = _FLIPS.sum(axis=1).astype(np.int64) & 1
        d = base[:, None] + extra @ _FLIPS.T
        d[(odd[:, None] + flips[None, :]) % 2 == 1] = np.inf
        near = np.argpartition(d, min(count, d.shape[1] - 1), axis=1)[:, :count]
        rows = np.arange(len(x))[:, None]
        points.append(np.rint(2 * (f[:, None, :] + shift + step[:, None, :] * _FLIPS[near])).astype(np.int64))
        dist.append(d[rows, near])
    points, dist = np.concatenate(points, axis=1), np.concatenate(dist, axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :count]
    rows = np.arange(len(x))[:, None]
    return points[rows, order], dist[rows, order]


def projections(dim: int, blocks: int, tables: int, seed: int = 8_2401) -> np.ndarray:
    """[table, block, dim, 8]: orthonormal directions, from as many random
    rotations as are needed."""
    rng = np.random.Generator(np.random.PCG64(seed + dim))
    out, pool = [], []
    for _ in range(tables * blocks):
        if not pool:
            q = np.linalg.qr(rng.normal(size=(max(dim, 8), max(dim, 8))))[0][:dim]
            pool = [q[:, i:i + 8] for i in range(0, q.shape[1] - 7, 8)]
        out.append(pool.pop())
    return np.array(out).reshape(tables, blocks, dim, 8)


def cell_size(dim: int, cosine: float, scale: float = SCALE) -> float:
    """Lattice unit: ``scale`` times how far a pair at the threshold lies
    apart in 8 of ``dim`` dimensions."""
    return scale * np.sqrt(2 * (1 - cosine)) * np.sqrt(min(1.0, 8 / dim))


def cells(x: np.ndarray, proj: np.ndarray, unit: float, probes: int, base: np.ndarray):
    """For one table: keys [row, 1 + probes] of unit vectors: the home cell,
    then the nearest combinations with one block's cell changed."""
    near = 6
    pts, gap = zip(*(neighbours(x @ p / unit, near) for p in proj), strict=True)
    code = [_fold(p) for p in pts]                       # [row, near] per block
    gap = np.concatenate([g[:, 1:] - g[:, :1] for g in gap], axis=1)
    home = base.copy()
    for c in code:
        home = mix(home * U(0x9FB21C651E98DF25) + c[:, 0])
    order = np.argsort(gap, axis=1, kind="stable")[:, :probes]
    out = [home]
    rows = np.arange(len(x))
    for t in range(order.shape[1]):
        block, which = order[:, t] // (near - 1), order[:, t] % (near - 1) + 1
        h = base.copy()
        for b, c in enumerate(code):
            h = mix(h * U(0x9FB21C651E98DF25) + c[rows, np.where(block == b, which, 0)])
        out.append(h)
    return np.stack(out, axis=1)


def _fold(points: np.ndarray) -> np.ndarray:
    h = np.zeros(points.shape[:-1], dtype=np.uint64)
    for i in range(8):
        h = mix(h * U(0xD6E8FEB86659FD93) + points[..., i].astype(np.int64).view(np.uint64) + U(0x9E3779B97F4A7C15))
    return h


def tables_needed(dim: int, cosine: float, blocks: int, probes: int, miss: float) -> int:
    """Tables after which a pair at the threshold is missed with at most the
    probability ``miss``: the rate of one table is simulated."""
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    if dim > 1:
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine ** 2) * y
    zero = np.zeros(len(x), dtype=np.uint64)
    proj, unit = projections(dim, blocks, 1, seed=17)[0], cell_size(dim, cosine)
    rate = float((cells(x, proj, unit, probes, zero) == cells(y, proj, unit, 0, zero)).any(axis=1).mean())
    return int(np.ceil(np.log(miss) / np.log(max(1e-9, 1 - min(rate, 0.999)))))


def blocks_needed(rows: int) -> int:
    """Blocks of a key: grows with the logarithm of the largest class, so
    that chance neighbours of a vector stay few at every size."""
    return max(2, int(np.ceil(np.log(60 * max(rows, 1)) / np.log(100))))


def _unit(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _same_length(batch, column: str):
    """Rows of a batch by the length of their vectors."""
    size = np.diff(np.asarray(batch.column(column).offsets))
    for n in np.unique(size):
        yield int(n), batch.take(pa.array(np.flatnonzero(size == n)))


def _keys(cosine: float, blocks: int, probes: int, miss: float):
    def run(batches):
        plans: dict = {}
        for b in batches:
            for dim, part in _same_length(b, "v"):
                if dim not in plans:
                    plans[dim] = projections(dim, blocks, tables_needed(dim, cosine, blocks, probes, miss))
                for i in range(0, part.num_rows, 2000):
                    some = part.slice(i, 2000)
                    x, sid = _unit(some.column("v")), some.column("sid").to_numpy()
                    label = some.column("class").to_numpy().view(np.uint64)
                    for t, proj in enumerate(plans[dim]):
                        base = mix(mix(label + U(dim)) + U((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                        k = cells(x, proj, cell_size(dim, cosine), probes, base)
                        home = np.zeros(k.shape, dtype=bool)
                        home[:, 0] = True
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(sid, k.shape[1])), pa.array(k.ravel().view(np.int64)), pa.array(home.ravel())],
                            ["sid", "key", "home"])
    return run


def _close(loose: float, near: float):
    """Candidate edges whose vectors are at least loosely alike, and whether
    they are near."""
    def run(batches):
        for b in batches:
            for _, part in _same_length(b, "x"):
                c = (_unit(part.column("x")) * _unit(part.column("y"))).sum(axis=1)
                out = pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), pa.array(c >= near)], ["u", "v", "near"])
                yield out.filter(pa.array(c >= loose))
    return run


def _verify(cosine: float):
    """Rows sorted by (component, left block, right block): all cosines of a
    block pair; link counts per vector and a spanning forest leave."""
    def flush(parts, same):
        t = pa.Table.from_batches(parts).combine_chunks()
        x = _unit(t.column("x").chunk(0))
        ids, w, side = (t.column(c).to_numpy() for c in ("sid", "weight", "side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = left if same else right
        link = x[left] @ x[right].T >= cosine
        if same:
            np.fill_diagonal(link, False)
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, left, link @ w[right])
        if not same:
            np.add.at(links, right, w[left] @ link)
        label = forest(link, left, right, len(ids))
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label][hit]), pa.array(links[hit])], ["u", "v", "links"])

    def run(batches):
        held, key = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "bi", "bj")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if key is not None and tuple(keys[s]) != key:
                    yield flush(held, key[1] == key[2])
                    held = []
                key = tuple(keys[s])
                held.append(b.slice(s, e - s))
        if held:
            yield flush(held, key[1] == key[2])
    return run


def _block_links(members: DataFrame, cosine: float, name: str) -> DataFrame:
    """(u, v, links) of ``members`` (sid, weight, x, comp): all cosines inside
    a group, computed by pairs of blocks."""
    size = members.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("nb"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1),
                                 lambda o: F.struct(F.least("blk", o).alias("bi"), F.greatest("blk", o).alias("bj"))))
    spread = (members.join(size, "comp").withColumn("blk", F.expr("cast(pmod(xxhash64(sid), nb) as int)"))
              .select("sid", "weight", "x", "comp", "blk", pair.alias("b"))
              .select("sid", "weight", "x", "comp", "b.bi", "b.bj", F.expr("if(blk = b.bi, 0, 1)").alias("side")))
    return staged(spread.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "side", "sid")
                  .mapInArrow(_verify(cosine), "u long, v long, links long"), name)


def vector_classes(vecs: DataFrame, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id), one row for each row of ``vecs``:
    vectors of equal label and length link when their cosine, in double
    precision, is at least ``cosine``.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and
    rows with a null label or id, link with nothing (a null id has a null
    component). Rows that repeat an id, a label and a vector are one vector;
    equal vectors are linked and compared once. Other columns are ignored,
    an empty table gives no rows.

    A pair exactly at the threshold is missed with a probability of at most
    ``miss``, closer pairs with far less. Members of a cell are linked to the
    cell's first vector where they are loosely alike. Members so near to it
    that whatever links with them is linked to it too are done; the others of
    the cell are compared with each other, so every pair of a cell is met
    whatever its first vector is. Cells and the groups found so are cut into
    blocks, and all cosines inside are computed block by block, so the counts
    of a group of any size are whole and no group is ever in one task.
    """
    fine = F.expr("v is not null and id is not null and label is not null and size(v) > 0 and not exists(v, e -> e is null or isnan(e)"
                  " or abs(e) = double('infinity')) and exists(v, e -> e <> 0)")
    rows = (vecs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v")).withColumn("fine", fine)
            .select("id", "label", "v", *[F.when(F.col("fine"), F.xxhash64(F.lit(i), "label", "v")).alias(c) for i, c in enumerate("az")]))
    valid = rows.where("a is not null")
    reps = staged(valid.groupBy("a", "z", "id").agg(F.first("label").alias("label"), F.first("v").alias("v"))
                  .groupBy("a", "z").agg(F.min(F.struct("id", "label", "v")).alias("r"), F.count(F.lit(1)).alias("weight"))
                  .select("a", "z", "weight", F.col("r.id").alias("id"), F.xxhash64("r.label").alias("class"), F.col("r.v").alias("v"),
                          F.monotonically_increasing_id().alias("sid")), "vectors")
    largest = reps.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    keys = staged(reps.select("sid", "class", "v").mapInArrow(_keys(cosine, blocks_needed(largest), probes, miss),
                                                              "sid long, key long, home boolean"), "cells")
    heads = (keys.groupBy("key").agg(F.min(F.expr("if(home, sid, null)")).alias("head"), F.min("sid").alias("low"), F.max("sid").alias("high"))
             .where("head is not null and low <> high").select("key", "head"))
    met = keys.join(heads, "key").where("sid <> head").select("key", "sid", "home", F.greatest("sid", "head").alias("u"), F.least("sid", "head").alias("v"))
    # within a group around one vector members lie up to two links apart
    loose = max(-1.0, 1 - 5 * (1 - cosine))
    near = float(np.cos(np.arccos(loose) - np.arccos(cosine))) + 1e-9
    edges = staged(met.select("u", "v").distinct().join(reps.select(F.col("sid").alias("u"), F.col("v").alias("x")), "u")
                   .join(reps.select(F.col("sid").alias("v"), F.col("v").alias("y")), "v")
                   .select("u", "v", "x", "y").mapInArrow(_close(loose, near), "u long, v long, near boolean"), "head-links")
    left = staged(met.join(edges.where("near"), ["u", "v"], "left_anti").select("key", "sid", "home"), "cells-left")
    again = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).where("home and n > 1").select("key")
    rest = (left.join(again, "key").join(reps.select("sid", F.col("v").alias("x")), "sid")
            .select("sid", F.lit(1).cast("long").alias("weight"), "x", F.col("key").alias("comp")))
    edges = edges.select("u", "v").unionByName(_block_links(rest, cosine, "cell-links").select("u", "v"))
    comp = connected_components(edges).select(F.col("id").alias("sid"), F.col("component").alias("comp"))
    done = _block_links(comp.join(reps.select("sid", "weight", F.col("v").alias("x")), "sid"), cosine, "vector-links")
    linked = done.groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("links"))
    place = connected_components(done.select("u", "v")).withColumnRenamed("id", "sid")
    top = place.join(reps.select("sid", "id"), "sid").groupBy("component").agg(F.min("id").alias("top"))
    place = place.join(top, "component").select("sid", "top")
    full = (reps.select("a", "z", "sid", "id", "weight").join(linked, "sid", "left").join(place, "sid", "left")
            .select("a", "z", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("top", "id").alias("class_id")))
    return (rows.select("id", "a", "z").join(full, ["a", "z"], "left")
            .select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("class_id", "id").alias("component_id")))
