"""Exact Jaccard self-join of word-shingle sets by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. A pair of
sets of n and m shingles with Jaccard >= p/q differs in at most
D = (n + m)(q - p)/(q + p) shingles, so when the order is cut into more than
D fragments, the two sets agree in all of at least one. The join

1. collapses equal sets (one representative each, with its weight);
2. cuts every set into the fragments of its size class (and of the next
   class where a partner could be in it) and keys each fragment by a hash
   of its content: documents of a link always share a key, and a key over
   several shingles in hash order is not shared by texts that merely have a
   common passage;
3. groups documents that share keys into candidate components, and takes
   those that do not fit a block apart again: of linked sets of n n-grams the
   rarest n - ceil(n p/q) + 1 (by their number in these components, then by
   hash) have one in common, so only sets that share one of those stay together;
4. inside a component (cut into bins of sizes that can be partners, as wide
   as sends each text least often, and these into blocks, block pairs joined,
   so no group is ever in one task) takes the shingles that at least two members hold, in
   global order, counts the partial overlaps of each fragment of it for all
   pairs of the block separately, sums them per pair and applies the exact
   threshold.

Links leave a task only as counts per document and a spanning forest, never
as pairs. Fragments without shingles say nothing and are keyed only for the
few sets with more empty fragments than the bound leaves room for, so the
join loses no link.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import connected_components, dropped, staged
from quarry.llm.textbytes import U, chunks, mix, shingles, text_buffer

GROWTH = 1.5           # sizes u_i of the classes grow by this factor
BLOCK_ROWS = 1536      # documents of one block inside a component
BLOCK_TOKENS = 1 << 20  # shingles of one block (one set may be larger)
PAIRS = 1 << 20         # co-occurrences counted at a time
ROUNDS = 4              # shares of the block pairs, whose texts are on disk one after another


def differences(u, p: int, q: int):
    """Most shingles in which two linked sets of up to u differ."""
    return 2 * u * (q - p) // (q + p)


def class_tops(limit: int) -> np.ndarray:
    """Largest size of every size class, up to one above ``limit``."""
    tops = [1]
    while tops[-1] <= limit:
        tops.append(max(tops[-1] + 1, int(tops[-1] * GROWTH)))
    return np.array(tops, dtype=np.int64)


_TOPS = class_tops(1 << 40)


def size_bins(p: int, q: int) -> np.ndarray:
    """First sizes of bins such that a set's partners of at least its own
    size lie in its bin or the next one."""
    first = [1]
    while first[-1] <= 1 << 40:
        first.append(first[-1] * q // p + 1)
    return np.array(first, dtype=np.int64)


def fragment_keys(h: np.ndarray, so: np.ndarray, p: int, q: int):
    """(row, key) of the fragments of flat sorted sets ``h`` / ``so``."""
    size = np.diff(so)
    own = np.searchsorted(_TOPS, size)
    far = np.searchsorted(_TOPS, size * q // p)
    rows, keys = [], []
    for step in range(int((far - own).max(initial=0)) + 1):
        sel = np.flatnonzero((size > 0) & (own + step <= far))
        if not len(sel):
            continue
        cls = own[sel] + step
        bound = differences(_TOPS[cls], p, q)
        slack = np.where(bound > 0, 1 + bound // 10, 0)
        k = bound + 1 + slack
        n = size[sel]
        doc = np.repeat(np.arange(len(sel)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(so[sel], n)
        x = h[at]
        frag = ((x >> U(32)) * k[doc].astype(np.uint64)) >> U(32)
        cut = np.ones(len(x), dtype=bool)
        cut[1:] = (doc[1:] != doc[:-1]) | (frag[1:] != frag[:-1])
        c = np.flatnonzero(cut)
        content = np.add.reduceat(mix(x ^ U(0xA0761D6478BD642F)), c)
        tag = cls[doc[c]].astype(np.uint64) * U(1 << 40) + frag[c] + U(1)
        rows.append(sel[doc[c]])
        keys.append(mix(content + mix(tag)))
        filled = np.bincount(doc[c], minlength=len(sel))
        for i in np.flatnonzero(k - filled > slack):
            empty = np.setdiff1d(np.arange(k[i], dtype=np.uint64), frag[c][doc[c] == i])
            rows.append(np.full(len(empty), sel[i]))
            keys.append(mix(mix(U(int(cls[i]) << 40) + empty + U(1))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(keys)


def _signatures(k: int, p: int, q: int):
    """Per document: set size and its bin, 128-bit set identity, fragment keys."""
    bins = size_bins(p, q)

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            for i, j in chunks(off):
                h, so = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], k)
                size = np.diff(so)
                sums = [np.concatenate([[U(0)], np.cumsum(mix(h ^ U(c)))]) for c in (0x13198A2E03707344, 0xA4093822299F31D0)]
                a, z = ((s[so[1:]] - s[so[:-1]]).view(np.int64) for s in sums)
                row, key = fragment_keys(h, so, p, q)
                order = np.argsort(row, kind="stable")
                key = key[order].view(np.int64)
                ko = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=j - i))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array(size), pa.array(np.searchsorted(bins, size, side="right")), pa.array(a), pa.array(z),
                     pa.ListArray.from_arrays(pa.array(ko, pa.int32()), pa.array(key))],
                    ["id", "th", "n", "bin", "a", "z", "keys"])
    return run


def block_overlaps(h: np.ndarray, so: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Overlap sizes of the sets ``left`` with the sets ``right`` (row
    numbers): the n-grams that two or more sets hold, in global order, are
    cut into fragments of ``width``; partial overlaps are counted one
    fragment at a time and summed. Rare n-grams are counted pair by pair,
    frequent ones as a product of incidence matrices."""
    rows = np.repeat(np.arange(len(so) - 1), np.diff(so))
    order = np.argsort(h, kind="stable")
    x, rows = h[order], rows[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    gram = np.cumsum(new) - 1
    df = np.bincount(gram) if len(gram) else np.zeros(0, np.int64)
    start = np.flatnonzero(new)
    pos_l, pos_r = (np.full(len(so) - 1, -1), np.full(len(so) - 1, -1))
    pos_l[left], pos_r[right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for d in np.unique(df[(df >= 2) & (df <= 12)]):
        at = start[df == d]
        for s in range(0, len(at), PAIRS // (d * d)):
            member = rows[at[s:s + PAIRS // (d * d), None] + np.arange(d)]
            i = pos_l[np.repeat(member, d, axis=1)].ravel()
            j = pos_r[np.tile(member, (1, d))].ravel()
            ok = (i >= 0) & (j >= 0)
            out += np.bincount(i[ok] * len(right) + j[ok], minlength=out.size).reshape(out.shape)
    frequent = np.flatnonzero(df > 12)
    if len(frequent):
        code = np.full(len(df), -1)
        code[frequent] = np.arange(len(frequent))
        c = code[gram]
        keep = c >= 0
        c, r = c[keep], rows[keep]                     # c ascends: global order
        bounds = np.searchsorted(c, np.arange(0, len(frequent) + width, width))
        for f, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            a = np.zeros((len(left), width), dtype=np.float32)
            b = np.zeros((len(right), width), dtype=np.float32)
            col, rr = c[s:e] - f * width, r[s:e]
            in_l, in_r = pos_l[rr] >= 0, pos_r[rr] >= 0
            a[pos_l[rr[in_l]], col[in_l]] = 1
            b[pos_r[rr[in_r]], col[in_r]] = 1
            out += (a @ b.T).astype(np.int64)
    return out


def forest(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable row number of each of n rows under the links
    ``link[a, b]`` of rows left[a] and right[b]."""
    label = np.arange(n)
    while True:
        before = label.copy()
        big = np.where(link, label[right][None, :], n).min(axis=1, initial=n)
        np.minimum.at(label, left, big)
        big = np.where(link, label[left][:, None], n).min(axis=0, initial=n)
        np.minimum.at(label, right, big)
        label = label[label]
        if (label == before).all():
            return label


def _heads(batches):
    """Rows sorted by key: every set that shares a key with an earlier one,
    with the first set of that key."""
    last_key = last_head = None
    for b in batches:
        key, sid = b.column("key").to_numpy(), b.column("sid").to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        head = sid[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        if key[0] == last_key:
            head[key == last_key] = last_head
        last_key, last_head = key[-1], head[-1]
        hit = sid != head
        yield pa.RecordBatch.from_arrays([pa.array(sid[hit]), pa.array(head[hit])], ["u", "v"])


def _grams(k: int):
    """(gram, sid) of every n-gram of every set."""
    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            sid = b.column("sid").to_numpy()
            for i, j in chunks(off):
                h, so = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(sid[i:j], np.diff(so)))], ["gram", "sid"])
    return run


def _rejoined(cand: DataFrame, texts: DataFrame, k: int, p: int, q: int) -> DataFrame:
    """``cand`` with the ``large`` components taken apart: sets stay together
    when they share one of their rarest n-grams, as many as cannot all be
    missing from a partner. Sets that share none link with nothing.

    An n-gram of one set is never sent back to it: only their number is
    needed, which is what its other n-grams leave of its size."""
    if texts.where("large").isEmpty():
        return cand
    grams = texts.where("large").mapInArrow(_grams(k), "gram long, sid long")
    often = staged(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared-grams")
    shared = grams.join(often, "gram").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("g"))
    first = f"n - (n * {p} + {q - 1}) div {q} + 1 - (n - size(g))"
    keyed = (shared.join(cand.where("large").select("sid", "n"), "sid").where(f"{first} > 0")
             .select("sid", F.explode(F.expr(f"transform(slice(g, 1, cast({first} as int)), x -> x.gram)")).alias("key")))
    keyed = staged(keyed, "rare-grams")
    pairs = keyed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_heads, "u long, v long")
    comp = connected_components(pairs).select(F.col("id").alias("sid"), F.col("component").alias("comp"))
    apart = cand.where("large").drop("comp").join(comp, "sid").select(cand.columns)
    return staged(cand.where("not large").unionByName(apart), "close-candidates")


def _join_block(h, so, ids, weight, part, same, p, q):
    """One block pair: link counts per set and a spanning forest."""
    left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    if same:
        right = left
    size = np.diff(so)
    inter = block_overlaps(h, so, left, right)
    link = q * inter >= p * (size[left][:, None] + size[right][None, :] - inter)
    if same:
        np.fill_diagonal(link, False)
    n = len(ids)
    links = np.zeros(n, dtype=np.int64)
    np.add.at(links, left, link @ weight[right])
    if not same:
        np.add.at(links, right, weight[left] @ link)
    label = forest(link, left, right, n)
    hit = links > 0
    return ids[hit], ids[label][hit], links[hit]


def _verify(k: int, p: int, q: int):
    """Rows sorted by (component, left block, right block), of a block pair
    after another: shingle sets are built from whole texts once more."""
    def flush(parts, same):
        t = pa.Table.from_batches(parts)
        first = np.unique(t.column("id").to_numpy(), return_index=True)[1]  # repeated rows count once
        t = t.take(np.sort(first)) if len(first) < len(t) else t
        buf, off = text_buffer(t.column("text"))
        flat, bounds = [], [0]
        for i, j in chunks(off):
            h, so = shingles(buf[off[i]:off[j]], off[i:j + 1] - off[i], k)
            flat.append(h)
            bounds.extend((so[1:] + bounds[-1]).tolist())
        h, so = np.concatenate(flat), np.array(bounds)
        ids, w, part = (t.column(c).to_numpy() for c in ("id", "weight", "side"))
        return [pa.array(x) for x in _join_block(h, so, ids, w, part, same, p, q)]

    def run(batches):
        held, key = [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("comp", "bi", "bj")], axis=1)
            if not len(keys):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if key is not None and tuple(keys[s]) != key:
                    yield pa.RecordBatch.from_arrays(flush(held, key[1] == key[2]), ["u", "v", "links"])
                    held = []
                key = tuple(keys[s])
                held.append(b.slice(s, e - s))
        if held:
            yield pa.RecordBatch.from_arrays(flush(held, key[1] == key[2]), ["u", "v", "links"])
    return run


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, n_links, component_id), one row per row
    of ``docs``: documents link when den * |A ∩ B| >= num * |A ∪ B| over their
    sets of distinct k-word shingles.

    Null and empty texts and texts without words have no shingles and link
    with nothing. A null id is its own class with component null and links
    with nothing (there is no id to name its class by). Rows that repeat an
    id are one document when their sets are equal; otherwise each is linked
    and classed by its own set. ``n_links`` counts the other documents (ids)
    linked directly, equal sets included. Other columns are
    ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    sig = staged(named.mapInArrow(_signatures(k, num, den), "id long, th long, n long, bin long, a long, z long, keys array<long>"), "sets")
    sid = F.xxhash64("a", "z", "n").alias("sid")
    # the smallest id of each distinct set stands for it
    reps = staged(sig.where("id is not null and n > 0").groupBy("n", "bin", "a", "z", "id").agg(F.min("th").alias("th"))
                  .groupBy("n", "bin", "a", "z").agg(F.min(F.struct("id", "th")).alias("r"), F.count(F.lit(1)).alias("weight"))
                  .select("n", "bin", "a", "z", sid, F.col("r.id").alias("id"), F.col("r.th").alias("th"), "weight"), "reps")
    keyed = (sig.select("id", "th", "a", "z", "keys").join(reps.select("id", "th", "a", "z", "sid"), ["id", "th", "a", "z"])
             .select("sid", F.explode("keys").alias("key")))
    pairs = (keyed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_heads, "u long, v long"))
    comp = connected_components(pairs).select(F.col("id").alias("sid"), F.col("component").alias("comp"))
    # the keys of the sets were the largest part of their table
    slim = staged(sig.select("id", "th", "n", "a", "z"), "set-names")
    dropped(sig)
    cand = staged(comp.join(reps.select("sid", "id", "th", "weight", "n", "bin"), "sid"), "candidates")
    large = (cand.groupBy("comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
             .select("comp", F.expr(f"c > {BLOCK_ROWS} or t > {BLOCK_TOKENS}").alias("large")))
    cand = staged(cand.join(large, "comp"), "sized-candidates")
    # the same plan at every size: a broadcast of few candidates would flip to a shuffle of all texts
    texts = staged(named.join(cand.select("sid", "id", "th", "large").hint("merge"), ["id", "th"]).dropDuplicates(["id", "th"])
                   .select("sid", "text", "large"), "candidate-texts", "zstd")
    cand = _rejoined(cand, texts, k, num, den)
    # bins merged by twos, fours, ... still hold the partners in the own or the next
    # one: each component takes the level at which its texts are sent least often
    levels = len(size_bins(num, den)).bit_length()
    merged = (cand.groupBy("comp", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
              .withColumn("lev", F.explode(F.sequence(F.lit(0), F.lit(levels))))
              .groupBy("comp", "lev", F.expr("shiftright(bin, lev)").alias("bin")).agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
              .withColumn("nb", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("int")))
    merged = staged(merged, "block-levels")
    sent = F.col("c") * F.sum("nb").over(W.partitionBy("comp", "lev").orderBy("bin").rangeBetween(-1, 1))
    best = (merged.select("comp", "lev", sent.alias("sent")).groupBy("comp", "lev").agg(F.sum("sent").alias("sent"))
            .groupBy("comp").agg(F.min(F.struct("sent", "lev")).alias("b")).select("comp", "b.lev"))
    blocks = staged(merged.join(best, ["comp", "lev"]).select("comp", "lev", "bin", "nb"), "block-counts")
    cand = cand.join(blocks.select("comp", "lev").distinct(), "comp").withColumn("bin", F.expr("shiftright(bin, lev)")).drop("lev")
    blocks = blocks.drop("lev")
    cand = (cand.join(blocks, ["comp", "bin"])
            .join(blocks.select("comp", (F.col("bin") - 1).alias("bin"), F.col("nb").alias("above")), ["comp", "bin"], "left")
            .join(blocks.select("comp", (F.col("bin") + 1).alias("bin"), F.col("nb").alias("below")), ["comp", "bin"], "left"))
    cand = staged(cand.withColumn("blk", F.expr("cast(pmod(sid, nb) as int)")), "blocks")
    joined = texts.join(cand.select("sid", "weight", "comp", "bin", "blk", "nb", "above", "below").hint("merge"), "sid")

    def block(shift: int, n: str) -> str:
        return f"((bin + {shift}) * 4294967296 + {n})"

    def pairs_of(count: str, left: str, right: str, side: str) -> str:
        return (f"transform(filter(sequence(0, greatest(coalesce({count}, 0) - 1, 0)), o -> o < coalesce({count}, 0)),"
                f" o -> named_struct('bi', {left}, 'bj', {right}, 'side', {side}))")
    # blocks of the own bin, and those of the bins that can hold partners
    pair = F.expr("explode(concat(" + ", ".join([
        pairs_of("nb", block(0, "least(blk, o)"), block(0, "greatest(blk, o)"), "if(blk <= o, 0, 1)"),
        pairs_of("above", block(0, "blk"), block(1, "o"), "0"),
        pairs_of("below", block(-1, "o"), block(0, "blk"), "1")]) + "))")
    # a text goes to every block pair it is in; the copies of one share of the pairs are shuffled at a time
    some = staged(joined.select(F.col("sid").alias("id"), "text", "weight", "comp", "bin", "blk", "nb", "above", "below"), "block-texts", "zstd")
    dropped(texts)
    spread = (some.select("id", "text", "weight", "comp", pair.alias("b"))
              .select("id", "text", "weight", "comp", "b.bi", "b.bj", "b.side"))
    shares = []
    for i in range(ROUNDS):
        share = spread.where(F.pmod(F.xxhash64("comp", "bi", "bj"), F.lit(ROUNDS)) == i)
        done = (share.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "side", "id")
                .mapInArrow(_verify(k, num, den), "u long, v long, links long"))
        shares.append(staged(done, "links"))
    dropped(some)
    return _classes(slim, reps, reduce(DataFrame.unionByName, shares))


def _classes(sig: DataFrame, reps: DataFrame, done: DataFrame) -> DataFrame:
    sets = reps.select("sid", "a", "z", "n", F.col("id").alias("rep"), "weight")
    linked = done.groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("links"))
    comp = connected_components(done.select("u", "v"))
    top = (comp.withColumnRenamed("id", "sid").join(sets.select("sid", "rep"), "sid")
           .groupBy("component").agg(F.min("rep").alias("top")))
    place = comp.join(top, "component").select(F.col("id").alias("sid"), "top")
    full = (sets.join(linked, "sid", "left").join(place, "sid", "left")
            .select("a", "z", "n", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("top", "rep").alias("component_id")))
    return (sig.select("id", "th", F.col("n"), "a", "z")
            .join(full, ["n", "a", "z"], "left")
            .select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"),
                    F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
                    F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "id")).alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their class. Rows that
    repeat an id (null included) and a text are one document, of which one
    row stays; other columns are kept, whatever their names."""
    classes = jaccard_classes(docs, k, num, den, id_col, text_col)
    stay = (classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).alias("key")).distinct())
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th")).alias("key"))
    return rows.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def near_groups(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, unit) of the documents that link with another one: the struct of
    id and text hash, and one such struct for all of their class. Null ids
    and texts without words link with nothing."""
    classes = jaccard_classes(docs, k, num, den, id_col, text_col).where("n_links > 0")
    return staged(classes.select(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).alias("key"),
                                 F.struct(F.col("component_id").alias("id"), F.lit(None).cast("long").alias("th")).alias("unit")).distinct(), "near-groups")
