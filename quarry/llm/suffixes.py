"""Removal of byte strings that also start earlier, by a hash-compared suffix
sort.

Every string of ``span`` bytes contains an anchor: the position of its least
``gram``-byte hash. Equal strings have the same anchor at the same place, so
only anchors whose gram occurs again need to be compared. They meet by gram,
each with the bytes around it, and their suffixes are sorted: prefix
polynomial hashes and binary search find the common extension of two
suffixes, so a comparison of the merge sort takes logarithmically many steps
and one byte. Adjacent extensions are verified against the bytes. A string
that starts j bytes before its anchor repeats when another suffix of its run
(extension of at least ``span - j``) has the same j bytes to its left; the
earliest such start stays, later ones are covered.

Copies of a whole text are settled by its SHA-256 before. A gram with more
than ``hot`` anchors is never gathered: its anchors are aggregated (map-side
first) to the first one of each distinct context, and only these are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import bucketed, offsets, ordered, staged
from quarry.llm.textbytes import _INV, BASE, U, chunks, mix, powers, text_buffer

SPAN = 100
GRAM = 24
HOT = 50_000
FLUSH = 16_000
_PIECE = 1 << 22
_BITS = U(23)
_CODE = np.random.Generator(np.random.PCG64(7_2024)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def anchors(buf: np.ndarray, off: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``buf`` of the anchors of all strings of ``span`` bytes
    that lie inside one row, and their gram hashes."""
    at, hashes = [], []
    width = span - gram + 1
    for lo in range(0, max(len(buf) - span + 1, 0), _PIECE):
        piece = buf[lo:lo + _PIECE + span - 1]
        n = len(piece)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODE[piece] * powers(BASE, n), out=prefix[1:])
        g = mix((prefix[gram:] - prefix[:-gram]) * powers(_INV, n)[:n - gram + 1])
        # ties and near ties go to the left one, wherever the string lies
        v = (g >> _BITS << _BITS) | np.arange(len(g), dtype=np.uint64)
        pad = -len(v) % width
        v = np.concatenate([v, np.full(pad, ~U(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(v, axis=1).ravel()
        back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - span + 1
        low = np.minimum(back[:windows], ahead[width - 1:width - 1 + windows])
        edges = off[(off > lo) & (off < lo + n)] - lo    # rows that begin inside
        cover = np.zeros(windows + 1, dtype=np.int32)
        np.add.at(cover, np.clip(edges - span + 1, 0, windows), 1)
        np.add.at(cover, np.clip(edges, 0, windows), -1)
        inside = np.cumsum(cover)[:windows] == 0
        flag = np.zeros(len(g), dtype=bool)
        flag[(low[inside] & ((U(1) << _BITS) - U(1))).astype(np.int64)] = True
        p = np.flatnonzero(flag)
        at.append(p + lo)
        hashes.append(g[p])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(at), return_index=True)
    return p, np.concatenate(hashes)[first]


def _anchor_rows(span, gram):
    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            th = b.column("th").to_numpy(zero_copy_only=False)
            for i, j in chunks(off):
                o = off[i:j + 1] - off[i]
                p, g = anchors(buf[off[i]:off[j]], o, span, gram)
                row = np.searchsorted(o, p, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(th[i + row]), pa.array((p - o[row]).astype(np.int32))],
                    ["gram", "th", "pos"])
    return run


def _repeated(batches):
    """Rows sorted by gram: those whose gram occurs more than once. The last
    row of a batch waits for the next one."""
    last, last_same = None, False
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if last is not None:
            t = pa.concat_tables([last, t])
        g = t.column("gram").to_numpy()
        same = np.zeros(len(g) + 1, dtype=bool)
        same[1:-1] = g[1:] == g[:-1]
        same[0] = last_same
        hit = same[:-1] | same[1:]
        last, last_same = t.slice(len(g) - 1), bool(same[-2])
        yield from t.slice(0, len(g) - 1).filter(pa.array(hit[:-1])).to_batches()
    if last_same:
        yield from last.to_batches()


def _contexts(span, gram):
    """Texts with their anchors: each anchor with the bytes around it."""
    left = span - gram

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            data = buf.tobytes()
            rid = b.column("rid").to_numpy()
            spots = b.column("spots")
            so = np.asarray(spots.offsets)
            pos = np.asarray(spots.flatten().field("pos")).astype(np.int64)
            grams = spots.flatten().field("gram")
            so = so - so[0]
            row = np.repeat(np.arange(len(rid)), np.diff(so))
            a = off[row] + pos
            s, e = np.maximum(a - left, off[row]), np.minimum(a + span, off[row + 1])
            for i in range(0, len(a), 20_000):
                j = min(i + 20_000, len(a))
                yield pa.RecordBatch.from_arrays(
                    [grams.slice(i, j - i), pa.array(rid[row[i:j]]), pa.array(pos[i:j].astype(np.int32)),
                     pa.array((a - s)[i:j].astype(np.int32)),
                     pa.array([data[x:y] for x, y in zip(s[i:j].tolist(), e[i:j].tolist(), strict=True)], pa.binary())],
                    ["gram", "rid", "pos", "nl", "ctx"])
    return run


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of the rows of ``m``: [length, row]."""
    out = np.zeros((m.shape[1] + 1, len(m)), dtype=np.uint64)
    for i in range(m.shape[1]):
        out[i + 1] = out[i] * U(BASE) + _CODE[m[:, i]]
    return out


def extension(h: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common prefix lengths of suffixes x and y by binary search over their
    prefix hashes."""
    lo, hi = np.zeros(len(x), dtype=np.int64), np.minimum(size[x], size[y])
    for _ in range(int(len(h)).bit_length()):
        mid = (lo + hi + 1) >> 1
        eq = h[mid, x] == h[mid, y]
        lo, hi = np.where(eq, mid, lo), np.where(eq, hi, mid - 1)
    return lo


def suffix_sort(group: np.ndarray, m: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of the suffixes (rows of ``m``, ``size`` bytes each) inside
    their groups (ascending codes): a merge sort of all groups at once,
    whose comparisons are hash-found extensions and one byte."""
    n = len(group)
    begin = np.searchsorted(group, group, side="left")
    end = np.searchsorted(group, group, side="right")
    perm = np.arange(n)
    width, largest = 1, int((end - begin).max(initial=0))
    while width < largest:
        local = np.arange(n) - begin
        run = local // width
        sib = begin + (run ^ 1) * width
        act = np.flatnonzero(sib < end)
        lo, hi = sib[act], np.minimum(sib[act] + width, end[act])
        first, e, odd = lo.copy(), perm[act], (run[act] & 1).astype(bool)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) >> 1
            x, y = perm[mid], e[live]
            lce = extension(h, size, x, y)
            short = lce >= np.minimum(size[x], size[y])
            at = np.minimum(lce, m.shape[1] - 1)
            less = np.where(short, size[x] < size[y], m[x, at] < m[y, at])
            equal = short & (size[x] == size[y])
            right = less | (equal & odd[live])        # stable: the left run goes first
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
        new = np.empty(n, dtype=perm.dtype)
        place = np.arange(n)
        place[act] = begin[act] + (run[act] >> 1) * 2 * width + local[act] % width + (lo - first)
        new[place] = perm
        perm, width = new, width * 2
    return perm


def _lcp(m: np.ndarray, size: np.ndarray, perm: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Common prefix length with the suffix before, from the bytes; -1 at
    the start of a group."""
    a, b = perm[:-1], perm[1:]
    diff = m[a] != m[b]
    lcp = np.where(diff.any(axis=1), diff.argmax(axis=1), m.shape[1])
    lcp = np.minimum(lcp, np.minimum(size[a], size[b]))
    return np.concatenate([[-1], np.where(group[a] == group[b], lcp, -1)])


def covered(group, rid, pos, nl, ctx, span: int, gram: int):
    """(rid, start, end) that repeated strings cover. Rows are ordered by
    (group, rid, pos), distinct, groups are whole."""
    n = len(group)
    left = span - gram
    raw = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    ends = np.cumsum([len(c) for c in ctx])
    a = ends - np.array([len(c) for c in ctx]) + nl
    nr = ends - a
    raw = np.concatenate([raw, np.zeros(span, np.uint8)])
    right = raw[a[:, None] + np.arange(span)]
    right[np.arange(span)[None, :] >= nr[:, None]] = 0
    back = raw[np.maximum(a[:, None] - 1 - np.arange(left), 0)]
    h, hl = _prefixes(right), _prefixes(back)
    perm = suffix_sort(group, right, nr, h)
    lcp = _lcp(right, nr, perm, group)
    at = np.flatnonzero(lcp >= 0)
    found = extension(h, nr, perm[at - 1], perm[at])
    x, y = perm[at - 1], perm[at]
    col = np.minimum(found, span - 1)
    bad = (found != lcp[at]) | np.where(found >= np.minimum(nr[x], nr[y]), nr[x] > nr[y], right[x, col] > right[y, col])
    if bad.any():                                    # a collision: sort these groups by their bytes
        for g in np.unique(group[perm[at[bad]]]):
            s, e = np.searchsorted(group, g), np.searchsorted(group, g, side="right")
            perm[s:e] = sorted(range(s, e), key=lambda i: (right[i, :nr[i]].tobytes(), i))
        lcp = _lcp(right, nr, perm, group)
    low = np.full(n, span)
    high = np.full(n, -1)
    origin = np.full((2, n), -1)
    for j in range(left + 1):
        run = np.empty(n, dtype=np.int64)
        run[perm] = np.cumsum(lcp < span - j)
        ok = np.flatnonzero((nl >= j) & (nr >= span - j))
        ok = ok[np.bincount(run[ok], minlength=n + 2)[run[ok]] > 1]
        if not len(ok):
            continue
        key = mix(run[ok].astype(np.uint64) * U(0x9FB21C651E98DF25) ^ hl[j, ok])
        order = np.argsort(key, kind="stable")       # rows ascend: the earliest of a key comes first
        key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = ok[order][np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        row, first = ok[order][~new], first[~new]
        fresh = low[row] > left
        low[row[fresh]], origin[0, row[fresh]] = j, first[fresh]
        high[row], origin[1, row] = j, first
    hit = np.flatnonzero(high >= 0)
    keep = np.ones(len(hit), dtype=bool)
    for which, js in ((0, low), (1, high)):           # verify the two strings that bound what is covered
        o, j = origin[which, hit], js[hit]
        c = np.arange(left)
        eq = ((back[hit] == back[o]) | (c[None, :] >= j[:, None])).all(axis=1)
        c = np.arange(span)
        eq &= ((right[hit] == right[o]) | (c[None, :] >= (span - j)[:, None])).all(axis=1)
        keep &= eq
    out = [(rid[hit[keep]], (pos - high)[hit[keep]], (pos - low)[hit[keep]] + span)]
    for g in np.unique(group[hit[~keep]]):            # a collision: compare these groups string by string
        seen: dict = {}
        r, s = [], []
        for i in np.flatnonzero(group == g):
            for j in range(left + 1):
                if nl[i] >= j and nr[i] >= span - j:
                    k = (j, raw[a[i] - j:a[i] - j + span].tobytes())
                    if k in seen:
                        r.append(rid[i])
                        s.append(pos[i] - j)
                    else:
                        seen[k] = i
        out.append((np.array(r, np.int64), np.array(s, np.int64), np.array(s, np.int64) + span))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _cover_rows(span, gram):
    def flush(parts):
        t = pa.Table.from_batches(parts)
        g, rid, pos, nl = (t.column(c).to_numpy().astype(np.int64) for c in ("gram", "rid", "pos", "nl"))
        fresh = np.ones(len(g), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1])
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        ctx = [c for c, f in zip(t.column("ctx").to_pylist(), fresh, strict=True) if f]
        r, s, e = covered(np.cumsum(new)[fresh], rid[fresh], pos[fresh], nl[fresh], ctx, span, gram)
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(e)], ["rid", "s", "e"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("gram").to_numpy()
            if held and rows >= FLUSH and held[-1].column("gram")[-1].as_py() != g[0]:
                yield flush(held)
                held, rows = [], 0
            cut = int(np.searchsorted(np.cumsum(g[::-1] != g[-1]), 1))
            cut = len(g) - cut                       # rows before the last, maybe unfinished, group
            if cut and rows + cut >= FLUSH:
                yield flush([*held, b.slice(0, cut)])
                held, rows = [], 0
                b = b.slice(cut)
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
        if held:
            yield flush(held)
    return run


def _remove(batches):
    """Texts with covered intervals: merged spans and the rest's digest."""
    for b in batches:
        buf, off = text_buffer(b.column("text"))
        data = buf.tobytes()
        out = []
        for i, cuts in enumerate(b.column("cuts").to_pylist()):
            spans: list[list[int]] = []
            for c in sorted((c["s"], c["e"]) for c in cuts):
                if spans and c[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], c[1])
                else:
                    spans.append(list(c))
            digest, at = hashlib.sha256(), int(off[i])
            for s, e in spans:
                digest.update(data[at:off[i] + s])
                at = int(off[i]) + e
            digest.update(data[at:off[i + 1]])
            out.append((spans, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [b.column("rid"), pa.array([[{"s": s, "e": e} for s, e in x[0]] for x in out],
                                       pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
             pa.array([x[1] for x in out], pa.string())], ["rid", "spans", "kept_sha256"])


def _hot_cover(ctx: DataFrame, span: int, gram: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Anchors of grams with too many of them to gather: (first anchors of
    their distinct contexts, covered intervals of the others). An anchor whose
    context was there before is covered as a whole. A gram that even has too
    many contexts is not gathered either: one row for each of its strings is
    aggregated to its earliest start."""
    ctx = staged(ctx, "hot-contexts")
    first = staged(ctx.groupBy("gram", "nl", "ctx").agg(F.min(F.struct("rid", "pos")).alias("first")), "hot-firsts")
    low, high = f"greatest(0, {span} - length(ctx) + nl)", f"least(nl, {span - gram})"
    again = (ctx.join(first, ["gram", "nl", "ctx"]).where(f"struct(rid, pos) > first and {low} <= {high}")
             .select("rid", F.expr(f"cast(pos - {high} as bigint)").alias("s"), F.expr(f"cast(pos - {low} + {span} as bigint)").alias("e")))
    reps = first.select("gram", "first.rid", "first.pos", "nl", "ctx")
    heavy = staged(reps.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "hot-varied")
    if heavy.isEmpty():
        return reps, again
    j = F.explode(F.expr(f"filter(sequence(0, {high}), j -> length(ctx) - nl >= {span} - j)")).alias("j")
    rows = (reps.join(heavy, "gram", "left_semi").select("gram", "rid", "pos", "nl", "ctx", j)
            .select("rid", (F.col("pos") - F.col("j")).cast("long").alias("s"), "j", "gram",
                    F.md5(F.expr(f"substring(ctx, nl - j + 1, {span})")).alias("string")))
    start = rows.groupBy("gram", "j", "string").agg(F.min(F.struct("rid", "s")).alias("first"))
    varied = (rows.join(start, ["gram", "j", "string"]).where("struct(rid, s) > first")
              .select("rid", "s", (F.col("s") + span).alias("e")))
    return reps.join(heavy, "gram", "left_anti"), again.unionByName(varied)


def repeated_bytes(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) per row: ``spans`` are
    the maximal runs of bytes covered by a ``span``-byte string that also
    starts earlier (smaller id, or the same document and an earlier start),
    judged on the input; ``kept_sha256`` digests the bytes that are left.

    Null texts are empty. Rows that repeat an id and a text are one document
    and get the same result; different texts under one id are ordered by
    SHA-256, and null ids come last in the same way. Other columns are
    ignored, an empty table gives no rows. Anchors of a run of one repeated
    byte are dense, never more than one per byte.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = base.select("id", "text", F.xxhash64("text").alias("th"), F.sha2(F.col("text"), 256).alias("sha"))
    reps = keyed.groupBy("sha", "th").agg(F.min("id").alias("id"))
    line = ordered(reps, ["id", "sha"], "texts-order")
    inside = W.partitionBy("part").orderBy(F.col("id").asc_nulls_last(), "sha")
    reps = staged(line.join(F.broadcast(offsets(line, [], F.lit(1), "before")), "part")
                  .select("sha", "th", "id", (F.col("before") + F.row_number().over(inside)).alias("rid")), "texts-ids")
    texts = bucketed(keyed.where(F.octet_length("text") >= span)
                     .join(reps.select("th", F.col("id").alias("rep"), F.col("sha").alias("rsha"), "rid"), "th")
                     .where("sha = rsha and id <=> rep").select("th", "rid", "text"), "th", "repeats")
    found = staged(texts.select("th", "text").mapInArrow(_anchor_rows(span, gram), "gram long, th long, pos int")
                   .repartition("gram").sortWithinPartitions("gram")
                   .mapInArrow(_repeated, "gram long, th long, pos int"), "anchors")

    def contexts(some: DataFrame) -> DataFrame:
        spots = some.groupBy("th").agg(F.collect_list(F.struct("pos", "gram")).alias("spots"))
        return (texts.join(spots, "th").select("rid", "text", "spots")
                .mapInArrow(_contexts(span, gram), "gram long, rid long, pos int, nl int, ctx binary"))
    heavy = staged(found.groupBy("gram").count().where(F.col("count") > hot).select("gram"), "hot-grams")
    if heavy.isEmpty():
        cold, extra = contexts(found), None
    else:
        cold = contexts(found.join(heavy, "gram", "left_anti"))
        few, extra = _hot_cover(contexts(found.join(heavy, "gram", "left_semi")), span, gram, hot)
        cold = cold.unionByName(few)
    cover = (cold.repartition("gram").sortWithinPartitions("gram", "rid", "pos")
             .mapInArrow(_cover_rows(span, gram), "rid long, s long, e long"))
    cover = staged(cover.unionByName(extra) if extra is not None else cover, "covered")
    cuts = (cover.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
            .join(reps.select("rid", "th"), "rid").withColumnRenamed("rid", "crid"))
    done = staged(texts.join(cuts, "th").where("rid - crid = 0").select("rid", "text", "cuts")
                  .mapInArrow(_remove, "rid long, spans array<struct<s: bigint, e: bigint>>, kept_sha256 string")
                  .dropDuplicates(["rid"]), "removed")
    whole = "array(named_struct('s', 0L, 'e', n_bytes))"
    return (keyed.select("id", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
            .join(reps.select("sha", F.col("id").alias("rep"), "rid"), "sha")
            .join(done, "rid", "left")
            .withColumn("copy", F.expr(f"not (id <=> rep) and n_bytes >= {span}"))
            .withColumn("rest", F.expr("case when id <=> rep then spans end"))
            .select(F.col("id").alias("doc_id"), "n_bytes",
                    F.expr(f"case when copy then {whole} when rest is not null then rest"
                           f" else filter({whole}, x -> false) end").alias("spans"),
                    F.expr("case when copy then sha2('', 256) when rest is not null then kept_sha256 else sha end").alias("kept_sha256"))
            .withColumn("n_removed", F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)"))
            .select("doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"))
