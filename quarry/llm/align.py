"""Alignment of the tokens of two tokenizers over the same texts.

Byte offsets at which tokens of both end cut a text into groups. Most groups
are one token of A and one of B with the same bytes: a table from A's ids to
the B id of the same bytes, made once, recognises them, and they are counted
in a vector as long as A's vocabulary. Only the links of the other groups
enter the shuffle that counts pairs of ids, once for each block of texts.

Words are aligned once for a block and remembered by the worker; a block's
texts then are sums over the numbers of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.atoms import BLOCK, Block, ByteBpe, Known, Ragged, blocks, flat_ids
from quarry.llm.common import staged

DOC, PAIRS, VECTOR = 0, 1, 2


class Pieces:
    """A piece model: ids of atoms, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.bytes, self.is_byte = [], []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            self.is_byte.append(m.is_byte(i))
            self.bytes.append(bytes([int(piece[3:5], 16)]) if m.is_byte(i) else
                              b"" if m.is_control(i) or m.is_unknown(i) else piece.replace("▁", " ").encode())
        pieces, end = [m.id_to_piece(i) for i in range(m.get_piece_size())], m.encode("\n")
        if len(end) != 2 or any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces of this model reach over a blank or a line end: words are not independent")
        self.end = end[1]

    def __call__(self, atoms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The model itself adds a blank before the line end of each call."""
        encode = lambda t: self.model.encode(t, num_threads=1)
        return flat_ids(encode, lambda t: encode("\n" + t)[2:], self.end, atoms)


def same_bytes(a: list[bytes], b: list[bytes], is_byte: list[bool]) -> np.ndarray:
    """For each A id the B id of the same bytes, -1 without one; a piece goes
    before a single-byte fallback."""
    of = {x: i for i, x in enumerate(b) if is_byte[i]} | {x: i for i, x in enumerate(b) if x and not is_byte[i]}
    return np.array([of.get(x, -1) if x else -1 for x in a], dtype=np.int64)


def _table(values: list[bytes]) -> Ragged:
    out = Ragged(np.uint8)
    out.extend(np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values]))
    return out


class Aligner(Known):
    """Both tokenizers, and what is known of words: counts, the A ids of
    one-to-one groups of equal bytes, the links of all other groups, and the
    groups written out."""

    def __init__(self, a_path: str, b_path: str):
        super().__init__()
        self.a, self.b = ByteBpe(a_path, special=False), Pieces(b_path)
        self.same_id = same_bytes(self.a.bytes, self.b.bytes, self.b.is_byte)
        self.wide = len(self.b.bytes)
        self.a_bytes, self.b_bytes = _table(self.a.bytes), _table(self.b.bytes)
        na = len(self.a.bytes)
        ids = [*range(na), *range(self.wide)]
        last = [b"|"] * na + [b";"] * self.wide
        # a token before another of its side, then one that ends its side of a group
        self.shown = _table([b"%d," % i for i in ids] + [b"%d%s" % (i, e) for i, e in zip(ids, last, strict=True)])
        self.reset()

    def reset(self) -> None:
        self.counts, self.same, self.links, self.text = Ragged(np.int64), Ragged(np.int32), Ragged(np.int64), Ragged(np.uint8)

    def work(self, atoms: list[bytes]) -> None:
        """New words: their four counts (A tokens, B tokens, groups; and
        whether both give the word's bytes) and lists."""
        if not atoms:
            return
        size = np.fromiter(map(len, atoms), np.int64, len(atoms))
        texts = [a.decode("utf-8", "replace") for a in atoms]
        a, b = Ragged(np.int64), Ragged(np.int64)
        a.extend(*self.a(texts))
        b.extend(*self.b(texts))
        every, ok = np.arange(len(atoms)), np.ones(len(atoms), dtype=bool)
        data = np.frombuffer(b"".join(atoms), np.uint8)
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            ok &= _sums(table.size(ids.all()), ids.size(every)) == size
        # A gives back every text that is UTF-8; one that is not comes back from B as another
        keep = np.flatnonzero(ok)
        mine = np.repeat(ok, size)
        ok[np.repeat(keep, size[keep])[self.b_bytes.take(b.take(keep)) != data[mine]]] = False
        good = np.flatnonzero(ok)
        n_a, n_b = np.where(ok, a.size(every), 0), np.where(ok, b.size(every), 0)
        x, y = a.take(good), b.take(good)
        x_end, y_end = np.cumsum(self.a_bytes.size(x)), np.cumsum(self.b_bytes.size(y))
        x_start, y_start = x_end - self.a_bytes.size(x), y_end - self.b_bytes.size(y)
        cut = x_end[y_end[np.minimum(np.searchsorted(y_end, x_end), len(y_end) - 1)] == x_end] if len(y_end) else x_end
        gx, gy = np.searchsorted(cut, x_end), np.searchsorted(cut, y_end)
        word = np.repeat(good, n_a[good])                               # of each A token
        of_group = word[np.searchsorted(gx, np.arange(len(cut)))]
        in_x, in_y = np.bincount(gx, minlength=len(cut)), np.bincount(gy, minlength=len(cut))
        alone = (in_x == 1) & (in_y == 1)
        i, j = np.flatnonzero(alone[gx]), np.flatnonzero(alone[gy])
        alone[gx[i[self.same_id[x[i]] != y[j]]]] = False
        i = np.flatnonzero(alone[gx])
        self.same.extend(x[i], np.bincount(word[i], minlength=len(atoms)))
        k = np.flatnonzero(~alone[gx])
        lo, hi = np.searchsorted(y_end, x_start[k], side="right"), np.searchsorted(y_start, x_end[k], side="left")
        n = hi - lo
        over = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.repeat(x[k], n) * self.wide + y[over]
        self.links.extend(pair, np.bincount(np.repeat(word[k], n), minlength=len(atoms)))
        n_groups = np.bincount(of_group, minlength=len(atoms))
        # tokens in the order of groups, A before B; the last of a side closes it
        order = np.argsort(np.concatenate([2 * gx, 2 * gy + 1]), kind="stable")
        closes = np.concatenate([np.append(gx[1:] != gx[:-1], True)[:len(gx)], np.append(gy[1:] != gy[:-1], True)[:len(gy)]])
        shown = (np.concatenate([x, y + len(self.a.bytes)]) + closes * (len(self.a.bytes) + self.wide))[order]
        letters = _sums(self.shown.size(shown), n_a[good] + n_b[good])
        all_letters = np.zeros(len(atoms), np.int64)
        all_letters[good] = letters
        self.text.extend(self.shown.take(shown), all_letters)
        self.counts.extend(np.stack([n_a, n_b, n_groups, ok], axis=1).ravel(), np.full(len(atoms), 4))

    def rows(self, block: Block, number: int, ids: pa.Array, vector: np.ndarray):
        """The record batches of one block; ``vector`` counts its groups of
        equal bytes."""
        known = self.number(block)
        counts = self.counts.take(known).reshape(-1, 4)
        of, row, n = block.of, block.rows(), len(ids)
        bad = np.bincount(row, weights=1 - counts[of, 3], minlength=n) > 0
        keep = ~bad[row]
        of, row = of[keep], row[keep]
        sums = [np.bincount(row, weights=counts[of, c], minlength=n).astype(np.int64) for c in range(3)]
        of = known[of]
        same, links = self.same.take(of), self.links.take(of)
        n_same = np.bincount(row, weights=self.same.size(of), minlength=n).astype(np.int64)
        n_links = np.bincount(row, weights=self.links.size(of), minlength=n).astype(np.int64)
        vector += np.bincount(same, minlength=len(vector))
        pairs, at, count = np.unique(links, return_inverse=True, return_counts=True)
        letters = memoryview(self.text.take(of))
        ends = np.cumsum(np.bincount(row, weights=self.text.size(of), minlength=n).astype(np.int64))
        sha = [hashlib.sha256(letters[x:y - 1]).hexdigest() if y > x else "" for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        yield _batch(n, {"kind": [DOC] * n, "block": [number] * n, "doc_id": ids, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2],
                         "n_links": n_same + n_links, "groups_sha256": sha, "same": _lists(same, n_same), "irregular": _lists(at, n_links)}, ids.type)
        yield _batch(1, {"kind": [PAIRS], "block": [number], "a": [pairs // self.wide], "b": [pairs % self.wide], "n": [count]}, ids.type)


_FIELDS = [("kind", pa.int32()), ("block", pa.int64()), ("doc_id", None), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
           ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("same", pa.list_(pa.int32())), ("irregular", pa.list_(pa.int32())),
           ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``."""
    total, ends = np.concatenate([[0], np.cumsum(values)]), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _batch(n: int, given: dict, id_type: pa.DataType) -> pa.RecordBatch:
    cols = []
    for name, kind in _FIELDS:
        v = given.get(name)
        cols.append(pa.nulls(n, kind or id_type) if v is None else v if isinstance(v, pa.Array) else pa.array(v, kind))
    return pa.RecordBatch.from_arrays(cols, [name for name, _ in _FIELDS])


_ALIGNERS: dict = {}


def _aligner(a_path: str | None, b_path: str | None) -> Aligner:
    import public_tokenizers
    key = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _encode(a_path: str | None, b_path: str | None, block_bytes: int):
    def run(batches):
        al, part = _aligner(a_path, b_path), TaskContext.get().partitionId()
        vector, ids_type = np.zeros(len(al.same_id), np.int64), pa.int64()
        for k, (block, b) in enumerate(blocks(batches, block_bytes, lead=True)):
            ids = b.column("id")
            ids_type = ids.type
            yield from al.rows(block, part << 32 | k, ids, vector)
        a = np.flatnonzero(vector)
        if len(a):
            yield _batch(1, {"kind": [VECTOR], "a": [a], "b": [al.same_id[a]], "n": [vector[a]]}, ids_type)
    return run


def _look_up(same_count: np.ndarray, same_best: np.ndarray):
    """The texts of one block with their links' counts."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i = right.column("i").to_numpy()
        count, best = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        count[i], best[i] = right.column("total").to_numpy(), right.column("best").to_numpy().astype(np.int64)

        def per_row(name, values):
            lists = left.column(name).combine_chunks()
            return _sums(values[lists.flatten().to_numpy()], np.diff(lists.offsets.to_numpy()))
        cols = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        cols += [pa.array(per_row("same", s) + per_row("irregular", o), pa.int64()) for s, o in ((same_best, best), (same_count, count))]
        return pa.Table.from_arrays([*cols, left.column("groups_sha256")],
                                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    return run


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(texts, pairs) of tokenizer A, a byte-level BPE file, and B, a piece
    model (paths that the workers can open; None: the installed ones).

    ``texts``: one row for each row of ``docs``: doc_id, n_a, n_b, n_groups,
    n_links (overlapping A and B tokens), n_best (links whose pair is the
    most frequent one of its B id in the corpus, ties included), count_sum
    (frequencies of the links' pairs) and groups_sha256 of the groups written
    out. ``pairs``: a, b, total, best for every pair of ids linked anywhere.

    Texts that are null, empty or not given back byte for byte by both
    tokenizers have no tokens: zeros and an empty ``groups_sha256``, nothing
    counted. Null ids are kept, rows that repeat count each on their own,
    other columns are ignored, an empty table gives no rows. Blocks are
    about ``block_bytes`` of text, a longer text is one of its own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = staged(texts.mapInArrow(_encode(a_path, b_path, block_bytes),
                                   f"kind int, block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
                                   " same array<int>, irregular array<int>, a array<int>, b array<int>, n array<long>"), "aligned")
    linked = rows.where(F.col("kind") > DOC).select("kind", "block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("i", "x")) \
        .select("kind", "block", "i", "x.a", "x.b", "x.n")
    totals = staged(linked.groupBy("a", "b").agg(F.sum("n").alias("total"), F.max((F.col("kind") == VECTOR).cast("int")).alias("same")), "pair-counts")
    # one row for each id of B: its vocabulary bounds the broadcast
    top = totals.groupBy("b").agg(F.max("total").alias("top"))
    pairs = totals.join(F.broadcast(top), "b").select("a", "b", "total", (F.col("total") == F.col("top")).alias("best"), "same")
    # at most one row for each id of A
    same = pairs.where("same = 1").select("a", "total", "best").collect()
    size = max([r.a for r in same], default=-1) + 1
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in same:
        count[r.a], best[r.a] = r.total, r.best
    answers = linked.where(F.col("kind") == PAIRS).select("block", "i", "a", "b").join(pairs, ["a", "b"]).select(F.col("block").alias("of_block"), "i", "total", "best")
    out = rows.where(F.col("kind") == DOC).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "irregular") \
        .groupBy("block").cogroup(answers.groupBy("of_block")) \
        .applyInArrow(_look_up(count, best), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out, pairs.drop("same")
