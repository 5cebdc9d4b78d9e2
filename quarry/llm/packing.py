"""Packing of tokenised documents into sequences by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Which lengths go
together depends only on how many pieces there are of each length, so the
plan is made from that histogram (``capacity`` numbers, whatever the size of
the corpus): for each bin the longest length left is set, a bitset
subset-sum over the lengths still available finds the fullest feasible rest,
and the combination is removed as often as it is available. Pieces are
numbered within their length (totals of partitions, prefix sums), and the
number says in which copy of which combination a piece lies.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.atoms import Block, ByteBpe, Known, Ragged, blocks
from quarry.llm.common import offsets, staged
from quarry.llm.textbytes import text_buffer

CAPACITY, END_ID = 1024, 2
_TOKENIZERS: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Encoder(Known):
    """Ids of texts. The words of a block are told apart in one call, each
    distinct one is encoded once and remembered, and a text's ids are gathered
    by the numbers of its words."""

    def __init__(self, path: str):
        super().__init__()
        self.bpe = ByteBpe(path, special=True)
        self.tok = self.bpe.tok
        self.reset()

    def reset(self) -> None:
        self.ids = Ragged(np.uint32)

    def work(self, atoms: list[bytes]) -> None:
        self.ids.extend(*self.bpe([a.decode("utf-8", "replace") for a in atoms]))

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each)."""
        words = self.number(block)[block.of]
        n = np.bincount(block.rows(), weights=self.ids.size(words), minlength=len(block.first) - 1).astype(np.int64)
        return self.ids.take(words), n

    def __call__(self, texts: list[str]) -> list[bytes]:
        buf, off = text_buffer(pa.array(texts, pa.string()))
        ids, n = self.block(Block(buf, off))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


def _encoder(path: str | None) -> Encoder:
    path = path or tokenizer_path()
    if path not in _TOKENIZERS:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length) of the pieces of texts of n > 0 tokens;
    only the first piece of a text may be short."""
    pieces = -(-n // capacity)
    text = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (n - capacity * (pieces - 1))[text]
    return text, piece, np.where(piece > 0, first + (piece - 1) * capacity, 0), np.where(piece > 0, capacity, first)


def _pieces(path: str | None, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        enc, part = _encoder(path), TaskContext.get().partitionId()
        for block, b in blocks(batches):
            ids, n = enc.block(block)
            data = np.full(len(ids) + len(n), end_id, dtype="<u4")          # an end behind each text
            data[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            at = np.cumsum(n + 1) - (n + 1)
            text, piece, start, length = cut(n + 1, capacity)
            lo = at[text] + start
            raw = memoryview(data).cast("B")
            crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
            cols = [pa.array(np.full(len(text), part), pa.int32()), b.column("id").take(pa.array(text)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["part", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(data.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to
    ``room``: bitset subset-sum, longest lengths first, whose states are kept
    to trace the combination back."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, size = min(counts[length], room // length), 1
        while left > 0:                      # 1, 2, 4 ... copies at a time
            take = min(size, left)
            new = reach | (reach << (take * length)) & mask
            if new != reach:
                steps.append((length, take, reach))
                reach = new
            left, size = left - take, size * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= take * length
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins of it) until no piece is left."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    out, longest = [], capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return out
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
        out.append((used, times))


def layout(plan) -> dict[int, np.ndarray]:
    """For each length the rows (first number, first bin, bins, offset) of
    the combinations that take pieces of it."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    base = 0
    for used, times in plan:
        at = 0
        for length in sorted(used, reverse=True):
            first = taken.get(length, 0)
            rows.setdefault(length, []).append((first, base, times, at))
            taken[length] = first + used[length] * times
            at += length * used[length]
        base += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def _places(rows: dict[int, np.ndarray]):
    def run(batches):
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                i = np.flatnonzero(length == k)
                r = rows[int(k)]
                r = r[np.searchsorted(r[:, 0], number[i], side="right") - 1]
                d = number[i] - r[:, 0]
                seq[i], off[i] = r[:, 1] + d % r[:, 2], r[:, 3] + d // r[:, 2] * k
            names = [n for n in b.schema.names if n not in ("part", "number")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset):
    every row of ``docs`` as ids and ``end_id``, cut into pieces, each with
    its place. ``tokenizer`` is the path of a tokenizer file that the workers
    can open (None: the installed 50k byte BPE).

    Null and empty texts are the end id alone. Null ids are kept, rows that
    repeat are packed each on their own; other columns are ignored; an empty
    table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    cols = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{extra}"
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                  .mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), f"part int, {cols}"), "pieces")
    # at most ``capacity`` numbers, whatever the corpus
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = layout(plan_bins(histogram, capacity))
    before = offsets(rows, ["length"], F.lit(1), "before")
    inside = W.partitionBy("part", "length").orderBy(*[F.col(c).asc_nulls_last() for c in ("doc_id", "piece", "ids_crc32", "start")])
    numbered = (rows.withColumn("n", F.row_number().over(inside)).join(before, ["part", "length"])
                .select("part", *[c for c in rows.columns if c != "part"], (F.col("before") + F.col("n") - 1).cast("long").alias("number")))
    return numbered.mapInArrow(_places(places), f"{cols}, sequence_id long, offset long")
