"""A hashed maximum-entropy language model over words.

The probability of a token is that of its class given the context, times
that of the token within its class given the same context. Tokens are ranked
by their training counts: the most frequent ones are classes of their own,
class g of the others holds the next 16 ** (g + 1) ranks, and a token is the
g + 1 digits of its place there, so no two tokens share a code. One rank
after the last stands for all tokens that training never saw. The class
follows a softmax over features of the context: the last token, the last two,
and the one before the last alone (a skip), each hashed to a row of weights.
A digit is four bits, each a logistic model over the same features, hashed
with the class and the digits before it to a row of 15 weights, one for every
place of a bit behind the bits before it.

Token counts come from all training texts and are joined to the blocks of
texts that use them. The weights of classes start from the counts of features
and classes, those of bits from the counts of the tokens behind them; then
every round sums the gradient of all training texts in Spark and updates
both. Only these tables of weights, whose sizes are parameters, and the
totals of classes ever reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import dropped, offsets, staged, staged_by
from quarry.llm.textbytes import U, chunks, mix, text_buffer

HEAD, TAIL = 8, 8             # classes of one token, classes of 16, 16 ** 2, ... tokens
BUCKETS = 1 << 15             # rows of weights of classes
DIGIT_ROWS = 1 << 16          # rows of weights of digits, a power of two
ROUNDS, STEP, SHRINK = 2, 0.5, 80.0
BLOCK = 8 << 20               # bytes of text whose distinct tokens are looked up together
BATCH = 1 << 12               # tokens scored at a time
PIECES = 32                   # the table of weights travels in so many pieces
ROWS = 500                    # coded texts unpacked at a time
TASK_TOKENS = 8_000_000       # tokens whose gradient one task sums
TEMPLATES = 3
FAR = 20                      # largest log odds of a bit: four odds multiply in single precision
BEGIN = 1 << 16               # the token before a text
ENCODED, LISTED = 0, 1
FIRST = np.array([HEAD + sum(16 ** (j + 1) for j in range(g)) for g in range(TAIL)])  # ranks that begin the shared classes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def tokens(buf: np.ndarray, off: np.ndarray):
    """(numbers, distinct tokens, offsets of the texts): words in lower case,
    and an empty token at the end of each text. Frequent tokens have small
    numbers."""
    buf, off = _LOWER[buf[off[0]:off[-1]]], off - off[0]
    n, texts = len(buf), len(off) - 1
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    start = inside & np.concatenate([[True], ~inside[:-1]])[:n] | inside & edge[:n]
    s = np.flatnonzero(start)
    letters = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    first = np.searchsorted(s, off)                                   # words before each text
    begins = letters[s]                                               # in the buffer without white space
    ends = np.concatenate([begins[1:], letters[-1:]]) if len(s) else begins
    at = np.arange(len(s)) + np.repeat(np.arange(texts), np.diff(first))
    size = np.zeros(len(s) + texts, np.int64)
    size[at] = ends - begins
    flat = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(buf[inside])])
    code = flat.dictionary_encode()
    number = code.indices.to_numpy()
    often = np.argsort(-np.bincount(number, minlength=len(code.dictionary)), kind="stable")
    rank = np.empty(len(often), np.int32)
    rank[often] = np.arange(len(often), dtype=np.int32)
    return rank[number], code.dictionary.take(pa.array(often)), first + np.arange(texts + 1)


def contexts(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(templates, tokens) hashes of each token's context; ``word`` are hashes
    below BEGIN, texts begin at ``first[:-1]``."""
    before = np.full((2, len(word)), BEGIN, np.uint64)
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    for k in (1, 2):
        before[k - 1, k:] = np.where(place[k:] >= k, word[:-k], BEGIN) if len(word) > k else before[k - 1, k:]
    one, two = before
    wide = U(BEGIN + 1)
    keys = one + U(1 << 40), one * wide + two + U(2 << 40), two + U(3 << 40)
    return np.stack([mix(k * U(0x9E3779B97F4A7C15)) for k in keys])


def features(word: np.ndarray, first: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """(templates, tokens) rows of weights of each token's context."""
    return (contexts(word, first) % U(buckets)).astype(np.int32)


def classes(rank: np.ndarray) -> np.ndarray:
    return np.where(rank < HEAD, rank, HEAD - 1 + np.searchsorted(FIRST, rank, side="right")).astype(np.uint8)


def digits(rank: np.ndarray, cls: np.ndarray):
    """For every place of a digit: (tokens that have one, hashes of the class
    and the digits before it, the digit)."""
    shared = np.flatnonzero(cls >= HEAD)
    group = cls[shared].astype(np.int64) - HEAD
    place = rank[shared].astype(np.int64) - FIRST[group]
    for level in range(int(group.max(initial=-1)) + 1):
        there = group >= level
        left = 4 * (group[there] - level)              # bits of this digit's followers
        before = (place[there] >> (left + 4)) << 6 | group[there] << 3 | level
        yield shared[there], mix((before.astype(np.uint64) + U(1)) * U(0xD6E8FEB86659FD93)), place[there] >> left & 15


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of all classes, for a batch of contexts; ``bias`` is one for all or one for each."""
    x = np.take(weights, rows[0], axis=0, mode="clip")     # all rows are there: no copy to check them
    for r in rows[1:]:
        x += np.take(weights, r, axis=0, mode="clip")
    x += bias
    np.exp(np.clip(x, -60, 60, out=x), out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    return x


def add_seen(rows: np.ndarray, cls: np.ndarray, out: np.ndarray) -> None:
    """Counts of (row of weights, class)."""
    one = out.dtype.type(1)                                # of one type with the counts: no cast for each
    for r in rows:
        np.add.at(out.reshape(-1), r * np.int64(out.shape[1]) + cls, one)


def add_expected(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """What the model expects of the same counts."""
    twos = out.view(np.complex128)                         # two counts are added at a time
    k = np.arange(twos.shape[1])
    for i in range(0, rows.shape[1], BATCH):
        batch = rows[:, i:i + BATCH]
        p = probabilities(weights, bias, batch).astype(np.float64).view(np.complex128).ravel()
        for r in batch:
            np.add.at(twos.reshape(-1), (r[:, None] * np.int64(len(k)) + k).ravel(), p)


def odds(weights: np.ndarray, own: np.ndarray, cells: np.ndarray, node: np.ndarray, digit: np.ndarray):
    """For each bit of a batch of digits: (its weights, log odds that it is
    one, the bit); ``cells`` and ``node`` are where rows of 16 begin."""
    used = bool(len(weights))                              # before the first step there are none
    for k in range(4):
        place = (16 | digit) >> (4 - k)                    # 1 for the first bit, 2 and 3 for the second, ...
        here = cells + place
        x = own.take(node + place, mode="clip")
        for c in here if used else ():
            x += weights.take(c, mode="clip")
        yield here, np.clip(x, -FAR, FAR, out=x), digit >> (3 - k) & 1


def add_expected_bits(weights: np.ndarray, own: np.ndarray, cells: np.ndarray, node: np.ndarray, digit: np.ndarray, out: np.ndarray) -> None:
    """How many bits of one the model expects behind every weight."""
    for i in range(0, len(digit), BATCH):
        for here, x, _ in odds(weights, own, cells[:, i:i + BATCH], node[i:i + BATCH], digit[i:i + BATCH]):
            p = (1 / (1 + np.exp(-x))).astype(np.float64)
            for c in here:
                np.add.at(out, c, p)


def bit_counts(count: np.ndarray):
    """(rows, 15) counts of zero and of one at every place of a bit, from
    counts of digits."""
    sums = np.zeros((len(count), 32))
    sums[:, 16:] = count
    for n in (8, 4, 2, 1):
        sums[:, n:2 * n] = sums[:, 2 * n:4 * n:2] + sums[:, 2 * n + 1:4 * n:2]
    return sums[:, 2::2], sums[:, 3::2]


def start_weights(count: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Log ratios of a feature's classes to those of all tokens, shrunk by
    prior tokens and shared among the templates."""
    n = count.sum(axis=1, keepdims=True)
    return (np.log((count + SHRINK * prior) / ((n + SHRINK) * prior)) / (TEMPLATES - 1)).astype(np.float32)


def updated(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One gradient step (seen less expected counts), each weight at a rate
    by its own evidence."""
    return (weights + STEP * (seen - expected) / (np.maximum(seen, expected) + SHRINK)).astype(np.float32)


def updated_bits(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The same step for the log odds of bits: both outcomes move, each by
    its own evidence."""
    zero, one = bit_counts(seen)
    gap = one - expected[:, 1:]
    out = weights.astype(np.float64)
    out[:, 1:] += STEP * gap * (1 / (np.maximum(one, one - gap) + SHRINK) + 1 / (np.maximum(zero, zero + gap) + SHRINK))
    return out.astype(np.float32)


def _packed(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary value for each text."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1,
                                 [None, pa.py_buffer(np.asarray(first, np.int64) * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())


def _encode(batches):
    """Texts as numbers of their block's distinct tokens, and those tokens
    with how often training texts of the block hold them."""
    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        buf, off = text_buffer(b.column("text"))
        for i, j in chunks(off, BLOCK):
            number, words, first = tokens(buf, off[i:j + 1])
            block, n = part << 32 | k, j - i
            k += 1
            held = b.column("held").slice(i, n)
            train = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            count = np.bincount(number[train], minlength=len(words))
            ids = b.column("id").slice(i, n)
            # the three bytes of the numbers apart: the higher ones are mostly zero
            planes = [_packed((number >> s).astype(np.uint8), first) for s in (0, 8, 16)]
            names = ["kind", "block", "i", "doc_id", "held_out", "low", "mid", "high", "word", "n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, ENCODED), pa.int32()), pa.array(np.full(n, block)), pa.array(np.arange(n), pa.int32()), ids, held, *planes,
                 pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
            for x in range(0, len(words), 50_000):
                m = len(words[x:x + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, LISTED), pa.int32()), pa.array(np.full(m, block)), pa.array(np.arange(x, x + m), pa.int32()), pa.nulls(m, ids.type),
                     pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.binary())] * 3, words[x:x + m].cast(pa.binary()), pa.array(count[x:x + m], pa.int64())], names)


def _code(total: int, distinct: int):
    """The texts of one block with counts looked up: base scores and the
    ranks of their tokens."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        i = right.column("i").to_numpy()
        count, rank = np.zeros(len(i), np.int64), np.zeros(len(i), np.uint32)
        count[i], rank[i] = (right.column(c).to_numpy() for c in ("c", "rank"))
        base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        planes = [text_buffer(left.column(c)) for c in ("low", "mid", "high")]
        first = planes[0][1]
        number = planes[0][0].astype(np.int32)
        for k in (1, 2):
            number |= planes[k][0].astype(np.int32) << (8 * k)

        def sums(values):
            return np.add.reduceat(values[number], first[:-1]) if len(number) else np.zeros(0)

        return pa.Table.from_arrays(
            [left.column("block"), left.column("i"), left.column("doc_id"), left.column("held_out"), pa.array(np.diff(first)),
             pa.array(sums((count > 0).astype(np.int64)).astype(np.int64)), pa.array(sums(base)), _packed((rank & 0xFFFF).astype(np.uint16)[number], first), _packed((rank >> 16).astype(np.uint16)[number], first)],
            ["block", "i", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "low", "high"])
    return run


def _unpacked(batches):
    """(batch, ranks, hashes of contexts, offsets) of some coded texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            b = batch.slice(i, ROWS)
            (low, off), (high, _) = (text_buffer(b.column(c)) for c in ("low", "high"))
            rank = np.frombuffer(low.tobytes(), "<u2").astype(np.int64) | np.frombuffer(high.tobytes(), "<u2").astype(np.int64) << 16
            first = off // 2
            yield b, rank, contexts(mix(rank.astype(np.uint64) + U(1)) % U(BEGIN), first), first


def _digit_rows(rank: np.ndarray, cls: np.ndarray, context: np.ndarray):
    """(tokens, beginnings of rows of weights, of rows of the digits' own
    counts, digit) for every place of a digit."""
    inside = U(16 * (DIGIT_ROWS - 1))
    for at, node, digit in digits(rank, cls):
        node = node << U(4)
        cells = np.stack([(c[at] << U(4) ^ node) & inside for c in context])
        yield at, cells.view(np.int64), (node & inside).view(np.int64), digit


def _pieces(*tables: np.ndarray) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    cut = [np.array_split(t, PIECES) for t in tables]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), *[pa.array([x.tobytes() for x in c], pa.binary()) for c in cut]],
        ["piece", "part", "seen", "expected"][:2 + len(cut)])


def _count(batches):
    out = np.zeros((BUCKETS, HEAD + TAIL), np.int64)
    for _, rank, context, _ in _unpacked(batches):
        add_seen((context % U(BUCKETS)).astype(np.int32), classes(rank), out)
    yield _pieces(out.astype(np.float64))


def node_counts(rank: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts of the tokens behind every digit."""
    out = np.zeros((DIGIT_ROWS, 16))
    for at, node, digit in digits(rank, classes(rank)):
        np.add.at(out.reshape(-1), (node & U(DIGIT_ROWS - 1)).astype(np.int64) * 16 + digit, count[at])
    return out


def _nodes(batches):
    out = np.zeros((DIGIT_ROWS, 16))
    for b in batches:
        out += node_counts(b.column("rank").to_numpy(), b.column("c").to_numpy() + 0.5)
    yield _pieces(out)


def _gradient(weights: np.ndarray, bias: np.ndarray, of_bits: np.ndarray, own: np.ndarray):
    table = of_bits.ravel() if of_bits.any() else np.zeros(0, np.float32)

    def run(batches):
        seen, expected = (np.zeros((BUCKETS + DIGIT_ROWS, HEAD + TAIL)) for _ in range(2))
        for _, rank, context, _ in _unpacked(batches):
            rows, cls = (context % U(BUCKETS)).astype(np.int32), classes(rank)
            add_seen(rows, cls, seen[:BUCKETS])
            add_expected(weights, bias, rows, expected[:BUCKETS])
            for _, cells, node, digit in _digit_rows(rank, cls, context):
                add_seen(cells >> 4, digit, seen[BUCKETS:])
                add_expected_bits(table, own.ravel(), cells, node, digit, expected[BUCKETS:].reshape(-1))
        yield _pieces(seen, expected)
    return run


def _total(table: pa.Table) -> pa.Table:
    """One piece summed, always in the order of the tasks."""
    table = table.sort_by("part")
    out = [sum(np.frombuffer(x.as_py(), np.float64) for x in table.column(c)).tobytes() for c in table.column_names[2:]]
    return pa.Table.from_arrays([table.column("piece")[:1], table.column("part")[:1], *[pa.array([x], pa.binary()) for x in out]], table.column_names)


def _summed(rows: DataFrame, tasks: int, fn, names: list[str], size: int) -> list[np.ndarray]:
    """Tables of ``size`` rows of weights, summed over all tasks: first over
    64 groups of tasks, then over these."""
    schema = "piece int, part int, " + ", ".join(f"{n} binary" for n in names)
    parts = rows.coalesce(tasks).mapInArrow(fn, schema)
    parts = parts.groupBy("piece", F.pmod("part", F.lit(64))).applyInArrow(lambda t: _total(t), schema)
    rows = parts.groupBy("piece").applyInArrow(lambda t: _total(t), schema).collect()
    rows.sort(key=lambda r: r["piece"])
    return [np.frombuffer(b"".join(r[n] for r in rows), np.float64).reshape(size, HEAD + TAIL) if rows else np.zeros((size, HEAD + TAIL)) for n in names]


def _score(weights: np.ndarray, bias: np.ndarray, of_bits: np.ndarray, own: np.ndarray):
    def run(batches):
        for b, rank, context, first in _unpacked(batches):
            rows, cls, log = (context % U(BUCKETS)).astype(np.int32), classes(rank), np.empty(len(rank))
            for i in range(0, len(cls), BATCH):
                p = probabilities(weights, bias, rows[:, i:i + BATCH])
                log[i:i + BATCH] = np.log10(p[np.arange(len(p)), cls[i:i + BATCH]])
            for at, cells, node, digit in _digit_rows(rank, cls, context):
                for i in range(0, len(at), BATCH):
                    below = np.float32(1)                  # one by the probability of the four bits
                    for _, x, bit in odds(of_bits.ravel(), own.ravel(), cells[:, i:i + BATCH], node[i:i + BATCH], digit[i:i + BATCH]):
                        below = below * (1 + np.exp(np.where(bit, -x, x)))
                    log[at[i:i + BATCH]] -= np.log10(below)
            score = np.add.reduceat(log, first[:-1]) if b.num_rows else np.zeros(0)
            keep = [c for c in b.schema.names if c not in ("low", "high")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], [*keep, "score"])
    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    of every row: its whole text scored by a unigram model (``base_score``)
    and by the maximum-entropy model (``score``), both log10 probabilities
    learnt from all rows that are not held out.

    ``held_out`` is a boolean column of ``docs`` (default: a fifth of the
    ids, by a hash; a null counts as training). Null and empty texts are
    their end token alone. Null ids are kept, rows that repeat are learnt and
    scored each on their own, other columns are ignored; an empty table
    gives no rows, and without training rows every ``base_score`` is 0.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    by_hash = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                       F.coalesce(by_hash if held_out is None else held_out, F.lit(False)).alias("held"))
    encoded, listed = staged_by(rows.mapInArrow(_encode, f"kind int, block long, i int, doc_id {kind}, held_out boolean, low binary, mid binary, high binary,"
                                                " word binary, n long"), "kind", (ENCODED, LISTED), "lm-encoded", "zstd")
    count = staged(listed.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    # ranks by count: places inside the sorted partitions, and the rows of the partitions before
    part = F.spark_partition_id()
    placed = staged(count.where("c > 0").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("c").desc(), "word")
                    .sortWithinPartitions(F.col("c").desc(), "word")
                    .select("word", "c", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("place")), "lm-ranks")
    dropped(count)
    ranked = (placed.join(F.broadcast(offsets(placed, [], F.lit(1), "before")), "part")
              .select("word", "c", (F.col("place") + F.col("before")).alias("rank")))
    of_class = F.least("rank", F.lit(HEAD)) + sum((F.col("rank") >= int(r)).cast("long") for r in FIRST[1:])
    of_classes = {r["class"]: (r["c"], r["v"]) for r in ranked.groupBy(of_class.alias("class")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    total, distinct = sum(c for c, _ in of_classes.values()), sum(v for _, v in of_classes.values())

    found = staged(listed.select("block", "i", "word").join(ranked, "word", "left")
                   .select(F.col("block").alias("of_block"), "i", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("rank", F.lit(distinct)).alias("rank")), "lm-found", "zstd")
    dropped(listed)
    texts = encoded.select("block", "i", "doc_id", "held_out", "low", "mid", "high")
    coded = staged(texts.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(
        _code(total, distinct), f"block long, i int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double,"
        " low binary, high binary"), "lm-coded", "zstd")
    for done in (encoded, found):
        dropped(done)

    prior = (np.array([of_classes.get(k, (0, 0))[0] for k in range(HEAD + TAIL)]) + 0.5) / (total + 0.5 * (HEAD + TAIL))
    bias = np.log(prior).astype(np.float32)
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_TOKENS)
    behind, = _summed(ranked.select("rank", "c"), spark.sparkContext.defaultParallelism, _nodes, ["seen"], DIGIT_ROWS)
    behind = behind + node_counts(np.array([distinct]), np.array([0.5])) + 0.5
    zero, one = bit_counts(behind)
    own = np.zeros((DIGIT_ROWS, 16), np.float32)
    own[:, 1:] = np.log(one / zero)
    train = coded.where("not held_out")
    seen, = _summed(train.select("low", "high"), tasks, _count, ["seen"], BUCKETS)
    weights, of_bits = start_weights(seen, prior), np.zeros((DIGIT_ROWS, 16), np.float32)
    for k in range(ROUNDS):                       # every training text has its part in one round
        share = train.where(F.pmod(F.xxhash64("block", "i"), F.lit(ROUNDS)) == k).select("low", "high")
        seen, expected = _summed(share, tasks, _gradient(weights, bias, of_bits, own), ["seen", "expected"], BUCKETS + DIGIT_ROWS)
        weights, of_bits = updated(weights, seen[:BUCKETS], expected[:BUCKETS]), updated_bits(of_bits, seen[BUCKETS:], expected[BUCKETS:])
    scored = coded.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "low", "high") \
        .mapInArrow(_score(weights, bias, of_bits, own), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
