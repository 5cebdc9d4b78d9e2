"""Benchmark passages in documents by spaced seeds, by DataFrame functions
only.

A text is its lower-cased words. A seed is a fixed mask that looks at some
positions of a window and ignores the others; the hashes of the seen words
are equal when test and training text agree there, whatever stands at the
ignored positions. The two masks below meet every window of 13 words in
which at most 2 words differ, so the join of test and training hashes loses
none. Around each hit the words are compared position by position: windows
with at most ``mismatches`` substitutions are overlaps.

Items of fewer than ``window`` words match as a whole and exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Every 2 mismatches in 13 leave one of these masks whole at some offset
# (tests/llm checks all of them).
MASKS = ((0, 1, 2, 3, 5, 6), (0, 2, 4, 8, 9, 10))
WINDOW, MISMATCHES = 13, 2
BLOCK_WORDS = 500_000      # benchmark words of one broadcast block
_WORD = r"[\p{L}\p{N}]+"


def sensitive(masks, window: int, mismatches: int) -> bool:
    """Whether the masks meet every window with that many mismatches."""
    from itertools import combinations
    return all(any(all(o + m not in bad for m in mask) for mask in masks for o in range(window - mask[-1]))
               for bad in combinations(range(window), mismatches))


def _words(text: str, extra: list) -> list:
    return [*extra, F.expr(f"transform(regexp_extract_all(lower({text}), r'{_WORD}', 0), w -> xxhash64(w))").alias("h")]


def _seeds(masks) -> str:
    """SQL: array of one hash per mask at position p of h, null beyond the end."""
    one = [f"if(p + {m[-1]} < size(h), xxhash64({i}, " + ", ".join(f"get(h, p + {o})" for o in m) + "), null)" for i, m in enumerate(masks)]
    return "array(" + ", ".join(one) + ")"


def _positions(df: DataFrame, masks) -> DataFrame:
    """One row for each position and mask, beside the other columns."""
    # a filter on h would go below its projection, and every text would be cut into words twice
    at = df.withColumn("p", F.expr("explode(if(size(h) > 0, sequence(0, size(h) - 1), cast(array() as array<int>)))"))
    return at.withColumn("seed", F.explode(F.expr(_seeds(masks)))).where("seed is not null")


def _windows(hits: DataFrame, masks, window: int, mismatches: int) -> DataFrame:
    """(key, item, start, stop): for each hit the windows through it that
    agree but for ``mismatches`` words, as one run of words."""
    low = min(m[-1] + 1 for m in masks) - window
    bits = " + ".join(f"if(get(h, p + {i}) = get(b, q + {i}), {1 << (i - low)}L, 0L)" for i in range(low, window))
    full = (1 << window) - 1
    good = [f"if(p + {s} >= 0 and q + {s} >= 0 and p + {s + window} <= size(h) and q + {s + window} <= size(b)"
            f" and bit_count(shiftright(bits, {s - low}) & {full}L) >= {window - mismatches}, {s}, null)" for s in range(low, 1)]
    # exploded, the comparison stays out of the condition of the join, whose code
    # would be too long to be compiled and is run for every position
    return (hits.withColumn("bits", F.expr(f"explode(array({bits}))"))
            .withColumn("first", F.expr("coalesce(" + ", ".join(good) + ")"))
            .withColumn("last", F.expr("coalesce(" + ", ".join(reversed(good)) + ")"))
            .where("first is not null")
            .select("key", "item", F.expr("p + first").alias("start"), F.expr(f"p + last + {window}").alias("stop")))


def overlaps(docs: DataFrame, bench: DataFrame, masks=MASKS, window: int = WINDOW, mismatches: int = MISMATCHES,
             block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, start, stop): documents (key: struct of id and text
    hash) that overlap a benchmark item, with the range of words (from 0)
    that all overlaps with this item span.

    Null and empty texts on either side overlap with nothing. Rows that
    repeat an id and a text are one document or item; a null id is an id like
    others. Other columns are ignored; without documents or items there are no rows.
    The benchmark is broadcast in blocks of about ``block_words`` words (as
    many as its counted size needs), against which all documents stream:
    document positions are never shuffled, and a passage that a third of all
    documents hold is aggregated where it is found.
    """
    if not sensitive(masks, window, mismatches):
        raise ValueError("these masks miss some windows")
    d = (docs.where(F.col(text_col).isNotNull())
         .select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")).alias("key"), F.col(text_col).alias("text"))
         .select(*_words("text", ["key"])))
    items = (bench.where(F.col(item_text).isNotNull())
             .select(F.struct(F.col(item_col).alias("id"), F.xxhash64(F.col(item_text)).alias("th")).alias("item"), F.col(item_text).alias("text"))
             .dropDuplicates(["item"]).select(*_words("text", ["item"])).where("size(h) > 0"))
    # a number, and at most window - 1 short lengths
    size = items.agg(F.sum(F.size("h")).alias("n"), F.collect_set(F.expr(f"if(size(h) < {window}, size(h), null)")).alias("short")).first()
    blocks = max(1, -(-(size.n or 0) // block_words))
    found = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        long = part.where(F.size("h") >= window)
        seeds = _positions(long, masks).select("seed", "item", F.col("p").alias("q"), F.col("h").alias("b"))
        found.append(_windows(_positions(d, masks).join(F.broadcast(seeds), "seed"), masks, window, mismatches))
        for n in sorted(size.short):
            mask = (tuple(range(n)),)
            seeds = _positions(part.where(F.size("h") == n), mask).select("seed", "item", F.col("p").alias("q"), F.col("h").alias("b"))
            found.append(_positions(d, mask).join(F.broadcast(seeds), "seed").where(f"slice(h, p + 1, {n}) = b")
                         .select("key", "item", F.col("p").alias("start"), F.expr(f"p + {n}").alias("stop")))
    hits = reduce(DataFrame.unionByName, found)
    return (hits.groupBy("key", "item").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
            .select("key", F.col("item.id").alias("item_id"), "start", "stop"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, with their own columns, whose texts overlap no
    benchmark item. Null and empty texts overlap with nothing and stay; rows
    that repeat an id (null included) and a text go or stay together; with an
    empty benchmark all rows stay.
    """
    bad = overlaps(docs, bench, id_col=id_col, text_col=text_col, **settings).select("key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")


def oracle(window: int = WINDOW, mismatches: int = MISMATCHES, docs: str = "documents") -> str:
    """DuckDB SQL: all equal words of all documents and items, no seeds."""
    starts = ", ".join(f"q - {i}" for i in range(mismatches + 1))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark),
bw AS (SELECT item_id, len(w) AS m, least(len(w), {window}) AS size, CASE WHEN len(w) < {window} THEN len(w) ELSE {window - mismatches} END AS need,
         unnest(w) AS word, unnest(range(len(w))) AS q FROM b),
dw AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
m AS (SELECT doc_id, item_id, p - q AS diag, q, n, m, size, need FROM dw JOIN bw USING (word)),
g AS (SELECT doc_id, item_id, diag FROM m GROUP BY doc_id, item_id, diag HAVING count(*) >= any_value(need)),
c AS (SELECT m.* FROM m JOIN g USING (doc_id, item_id, diag)),
s AS (SELECT DISTINCT doc_id, item_id, diag, n, m, size, need, unnest([{starts}]) AS s FROM c),
w AS (SELECT s.doc_id, s.item_id, s.diag, s.s, any_value(s.size) AS size FROM s JOIN c USING (doc_id, item_id, diag)
      WHERE s.s >= 0 AND s.s + s.size <= s.m AND s.s + s.diag >= 0 AND s.s + s.diag + s.size <= s.n AND c.q >= s.s AND c.q < s.s + s.size
      GROUP BY s.doc_id, s.item_id, s.diag, s.s HAVING count(*) >= any_value(s.need))
SELECT doc_id, item_id, CAST(min(s + diag) AS INT) AS start_word, CAST(max(s + diag + size) AS INT) AS stop_word
FROM w GROUP BY doc_id, item_id
"""
