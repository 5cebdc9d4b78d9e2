"""Fill-in-middle transformation: two random cuts at word ends turn a text
into prefix, middle and suffix, and the parts change places.

A unit is the white space before a word and the word; white space at the end
of a text is a unit of its own. All texts of a batch lie in one buffer of
64-bit words (each text padded with blanks to a whole number of them), and
the bytes of a word are treated at once: additions that cannot carry between
bytes mark white space, a shift marks the bytes that end a unit, and
``bitwise_count`` gives the marks of each word. A cut after the r-th unit
searches the running counts for its word and selects the byte inside it by a
multiplication that sums the marks of all bytes before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.textbytes import chunks, text_buffer

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
# The marks before prefix, suffix and middle.
P_MARK, S_MARK, M_MARK = "<P>", "<S>", "<M>"

U = np.uint64
ONES, HIGH, LOW = U(0x0101010101010101), U(0x8080808080808080), U(0x7F7F7F7F7F7F7F7F)
BLANK = U(0x2020202020202020)


def space_marks(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or 0x09 to 0x0D."""
    low, other = x & LOW, x ^ BLANK
    control = (low + U(0x77) * ONES) & ~(low + U(0x72) * ONES)      # from 9 on, and not from 14 on
    return ((control & ~x) | ~(((other & LOW) + LOW) | other)) & HIGH


def unit_ends(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte behind which a word ends: no white space,
    and white space next (texts end in a blank of padding)."""
    space = space_marks(x)
    after = space >> U(8)
    after[:-1] |= space[1:] << U(56)
    after[-1:] |= U(1 << 63)
    return ~space & after & HIGH


def inner_marks(x: np.ndarray) -> np.ndarray:
    """The high bit of every byte 0x80 to 0xBF, which begins no character."""
    return x & ~(x << U(1)) & HIGH


def select(mark: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The place (0 to 7) of the r-th marked byte of each word, r from 1."""
    upto = (mark >> U(7)) * ONES                                      # marks up to and with each byte
    return np.bitwise_count(~((upto | HIGH) - r.astype(U) * ONES) & HIGH).astype(np.int64)


class Units:
    """The units of many texts; ``off`` are the offsets of their bytes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.size = np.diff(off)
        words = self.size // 8 + 1                                    # one blank behind each text at least
        self.first = np.concatenate([[0], np.cumsum(words)])
        padded = np.full(8 * self.first[-1], 0x20, np.uint8)
        to = np.repeat(8 * self.first[:-1] - off[:-1], self.size) + np.arange(off[0], off[-1])
        padded[to] = buf[off[0]:off[-1]]
        self.words = padded.view("<u8")
        self.ends = unit_ends(self.words)
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)])
        self.inner = np.concatenate([[0], np.cumsum(np.bitwise_count(inner_marks(self.words)), dtype=np.int64)])
        whole = self.upto[self.first[1:]] - self.upto[self.first[:-1]]
        last = padded[8 * self.first[:-1] + np.maximum(self.size - 1, 0)]
        tail = (self.size > 0) & ((last == 0x20) | ((last >= 9) & (last <= 13)))
        self.n = whole + tail

    def cut(self, r: np.ndarray) -> np.ndarray:
        """Bytes of each text's first ``r`` units (0 <= r <= n)."""
        inside = (r > 0) & (r < self.n)
        i = np.flatnonzero(inside)
        rank = self.upto[self.first[i]] + r[i]
        word = np.searchsorted(self.upto, rank, side="left") - 1
        place = select(self.ends[word], rank - self.upto[word])
        out = np.where(r > 0, self.size, 0)
        out[i] = 8 * (word - self.first[i]) + place + 1
        return out

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Characters of each text's first ``at`` bytes."""
        word, rest = self.first[:-1] + at // 8, at % 8
        mask = np.where(rest > 0, (U(1) << (U(8) * rest.astype(U))) - U(1), U(0))
        return at - (self.inner[word] - self.inner[self.first[:-1]]) - np.bitwise_count(inner_marks(self.words[word]) & mask)


def _draw(i: int, seed: int) -> Column:
    """Unsigned integer of the i-th 8 hexadecimal digits of a row's hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("long")


def _arrange(fim_percent: int, spm_percent: int):
    p, s, m = (x.encode() for x in (P_MARK, S_MARK, M_MARK))

    def rows(b: pa.RecordBatch, i: int, j: int, buf, off) -> pa.RecordBatch:
        u = Units(buf, off[i:j + 1])
        h1, h2, h3, h4 = (b.column(f"h{k}").to_numpy()[i:j] for k in (1, 2, 3, 4))
        a, z = h1 % (u.n + 1), h2 % (u.n + 1)
        a, z = u.cut(np.minimum(a, z)), u.cut(np.maximum(a, z))
        ca, cz = u.chars(a), u.chars(z)
        form, prefix, middle, out = [], [], [], []
        for k in range(j - i):
            t = buf[off[i + k]:off[i + k + 1]].tobytes()
            if not t or p in t or s in t or m in t or h3[k] % 100 >= fim_percent:
                form.append("plain")
                prefix.append(None)
                middle.append(None)
                out.append(t)
                continue
            x, y = int(a[k]), int(z[k])
            spm = h4[k] % 100 < spm_percent
            form.append("spm" if spm else "psm")
            prefix.append(int(ca[k]))
            middle.append(int(cz[k] - ca[k]))
            out.append(b"".join((s, t[y:], p, t[:x], m, t[x:y]) if spm else (p, t[:x], s, t[y:], m, t[x:y])))
        return pa.RecordBatch.from_arrays(
            [b.column("id").slice(i, j - i), pa.array(u.n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
             pa.array(middle, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column("text"))
            for i, j in chunks(off):
                yield rows(b, i, j, buf, off)
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``n`` are the units of the text, ``output`` is what a model is trained
    on: the text itself (form ``plain``), or marks and parts in the order
    prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``). The
    draws are a hash of ``seed`` and the id alone, so a row that is computed
    again after a lost executor comes out the same, and rows of one id share
    their draws. A null id draws as an empty one. Null and empty texts, and
    texts that hold a mark, are plain, with null ``prefix_chars`` and
    ``middle_chars``. Texts of any length are cut as a whole; other columns
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.select("id", "text", *[_draw(i, seed).alias(f"h{i + 1}") for i in range(4)])
    return (rows.mapInArrow(_arrange(fim_percent, spm_percent), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
            .withColumn("output", F.col("output").cast("string")))


def restore(output: Column, form: Column) -> Column:
    """The text from output and form alone: the parts between the marks, in
    their old order."""
    def between(left: str, right: str | None) -> Column:
        rest = F.substring_index(output, left, -1)
        return F.substring_index(rest, right, 1) if right else rest
    psm = F.concat(between(P_MARK, S_MARK), between(M_MARK, None), between(S_MARK, M_MARK))
    spm = F.concat(between(P_MARK, M_MARK), between(M_MARK, None), between(S_MARK, P_MARK))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
