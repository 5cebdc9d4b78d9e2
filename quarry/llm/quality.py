"""Quality scores by co-training.

Two classifiers see different views of a document: its text content (words,
and shares of letters, marks and repetitions) and its page metadata
(language, source, length, lines). Both start from the labelled documents.
In every round each labels the unlabelled documents it is most certain of
and hands them to the other one. In the end each view's score is calibrated
on labelled documents that no fit has seen, and a small logistic model over
both calibrated views scores all documents.

Fitting uses a bounded sample (``labelled`` and ``pool`` documents with the
smallest id hashes, parameters below); vocabularies are exact word hashes of
that sample. Scoring covers every document and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.textbytes import U, chunks, mix, text_buffer, words

LABELLED, POOL = 6000, 2000     # documents that the fit may use
ROUNDS, HANDED, CERTAIN = 2, 600, 0.97
STEMS = (4, 5)                  # first bytes of longer words
LEAST_DOCS = 4                  # a word of the vocabulary occurs in as many sample documents
_BYTE = np.arange(256)
_MARKS = ((_BYTE > 32) & (_BYTE < 48)) | ((_BYTE > 57) & (_BYTE < 65)) | ((_BYTE > 90) & (_BYTE < 97)) | ((_BYTE > 122) & (_BYTE < 127))
_BETWEEN = _MARKS | (_BYTE <= 32) | (_BYTE == 127)
_CLASSES = (
    (_BYTE >= 65) & (_BYTE <= 90),                                           # upper case
    ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128),                       # other letters
    (_BYTE >= 48) & (_BYTE <= 57),                                           # digits
    _MARKS & ~np.isin(_BYTE, [ord(c) for c in ".,;:'\"?!()-"]),              # marks that prose rarely has
    np.isin(_BYTE, [ord(c) for c in "!?"]),
    _BYTE == 10,
)


def _shares(x: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    s = x / np.maximum(total, 1)
    return [s, np.log(s + 1e-3)]


def text_view(buf: np.ndarray, off: np.ndarray):
    """(distinct hashes of words and their stems, offsets, statistics)."""
    n = len(off) - 1
    w, wo, stems, stem_row = words(buf, off, _BETWEEN, STEMS)
    count = np.diff(wo)
    row = np.repeat(np.arange(n), count)
    ws, distinct = _distinct(w, row, n)
    ss, stem_distinct = _distinct(stems, stem_row, n)
    twice = np.zeros(len(w))
    if len(w) > 1:
        twice[1:] = (w[1:] == w[:-1]) & (row[1:] == row[:-1])
    again = np.bincount(row, weights=twice, minlength=n)
    size = np.diff(off).astype(np.float64)
    of = []
    for c in _CLASSES:
        total = np.concatenate([[0], np.cumsum(c[buf])])
        of.append((total[off[1:]] - total[off[:-1]]).astype(np.float64))
    letters = of[0] + of[1]
    stats = [np.log1p(size), np.log1p(count), *_shares(of[0], letters), *_shares(of[2], size), *_shares(of[3], size), *_shares(of[4], size),
             *_shares(again, count), *_shares(distinct, count), letters / np.maximum(count, 1), letters / np.maximum(size, 1),
             np.log1p(of[5]), (count == 0) * 1.0]
    both = np.concatenate([ws, ss])
    order = np.argsort(np.concatenate([np.repeat(np.arange(n), distinct), np.repeat(np.arange(n), stem_distinct)]), kind="stable")
    return both[order], np.concatenate([[0], np.cumsum(distinct + stem_distinct)]), np.stack(stats, axis=1)


def _distinct(h: np.ndarray, row: np.ndarray, n: int):
    """Distinct hashes of every row, and their numbers."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=n)


def page_view(lang, source, n_chars, lines: np.ndarray, size: np.ndarray):
    """(hashes of the categorical values, offsets, statistics)."""
    parts = []
    for i, col in enumerate((lang, source)):
        buf, off = text_buffer(col.cast(pa.string()))
        total = np.concatenate([[U(0)], np.cumsum(mix(buf.astype(np.uint64) * U(0x9E3779B97F4A7C15) + np.arange(len(buf), dtype=np.uint64)
                                                      - np.repeat(off[:-1], np.diff(off)).astype(np.uint64)))])
        parts.append(mix(total[off[1:]] - total[off[:-1]] + U(i + 1)))
    chars = np.nan_to_num(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)
    stats = [np.log1p(np.maximum(chars, 0)), np.log1p(np.maximum(chars, 0)) ** 2, np.log1p(lines), np.log1p(chars.clip(0) / (lines + 1)),
             size / np.maximum(chars, 1), (chars <= 0) * 1.0]
    return np.stack(parts, axis=1).ravel(), np.arange(0, 2 * len(size) + 1, 2), np.stack(stats, axis=1)


def views(text, lang, source, n_chars):
    """Both views of a batch of Arrow columns, in chunks of about a megabyte."""
    buf, off = text_buffer(text)
    for i, j in chunks(off):
        o = off[i:j + 1] - off[i]
        piece = buf[off[i]:off[j]]
        ends = np.concatenate([[0], np.cumsum(piece == 10)])
        yield (text_view(piece, o),
               page_view(lang.slice(i, j - i), source.slice(i, j - i), n_chars.slice(i, j - i), (ends[o[1:]] - ends[o[:-1]]).astype(float),
                         np.diff(o).astype(float)))


@dataclass
class Model:
    """Sparse logistic model: word weights, standardised statistics."""

    vocab: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, hashes, offsets, stats) -> np.ndarray:
        z = _standard(stats, self.mean, self.scale) @ self.dense + self.bias
        if len(self.vocab) and len(hashes):
            at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
            hit = self.vocab[at] == hashes
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            z = z + np.bincount(row[hit], weights=self.weights[at[hit]], minlength=len(z))
        return z


def _standard(stats, mean, scale):
    return np.clip((stats - mean) / scale, -4, 4)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class View:
    """One view of the sample: words that ``LEAST_DOCS`` of its documents
    have, as columns, and the statistics."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, stats: np.ndarray):
        self.n, self.stats = len(stats), stats
        order = np.argsort(hashes, kind="stable")
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[order][1:] != hashes[order][:-1]
        start = np.flatnonzero(new)
        often = np.diff(np.append(start, len(hashes))) >= LEAST_DOCS
        self.vocab = hashes[order[start[often]]]
        number = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        col = np.empty(len(hashes), dtype=np.int32)
        col[order] = np.repeat(number, np.diff(np.append(start, len(hashes))))
        row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(offsets))
        self.row, self.col = row[col >= 0].astype(np.intp), col[col >= 0].astype(np.intp)

    def product(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.col], minlength=self.n)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=r[self.row], minlength=len(self.vocab))


def fit(view: View, used: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, l1: float = 4e-4, l2: float = 1e-4, steps: int = 150):
    """(model, logits of the sample, coefficients): logistic regression on
    the rows ``used`` by accelerated proximal gradient steps; word weights are
    L1-penalised, so words without evidence weigh nothing."""
    n, f = used.sum(), len(view.vocab)
    mean, scale = view.stats[used].mean(axis=0), view.stats[used].std(axis=0) + 1e-6
    x = _standard(view.stats, mean, scale)
    share = (y[used].mean() + 1e-3) / (1 - y[used].mean() + 1e-3)
    theta = np.append(np.zeros(f + x.shape[1]), np.log(share)) if start is None else start.copy()
    target = np.where(used, y, 0.0)

    def forward(t):
        return view.product(t[:f]) + x @ t[f:-1] + t[-1]

    def back(r):
        return np.concatenate([view.transposed(r), x.T @ r, [r.sum()]]) / n
    v = np.ones_like(theta)                  # the largest curvature, by power iterations
    for _ in range(8):
        g = back(np.where(used, forward(v), 0.0))
        top = np.linalg.norm(g)
        v = g / max(top, 1e-12)
    step = 1 / (0.25 * max(top, 1e-9) * 1.1 + l2)
    prev, ahead, t = theta.copy(), theta.copy(), 1.0
    for _ in range(steps):
        g = back(np.where(used, _sigmoid(forward(ahead)) - target, 0.0))
        g[f:-1] += l2 * ahead[f:-1]
        theta = ahead - step * g
        theta[:f] = np.sign(theta[:f]) * np.maximum(np.abs(theta[:f]) - step * l1, 0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, prev, t = theta + (t - 1) / nxt * (theta - prev), theta, nxt
    some = theta[:f] != 0
    return Model(view.vocab[some], theta[:f][some], mean, scale, theta[f:-1], float(theta[-1])), forward(theta), theta


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Weights and bias of a small logistic model (Newton steps)."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = _sigmoid(a @ w)
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + l2 * w)
    return w


@dataclass
class CoTrained:
    text: Model
    page: Model
    calibration: list
    mixture: np.ndarray

    def score(self, text, lang, source, n_chars) -> np.ndarray:
        """[row, 3]: calibrated probabilities by text, by page, and by both."""
        out = []
        for t, p in views(text, lang, source, n_chars):
            z = np.stack([a * v + b for (a, b), v in zip(self.calibration, (self.text.logits(*t), self.page.logits(*p)), strict=True)], axis=1)
            both = np.clip(z, -12, 12) @ self.mixture[:-1] + self.mixture[-1]
            out.append(_sigmoid(np.concatenate([z, both[:, None]], axis=1)))
        return np.concatenate(out) if out else np.zeros((0, 3))


def co_train(text: View, page: View, y: np.ndarray, held: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED, certain: float = CERTAIN):
    """The combined model and how many labels were handed over. ``y`` is 1, 0
    or nan (no label); ``held`` rows are kept for calibration."""
    known = ~np.isnan(y) & ~held
    pool = np.flatnonzero(np.isnan(y))
    hold = np.flatnonzero(held & ~np.isnan(y))
    labels = [np.where(known, y, np.nan) for _ in range(2)]
    passed, starts = 0, [None, None]
    for turn in range(rounds + 1):
        models, logits, calibration = [], [], []
        for k, view in enumerate((text, page)):
            used = ~np.isnan(labels[k])
            m, z, starts[k] = fit(view, used, np.where(used, labels[k], 0.0), starts[k], steps=150 if turn == 0 else 60)
            models.append(m)
            logits.append(z)
            calibration.append(tuple(logistic(z[hold, None], y[hold])) if len(hold) else (1.0, 0.0))
        if turn == rounds or not len(pool):
            break
        for k in range(2):
            p = _sigmoid(calibration[k][0] * logits[k][pool] + calibration[k][1])
            other = labels[1 - k]
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:handed]
                best = pool[best[sure[best] >= certain]]
                best = best[np.isnan(other[best])]
                other[best] = label
                passed += len(best)
    z = np.stack([np.clip(a * v + b, -12, 12) for (a, b), v in zip(calibration, logits, strict=True)], axis=1)
    mixture = logistic(z[hold], y[hold], l2=1.0) if len(hold) else np.array([1.0, 0.0, 0.0])
    return CoTrained(models[0], models[1], calibration, mixture), passed


def _features(batches):
    for b in batches:
        at = 0
        for t, p in views(b.column("text"), b.column("lang"), b.column("source"), b.column("n_chars")):
            n = len(t[2])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(at, n), b.column("y").slice(at, n),
                 *(pa.ListArray.from_arrays(pa.array(v[1], pa.int32()), pa.array(v[0].view(np.int64))) for v in (t, p)),
                 *(pa.array(list(v[2]), pa.list_(pa.float64())) for v in (t, p))], ["id", "y", "tw", "pw", "ts", "ps"])
            at += n


def _view(rows: pa.Table, words_col: str, stats_col: str) -> View:
    hashes, stats = (rows.column(c).combine_chunks() for c in (words_col, stats_col))
    offsets = np.asarray(hashes.offsets).astype(np.int64)
    return View(hashes.flatten().to_numpy().view(np.uint64), offsets - offsets[0], stats.flatten().to_numpy().reshape(len(rows), -1))


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source", chars_col: str = "n_chars", **settings) -> CoTrained | None:
    """The co-trained model, or None when the sample lacks one of the
    classes. A document is good when its quality is 1 and it is not toxic;
    of repeated labels the worst counts, a null quality is no label. At most
    ``labelled`` + ``pool`` documents are collected, one row for each id."""
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
             .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
             .select("id", F.expr("cast(quality = 1 and toxic = 0 as double)").alias("y")))
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null")
    chosen = marks.where("y is not null").join(ids, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(labelled)
    others = (ids.join(marks, "id", "left_anti").orderBy(F.xxhash64("id"), "id").limit(pool).distinct()
              .withColumn("y", F.lit(None).cast("double")))
    sample = F.broadcast(chosen.unionByName(others))              # bounded by the two parameters
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                        F.col(source_col).alias("source"), F.col(chars_col).cast("long").alias("n_chars"))
            .join(sample, "id").dropDuplicates(["id"]))
    kind = docs.schema[id_col].dataType.simpleString()
    sampled = (rows.select("id", "y", "text", "lang", "source", "n_chars")
               .mapInArrow(_features, f"id {kind}, y double, tw array<long>, pw array<long>, ts array<double>, ps array<double>").toArrow())
    sampled = sampled.sort_by("id")
    y = sampled.column("y").to_numpy().astype(np.float64)
    if len(np.unique(y[~np.isnan(y)])) < 2:
        return None
    order = np.cumsum(~np.isnan(y))
    held = ~np.isnan(y) & (order % 5 == 0)
    train = y[~np.isnan(y) & ~held]
    if len(np.unique(train)) < 2 or len(np.unique(y[held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    text, page = _view(sampled, "tw", "ts"), _view(sampled, "pw", "ps")
    del sampled
    return co_train(text, page, y, held, **settings)[0]


def score_quality(docs: DataFrame, model: CoTrained | None, text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, with ``p_text``,
    ``p_page`` and ``p_good``.

    Null and empty texts and null metadata are scored like any other value;
    rows that repeat get equal scores; columns with clashing names stay in
    ``row``; an empty table gives no rows; without a model (no labels of one
    class) every document scores 1.
    """
    if model is None:
        return docs.select(F.struct("*").alias("row"), *[F.lit(1.0).alias(c) for c in ("p_text", "p_page", "p_good")])

    @F.arrow_udf("struct<p_text: double, p_page: double, p_good: double>")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        p = model.score(text, lang, source, n_chars)
        return pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(3)], ["p_text", "p_page", "p_good"])
    return (docs.select(F.struct("*").alias("row"))
            .withColumn("s", score(*[F.col(f"row.{c}").cast("string") for c in (text_col, lang_col, source_col)],
                                   F.col(f"row.{chars_col}").cast("long")))
            .select("row", "s.p_text", "s.p_page", "s.p_good"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **columns) -> DataFrame:
    """The rows of ``docs``, with their own columns, that score at least
    ``least``. Null and empty texts, null metadata and null ids are scored
    like other values and stay or go by their score; rows that repeat go or
    stay together; without a model every row stays, an empty table is empty.
    """
    names = {k: v for k, v in columns.items() if k in ("text_col", "lang_col", "source_col", "chars_col")}
    return score_quality(docs, fit_quality(docs, labels, **columns), **names).where(F.col("p_good") >= least).select("row.*")
