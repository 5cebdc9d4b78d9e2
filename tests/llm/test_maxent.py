import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import SF_MID

from quarry.llm import maxent as M
from quarry.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def base_way(rows):
    """(held out, tokens, known, training tokens, base score) of every row."""
    toks = [[*WORD.findall((t or "").translate(UPPER)), ""] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for ws, h in zip(toks, held)]


PART = st.sampled_from(["a", "B", "aé", "É", " ", "\n", "\x0b", "\x1f", "word", "WORD", "", "日本", "\0"])


@given(st.lists(st.lists(PART, max_size=12).map("".join), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_tokens_equal_the_pattern(texts):
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)]) + 2
    number, words, first = M.tokens(np.frombuffer(b"xy" + b"".join(data), np.uint8), off)
    words = [w.decode() for w in words.to_pylist()]
    got = [[words[k] for k in number[a:b]] for a, b in zip(first[:-1], first[1:])]
    assert got == [[*WORD.findall(t.translate(UPPER)), ""] for t in texts]
    assert len(set(words)) == len(words)


def test_features_stay_inside_their_text():
    word = np.array([5, 6, 7, 5, 6, 9], np.uint64)
    f = M.features(word, np.array([0, 3, 6]))
    assert f.shape == (3, 6) and (f[:, 0] == f[:, 3]).all() and (f[:, 1] == f[:, 4]).all() and (f[:, 2] == f[:, 5]).all()
    assert (f[0, 1:3] != f[0, 0]).all() and f.max() < M.BUCKETS


def test_expected_counts_are_sums_of_probabilities():
    rng = np.random.default_rng(1)
    k = M.HEAD + M.TAIL
    w, bias = rng.normal(size=(M.BUCKETS, k)).astype(np.float32), rng.normal(size=k).astype(np.float32)
    rows = rng.integers(0, 50, (3, 500)).astype(np.int32)
    out, want = np.zeros((M.BUCKETS, k)), np.zeros((M.BUCKETS, k))
    M.add_expected(w, bias, rows, out)
    for t in range(500):
        x = np.exp(sum(w[r[t]].astype(float) for r in rows) + bias)
        for r in rows:
            want[r[t]] += x / x.sum()
    assert np.allclose(out, want, rtol=1e-4)
    seen = np.zeros((M.BUCKETS, k), np.int64)
    cls = rng.integers(0, k, 500)
    M.add_seen(rows, cls, seen)
    assert seen.sum() == 1500 and seen[rows[2, 7], cls[7]] > 0


def test_every_case_has_a_base_score(spark):
    texts = [None, "", "  \n", "The cat sat", "the CAT ran", "unseen " * 300, "É é É", "a\x0bb\x1fc", "same words", "same words"]
    rows = [(i, t) for i, t in enumerate(texts * 6)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, n_tokens int, score double").repartition(4)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in M.score_texts(df).collect()), key=repr)
    assert got == sorted(((i, *x[:4], round(x[4], 6)) for (i, _), x in zip(rows, base_way(rows))), key=repr)
    assert M.score_texts(df.limit(0)).collect() == []
    none = M.score_texts(df.where("doc_id = 1"), held_out=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in none)


def test_probabilities_of_all_tokens_sum_to_one(spark):
    """Every next token of a context, and one unseen token per class."""
    train = [(0, "a b c d e f g h a b c d e f g h i j k l m n o p q r s t u v w x y z a a b b c c d d")]
    vocabulary = sorted({w for _, t in train for w in t.split()})
    ends = [(k + 1, f"a b {w}") for k, w in enumerate(vocabulary)] + [(100, "a b")]
    df = spark.createDataFrame(train + ends, "doc_id long, text string")
    held = M.score_texts(df, held_out=F.col("doc_id") > 0).where("held_out").collect()
    score = {r.doc_id: r.score for r in held}
    # "a b" + end against "a b w" + end: the share of w's alternatives at the third place is below one, and so is any sum of texts
    assert sum(10 ** s for s in score.values()) < 1
    assert all(math.isfinite(s) and s < 0 for s in score.values())


def test_no_two_tokens_share_a_code():
    rank = np.arange(5000)
    cls = M.classes(rank)
    codes = [[int(c)] for c in cls]
    for at, _, digit in M.digits(rank, cls):
        for i, d in zip(at, digit):
            codes[i].append(int(d))
    assert len({tuple(c) for c in codes}) == len(rank) and cls.max() == M.HEAD + 3 and (np.diff(cls.astype(int)) >= 0).all()
    assert [len(codes[r]) for r in (0, 7, 8, 23, 24, 279, 280, 4375, 4376)] == [1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_four_bits_of_a_digit_are_one_distribution():
    """The sixteen digits of a context sum to one, their expected bits are the
    sums of these probabilities, and the digits' own counts are met exactly
    where no weight says otherwise."""
    rng = np.random.default_rng(2)
    w = rng.normal(size=M.DIGIT_ROWS * 16).astype(np.float32)
    count = rng.random((M.DIGIT_ROWS, 16)) + 0.1
    zero, one = M.bit_counts(count)
    own = np.zeros((M.DIGIT_ROWS, 16), np.float32)
    own[:, 1:] = np.log(one / zero)
    digit, cells = np.arange(16), np.repeat(np.array([[16], [160], [4096]]), 16, axis=1)
    node = np.full(16, 32)
    for weights in (w, w[:0]):
        p = np.ones(16)
        for _, x, bit in M.odds(weights, own.ravel(), cells, node, digit):
            p *= 1 / (1 + np.exp(np.where(bit, -x, x).astype(float)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-5)
    assert np.allclose(p, count[2] / count[2].sum(), rtol=1e-4)
    out, want = np.zeros(M.DIGIT_ROWS * 16), np.zeros(M.DIGIT_ROWS * 16)
    M.add_expected_bits(w, own.ravel(), cells, node, digit, out)
    for here, x, _ in M.odds(w, own.ravel(), cells, node, digit):
        for c in here:
            np.add.at(want, c, 1 / (1 + np.exp(-x.astype(float))))
    assert np.allclose(out, want, rtol=1e-4) and (out[[17, 161, 4097]] > 0).all() and out[[16, 160, 4096]].sum() == 0


def test_a_word_within_its_class_has_the_probability_of_its_context(spark):
    """Four words of one count in one class (x5, x12, x15 and x18 share one by hash, too), each after the same one every time."""
    often = [(k, f"w{i}") for k, i in enumerate(i for i in range(30) for _ in range(80))]
    train = often + [(10_000 + k, "x5 x12" if k % 2 else "x15 x18") for k in range(120)]
    held = [(-2, "x5 x12"), (-3, "x5 x18"), (-4, "x15 x18"), (-5, "x15 x12")]
    df = spark.createDataFrame(train + held, "doc_id long, text string").repartition(2)
    score = {r.doc_id: r.score for r in M.score_texts(df, held_out=F.col("doc_id") < 0).where("held_out").collect()}
    assert min(score[-2] - score[-3], score[-4] - score[-5]) > 0.25, score


@pytest.mark.parametrize("sf", [SF_MID])
def test_table_against_base_scores_and_held_out_gain(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i: x for (i, _), x in zip(rows, base_way(rows))}
    got = M.score_texts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
