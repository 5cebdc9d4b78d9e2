import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import SF_MID, SF_SMALL

from quarry.llm import packing as P

SCHEMA = "doc_id long, text string, part int, number string"


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.tokenizer_path())


@given(st.lists(st.sampled_from(["a", "foo", "'s", "s", " ", "  ", "\n", "\t", ".", ",", "é", "1", "<|endoftext|>", " ", "\r", "ß", "!!", "日本", "\0"]), max_size=14))
@settings(max_examples=400, deadline=None)
def test_word_cache_equals_the_tokenizer(parts):
    enc = P._encoder(None)
    text = "".join(parts)
    want = np.array(enc.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert enc([text]) == [want]


def test_memory_overflow(encoder, monkeypatch):
    from quarry.llm import atoms
    monkeypatch.setattr(atoms, "MEMORY", 10)
    texts = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(5)] + ["", "x <|endoftext|> y<|endoftext|>\n z"]
    want = [np.array(encoder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [encoder([t])[0] for t in texts] == encoder(texts) == want


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (11, [(0, 3), (3, 4), (7, 4)])])
def test_cut(n, want):
    assert [(a, b) for _, _, a, b in zip(*(x.tolist() for x in P.cut(np.array([n]), 4)))] == want


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(0, 40))
@settings(max_examples=300, deadline=None)
def test_fullest_is_the_best_subset_sum(counts, room):
    table = [0] * 41
    for k, n in counts.items():
        table[k] = n
    used = P.fullest(table, room)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
    assert all(n <= table[k] for k, n in used.items())


def test_plan_takes_every_piece_once():
    random.seed(1)
    histogram = {k: random.randint(1, 50) for k in random.sample(range(1, 300), 200)}
    plan = P.plan_bins(histogram, 1024)
    total = {}
    for used, times in plan:
        assert sum(k * n for k, n in used.items()) <= 1024
        for k, n in used.items():
            total[k] = total.get(k, 0) + n * times
    assert total == histogram
    assert sum(t for _, t in plan) <= 1.02 * -(-sum(k * n for k, n in histogram.items()) // 1024) + 1


def check(rows, texts, tok, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, t in texts.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == [(a, b) for _, _, a, b in zip(*(x.tolist() for x in P.cut(np.array([len(ids)]), capacity)))]
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_pack_documents(spark, tok):
    from quarry.llm.catalog import QUERIES
    rows = QUERIES["op8_minimum_bin_slack"](spark, SF_MID).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    bins, least = check(rows, texts, tok, 1024)
    assert bins <= 1.01 * least + 1


def test_hard_cases(spark, tok):
    data = [(1, None, 0, "x"), (2, "", 0, "x"), (3, "word " * 5000, 1, None), (None, "no id", 1, "y"), (5, " \n a  b", 2, "z"), (6, "same", 3, ""), (7, "same", 3, "")]
    df = spark.createDataFrame(data, SCHEMA)
    rows = P.pack(df, capacity=64).collect()
    check(rows, {r[0]: r[1] for r in data}, tok, 64)
    twice = P.pack(df.union(df), capacity=64, with_ids=True).collect()
    assert len(twice) == 2 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert all(len(r.ids) == r.length for r in twice)
    assert P.pack(df.limit(0)).count() == 0


def test_small_table(spark, tok):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check(P.pack(df.repartition(3), capacity=100).collect(), {r.doc_id: r.text for r in df.collect()}, tok, 100)
