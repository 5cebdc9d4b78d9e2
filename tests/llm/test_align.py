import hashlib
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SF_SMALL

from quarry.llm.align import Aligner, align_tokens
from quarry.llm.atoms import ByteBpe
from quarry.llm.common import table


@pytest.fixture(scope="module")
def both():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    al = Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    return a, b, al.a.bytes, al.b.bytes


def plain_way(both, rows):
    """Whole texts by the libraries, token by token."""
    a, b, a_bytes, b_bytes = both
    docs, count = [], Counter()
    for i, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        full = (" " + t).encode() if t else b""
        if b"".join(a_bytes[k] for k in x) != full or b"".join(b_bytes[k] for k in y) != full:
            x, y = [], []
        spans = []
        for ids, table_ in ((x, a_bytes), (y, b_bytes)):
            at, out = 0, []
            for k in ids:
                out.append((k, at, at + len(table_[k])))
                at += len(table_[k])
            spans.append(out)
        links = [(p, q) for p, s, e in spans[0] for q, u, v in spans[1] if s < v and u < e]
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [([p for p, _, e in spans[0] if lo < e <= hi], [q for q, _, e in spans[1] if lo < e <= hi])
                  for lo, hi in zip([0, *ends], ends)]
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        count.update(links)
        docs.append((i, len(x), len(y), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if x else ""))
    top: dict = {}
    for (_, q), n in count.items():
        top[q] = max(top.get(q, 0), n)
    return [(i, na, nb, ng, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), sha) for i, na, nb, ng, ls, sha in docs], count


ODD = [None, "", " ", "a", "a  b", " lead", "tail ", "line\nline\n\n  two\tthree", "<|endoftext|> here", "x<|endoftext|>y", "▁ literal", "a ▁b",
       "日本語 のテキスト", "é b c　d e", "naïve café's don't", "12345 67,890.12", "<s> </s> <unk>", "\x00 nul", "\x1c x \x85 y", "😀😀 ok", "ab" * 3000,
       "ﬁ ﬂ Å", "a\r\nb \x0b c", "﻿bom x", "same text", "same text", "x y z", "a é  b"]


def got(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [64, 4 << 20])
def test_odd_texts_equal_the_plain_way(spark, both, size):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], "doc_id long, text string, block int, a string").repartition(3)
    docs, count = plain_way(both, rows)
    texts, pairs = align_tokens(df, block_bytes=size)
    assert got(texts) == sorted(docs, key=repr)
    assert {(r.a, r.b): r.total for r in pairs.collect()} == dict(count)


def test_table_equals_the_plain_way(spark, both):
    df = table(spark, SF_SMALL, "documents")
    docs, _ = plain_way(both, [(r.doc_id, r.text) for r in df.where("length(text) < 4000").collect()])
    assert got(align_tokens(df.where("length(text) < 4000"), block_bytes=20_000)[0]) == sorted(docs, key=repr)


def test_empty_table(spark):
    texts, pairs = align_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert texts.collect() == [] and pairs.collect() == []


def test_own_and_faster_library_agree(both):
    import public_tokenizers as P
    bpe = ByteBpe(P.path("byte_bpe_50k.json"), special=False)
    assert bpe.fast is not None
    texts = [f" a{chr(c)}1{chr(c)}{chr(c)}!" for c in [*range(1, 0x3000, 3), *range(0x3000, 0x11000, 41)] if not 0xD800 <= c < 0xE000]
    ids, size = bpe(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [bpe.own(t) for t in texts]
