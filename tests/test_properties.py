"""Property checks: the row-local text operators against small pure-Python
reference implementations on generated texts (one Spark job per example)."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.text import sentences, terms, STOP_WORDS
from quarry.operators import chunk as C

WORD = st.text(alphabet=st.sampled_from(list("abcdeéßxyz.!?,'-")), min_size=1, max_size=8)
SEP = st.sampled_from([" ", "  ", "\n", "\t", " \n ", "\r\n"])


@st.composite
def texts(draw):
    n = draw(st.integers(0, 60))
    parts = []
    for _ in range(n):
        parts.append(draw(WORD))
        parts.append(draw(SEP))
    lead = draw(st.sampled_from(["", " ", "\n"]))
    return lead + "".join(parts)


def py_windows(text, size, overlap):
    words = re.findall(r"\S+", text)
    step = size - overlap
    n = len(words)
    nc = 1 if n <= size else math.ceil((n - size) / step) + 1
    return [" ".join(words[i * step: i * step + size]) for i in range(nc)]


def py_sentences(text):
    out = []
    for s in re.findall(r"[^.!?]+[.!?]*", text):
        s = re.sub(r"\s+", " ", s).strip(" ")
        if s:
            out.append(s)
    return out


PROPS = settings(max_examples=15, deadline=None,
                 suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


@PROPS
@given(st.lists(texts(), min_size=1, max_size=12), st.sampled_from([(5, 2), (3, 0), (8, 7), (800, 200)]))
def test_token_windows(spark, docs, params):
    size, overlap = params
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {}
    for r in C.token_chunks(df, size, overlap).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.text, r.n_chunks, r.chunk_id)
    for i, t in enumerate(docs):
        want = py_windows(t, size, overlap)
        assert [got[i][k][0] for k in range(len(want))] == want
        assert all(v[1] == len(want) for v in got[i].values()) and len(got[i]) == len(want)
        assert got[i][0][2] == f"{i}-0"


@PROPS
@given(st.lists(texts(), min_size=1, max_size=12))
def test_sentences_lines_pages_terms(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    rows = df.select("doc_id", sentences("text").alias("s"), C.first_lines("text", 2).alias("two"),
                     terms("text").alias("t"), C.page_estimate(F.col("doc_id") * 3).alias("page")).collect()
    stops = set(STOP_WORDS)
    for r in rows:
        t = docs[r.doc_id]
        assert list(r.s) == py_sentences(t)
        assert r.two == "\n".join(t.strip(" \t\n\v\f\r").split("\n")[:2])
        assert list(r.t) == [w for w in re.findall(r"[^\W\d_]+", t.lower()) if w not in stops]
        assert r.page == max(1, (r.doc_id * 3 * 800) // 2000 + 1)
