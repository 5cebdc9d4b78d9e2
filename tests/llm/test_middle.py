import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm.middle import Units, fill_in_middle, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PART = st.sampled_from(["a", "word", " ", "  ", "\n", "\t", "\x0b", "\x0e", "\x08", "\x1f", "!", "é", "日本", "😀", "\0", "", "\x7f", "x" * 9])


def plain_way(doc_id, text, seed=42):
    text = text or ""
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, z = sorted(x % (len(u) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.lists(PART, max_size=24).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_every_cut_equals_the_pattern(texts):
    data = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, data)]) + 3
    u = Units(np.frombuffer(b"abc" + b"".join(data), np.uint8), off)
    units = [UNIT.findall(t) for t in texts]
    assert u.n.tolist() == [len(x) for x in units]
    for r in range(max(map(len, units)) + 1):
        at = u.cut(np.minimum(r, u.n))
        want = ["".join(x[:r]) for x in units]
        assert at.tolist() == [len(w.encode()) for w in want]
        assert u.chars(at).tolist() == [len(w) for w in want]


def test_rows_equal_the_plain_way(spark):
    texts = [None, "", " ", "one", "a b c d e f g", "tail \n", "has <P> inside", "<M>", "x <S> y", "é ü 日本 語", "w " * 3000, "ends <", "< S > <S", "same", "same"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts * 8)] + [(None, "no id at all", "", ""), (7, "twice", "", ""), (7, "twice", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n string").repartition(3)
    out = fill_in_middle(df).select("*", restore(F.col("output"), F.col("form")).alias("back")).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert got == sorted(((i, *plain_way(i, t)) for i, t, _, _ in rows), key=repr)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    by_output = {plain_way(i, t)[-1]: t or "" for i, t, _, _ in rows}
    assert all(r.back == by_output[r.output] for r in out)


def test_one_text_over_many_words_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")
    for r in fill_in_middle(df).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_way(r.doc_id, text)
    assert fill_in_middle(df.limit(0)).collect() == []
