import hashlib
import random

import pytest
from tests.conftest import SF_SMALL

from quarry.llm.suffixes import repeated_bytes

SCHEMA = "doc_id long, text string, part int, gram long, rid string"


def brute(texts, span):
    """texts: (doc_id, text) in order; every string of ``span`` bytes."""
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is None, x[0])):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - span + 1):
            x = data[s:s + span]
            if x in seen:
                gone[s:s + span] = b"\1" * span
            seen.add(x)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df, **settings):
    rows = repeated_bytes(df, **settings).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))) for _ in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(25)]
    out = []
    for _ in range(60):
        t = " ".join(rng.choice(base) for _ in range(rng.randint(0, 3)))
        if rng.random() < .5:
            i = rng.randint(0, len(t))
            t = t[:i] + rng.choice(["x", "", "ab" * 80, "z" * 300]) + t[i:]
        out.append(t)
    return out


@pytest.mark.parametrize("hot", [50_000, 20, 0])
def test_brute_force(spark, hot):
    data = list(enumerate(corpus(hot)))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in data], SCHEMA).repartition(4)
    assert result(df, hot=hot) == brute(data, 100)


def test_short_span(spark):
    data = list(enumerate(corpus(9)))
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in data], SCHEMA)
    assert result(df, span=40, gram=12, hot=300) == brute(data, 40)


def test_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.collect()], 100)


def test_hard_cases(spark):
    long = "".join(random.Random(2).choice("abcdefgh ") for _ in range(400))
    data = [(5, None), (2, ""), (3, long), (4, long), (None, long + "!"), (7, "short")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in data], SCHEMA)
    got = result(df)
    assert got == brute(data, 100)
    twice = result(df.union(df))
    assert len(twice) == 2 * len(data)
    assert set(twice) == set(got)
    assert result(df.limit(0)) == []
