import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF_BIG, SF_SMALL

from quarry.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, p_good string, row int"


def prose(rng, n, extra=()):
    w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    for x in extra:
        w.insert(rng.randrange(len(w) + 1), x)
    return " ".join(w)


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        kind = rng.random()
        if kind < .15:
            t = " ".join([prose(rng, 1)] * rng.randint(20, 60))
        elif kind < .3:
            t = prose(rng, rng.randint(20, 200), [rng.choice(["vilest", "rotten", "hated"]) for _ in range(2)])
        else:
            t = prose(rng, rng.randint(20, 200))
        rows.append((i, t, rng.choice(["en", "fr"]), f"s{i % 5}", len(t), "x", 0))
        if i % 2:
            labels.append((i, 0 if kind < .15 else 1, 1 if .15 <= kind < .3 else 0))
    return rows, labels, {r[0]: (lambda k: k)(r) for r in rows}


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_views_do_not_depend_on_the_batch():
    texts = ["", None, "One two TWO two\nthree!", "é" * 400, "x " * 300, "#$% 12"]
    cols = [pa.array(texts, pa.string()), pa.array(["en", None, "fr", "", "de", "en"], pa.string()),
            pa.array(["a", "b", None, "", "a", "b"], pa.string()), pa.array([0, None, 5, 400, 600, 6], pa.int64())]
    (t, p), = Q.views(*cols)
    for i in range(len(texts)):
        (ti, pi), = Q.views(*(c.slice(i, 1) for c in cols))
        for whole, one in ((t, ti), (p, pi)):
            assert np.array_equal(whole[0][whole[1][i]:whole[1][i + 1]], one[0])
            assert np.allclose(whole[2][i], one[2][0])
    assert t[1][3] - t[1][2] == 3 + 1          # one, two, three and a stem of five bytes less one


def test_co_training_hands_labels_over():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(600) < .5, 1.0, 0.0)
    stats = [np.stack([y * 3 + rng.normal(size=600), rng.normal(size=600)], axis=1) for _ in range(2)]
    none = np.zeros(0, np.uint64), np.zeros(601, np.int64)
    seen = np.where(np.arange(600) < 120, y, np.nan)
    model, passed = Q.co_train(*(Q.View(*none, s) for s in stats), seen, np.arange(600) % 5 == 0)
    assert passed > 50
    z = np.stack([c[0] * m.logits(*none, s) + c[1] for c, m, s in zip(model.calibration, (model.text, model.page), stats, strict=True)], axis=1)
    both = z @ model.mixture[:-1] + model.mixture[-1] > 0
    rest = np.arange(600) >= 120
    assert (both == (y == 1))[rest].mean() > max(((z[:, k] > 0) == (y == 1))[rest].mean() for k in (0, 1)) - .01
    assert (both == (y == 1))[rest].mean() > .95


def test_planted_documents(spark):
    rows, labels, _ = corpus(1500)
    docs, marks = frames(spark, rows, labels)
    model = Q.fit_quality(docs.repartition(4), marks)
    scored = {r.row.doc_id: r.p_good for r in Q.score_quality(docs, model).collect()}
    fresh = {r[0]: r[1] for r in rows if r[0] % 2 == 0}
    bad = {i for i, t in fresh.items() if any(w in t.split() for w in ("vilest", "rotten", "hated")) or len(set(t.split())) == 1}
    assert np.mean([scored[i] < .5 for i in bad]) > .98
    assert np.mean([scored[i] >= .5 for i in fresh.keys() - bad]) > .98
    again = Q.fit_quality(docs.repartition(7), marks)
    assert np.array_equal(again.text.weights, model.text.weights) and again.calibration == model.calibration
    kept = Q.keep_good(docs, marks)
    assert kept.columns == docs.columns


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_BIG}/{t}.parquet") for t in ("documents", "labels"))
    half = F.expr("xxhash64(doc_id, 7) % 2 = 0")
    model = Q.fit_quality(docs, labels.where(half))
    rows = Q.score_quality(docs, model).select("row.doc_id", "p_good").join(labels.where(~half), "doc_id").collect()
    good = np.array([r.quality == 1 and r.toxic == 0 for r in rows])
    keep = np.array([r.p_good >= .5 for r in rows])
    assert (keep == good).mean() > .96
    assert keep[good].mean() > .985
    assert keep[np.array([r.quality == 0 for r in rows])].mean() < .02


def test_hard_cases(spark):
    rows, labels, _ = corpus(300, 3)
    docs, marks = frames(spark, rows, [*labels, (None, 1, 0), (1, None, None), (3, 0, 1), (3, 1, 0)])
    hard = spark.createDataFrame([(None, None, None, None, None, None, None), (900, "", "en", "s0", 0, "x", 1), (901, "word " * 200_000, "en", "s0", 10**6, "x", 1),
                                  (902, "a", "en", "s0", -5, "x", 1), (902, "a", "en", "s0", -5, "x", 1)], SCHEMA)
    model = Q.fit_quality(docs.union(hard), marks)
    out = Q.score_quality(docs.union(hard), model).collect()
    assert len(out) == 305 and all(0 <= r.p_good <= 1 for r in out)
    assert len({r.p_good for r in out if r.row.doc_id == 902}) == 1
    assert Q.score_quality(docs.limit(0), model).count() == 0
    assert Q.fit_quality(docs, marks.limit(0)) is None
    assert [r.p_good for r in Q.score_quality(docs.limit(2), None).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("table", ["documents"])
def test_small_table(spark, table):
    from quarry.llm.catalog import QUERIES
    rows = QUERIES["op6_co_training_quality"](spark, SF_SMALL).collect()
    assert len(rows) == 200 and all(r.keep == (r.p_good >= .5) for r in rows)
