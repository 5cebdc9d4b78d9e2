import hashlib
import re

import duckdb
import pytest
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_native import brute_overlaps
from tests.llm.test_packing import check
from tests.llm.test_sets import brute as brute_jaccard

import corpus_pipeline
from quarry.llm import leaks, packing, templates
from quarry.llm.common import staged, table


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF_SMALL, "documents")
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append(staged(f(spark, out[-1], SF_SMALL), f"test-{i}"))
    return out


def test_stages(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[1:-1])
    assert steps[0].count() >= steps[1].count() == steps[2].count() >= steps[3].count() >= steps[4].count() > 0


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_keeps_rows_as_they_are(steps):
    before, after = rows(steps[0]), rows(steps[1])
    assert all(before[i] == r for i, r in after.items())


def test_line_dedup_against_sql(steps):
    documents = steps[1].toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = {r[0]: r[3] for r in con.execute(templates.oracle()).fetchall()}
    got = rows(steps[2])
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicates_against_brute_force(steps):
    before = rows(steps[2])
    want = {i for i, (_, _, c) in brute_jaccard([(i, r.text) for i, r in before.items()], 5, 8, 10).items() if c == i}
    after = rows(steps[3])
    assert after.keys() == want and all(before[i] == r for i, r in after.items())


def test_decontamination_against_brute_force(spark, steps):
    before, after = rows(steps[3]), rows(steps[4])
    items = [(r.item_id, r.text) for r in table(spark, SF_SMALL, "benchmark").collect()]
    # documents without eleven words of an item cannot overlap it: that spares the brute force most pairs
    words = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in items}
    bad = set()
    for d, r in before.items():
        mine = set(re.findall(r"[^\W_]+", r.text.lower()))
        close = [(i, t) for i, t in items if len(words[i] & mine) >= min(6, len(words[i]))]
        bad |= {x[0] for x in brute_overlaps([(d, r.text)], close)}
    assert after.keys() == before.keys() - bad and all(before[i] == r for i, r in after.items())


def test_packing_of_what_is_left(steps):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    check(steps[5].collect(), {i: r.text for i, r in rows(steps[4]).items()}, tok, 1024)


def test_benchmark_passages_are_gone(spark, steps):
    assert leaks.overlaps(steps[4], table(spark, SF_SMALL, "benchmark")).count() == 0


def test_run_and_hard_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF_SMALL).columns[:3] == ["doc_id", "piece", "start"]
    docs = table(spark, SF_SMALL, "documents")
    hard = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "word " * 100_000, None, "s", None),
                                  (3, None, "en", None, 1)], docs.schema)
    both = docs.union(hard).union(hard)
    for name, f in corpus_pipeline.STAGES:
        both = staged(f(spark, both, SF_SMALL), "hard-" + name.split()[0])
    assert both.count() > 0
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        empty = staged(f(spark, empty, SF_SMALL), "empty-" + name.split()[0])
    assert empty.count() == 0


def test_toxic_and_junk_go(spark):
    docs = table(spark, SF_MID, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF_MID).select("doc_id").collect()}
    labels = table(spark, SF_MID, "labels").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1 and r.toxic == 0]
    junk = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) > .98 * len(good) and sum(junk) < .05 * len(junk)
