"""The written index in segments, inverted lists, threshold skipping, page
scanning and section paths beyond what the registered checks hold."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF_MID, SF_SMALL

from quarry.operators import index as I
from quarry.operators import ivf
from quarry.operators import retrieve as R
from quarry.operators.chunk import markdown_sections
from quarry.operators.convert import blocks_to_markdown, page_blocks
from quarry.operators.retrieve import dense_topk
from quarry.plans import index_store
from quarry.plans.registry import Tables


# R5: threshold skipping ---------------------------------------------------------
def _plain_bm25(docs, queries, k):
    """Every score, in Python."""
    from quarry.functions.text import terms
    tokens = {r.doc_id: r.t for r in docs.select("doc_id", terms("text").alias("t")).collect()}
    asked = {r.query_id: set(r.t) for r in queries.select("query_id", terms("text").alias("t")).collect()}
    n, length = len(tokens), sum(map(len, tokens.values()))
    df: dict = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, ws in asked.items():
        scores = []
        for d, t in tokens.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / (length / n)))
                    for w in ws if w in t)
            if any(w in t for w in ws):
                scores.append((-round(s, 4), d))
        out += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_skipping_loses_no_hit_and_shuffles_fewer_pairs(spark, monkeypatch):
    t = Tables(spark, SF_SMALL)
    q = t.benchmark.limit(12).select(F.col("item_id").alias("query_id"), "text")
    for k in (1, 3):
        got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in R.bm25_topk(q, t.documents, k=k).collect())
        assert [g[:3] for g in got] == [w[:3] for w in _plain_bm25(t.documents, q, k)]
    # pairs that may be hits against pairs that share a term
    docs, q = Tables(spark, SF_MID).documents, Tables(spark, SF_MID).benchmark.select(F.col("item_id").alias("query_id"), "text")
    wanted = q.select("query_id", F.explode(F.array_distinct(R.terms("text"))).alias("term")).distinct()
    stats = R.stage(I.corpus_stats(I.doc_terms(docs)))
    posts = R.stage(R.with_impact(I.postings(docs).join(wanted.select("term").distinct(), "term", "left_semi"), stats).select("term", "doc_id", "impact", "level"))
    pairs, _, _ = R.candidate_pairs(wanted, posts, stats, 2)
    shared = posts.join(wanted, "term").select("query_id", "doc_id").distinct().count()
    assert pairs.count() < 0.6 * shared


def test_terms_without_a_first_bar(spark, monkeypatch):
    """Blocks too large to seed a bar: every block is kept, results are whole."""
    monkeypatch.setattr(R, "SEED_POSTINGS", 0)
    t = Tables(spark, SF_SMALL)
    q = t.benchmark.limit(5).select(F.col("item_id").alias("query_id"), "text")
    assert [r[:3] for r in sorted(map(tuple, R.bm25_topk(q, t.documents).collect()))] == [w[:3] for w in _plain_bm25(t.documents, q, 2)]


# R1: blocks of questions ----------------------------------------------------------
def test_question_blocks_equal_one_block(spark):
    t = Tables(spark, SF_SMALL)
    q = t.embeddings.limit(40).select(F.col("vec_id").alias("query_id"), "embedding")
    one = sorted(dense_topk(q, t.embeddings, exclude_self=True).collect())
    assert sorted(dense_topk(q, t.embeddings, exclude_self=True, block_values=600).collect()) == one


# R2: inverted lists -----------------------------------------------------------------
def test_inverted_lists_skip_unusable_vectors_and_split_hot_lists(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 8)
    rng = np.random.default_rng(3)
    vecs = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(40)]
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] + [1.0] * 5), (204, [1.0] * 5), (205, [float("inf")] * 6)]
    df = spark.createDataFrame(vecs + bad, "vec_id long, embedding array<double>")
    index = ivf.build_lists(df, lists=7)
    assert sum(index.sizes.values()) == 2 * len(vecs) and max(index.sizes.values()) > 8
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in ivf.dense_topk_ivf(q, index, k=3, probes=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    m = {i: np.array(v) for i, v in vecs}
    assert set(got) == set(m)
    for i, hits in got.items():
        want = sorted((-round(float(m[i] @ v / np.linalg.norm(m[i]) / np.linalg.norm(v)), 6), j) for j, v in m.items())[:3]
        assert [h[1] for h in sorted(hits)] == [j for _, j in want]


def test_written_lists_read_back_and_empty_table(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    index = ivf.build_lists(t.embeddings, path=str(tmp_path / "ivf"))
    back = ivf.open_lists(spark, str(tmp_path / "ivf"))
    assert back.probes == index.probes < len(back.centroids) and np.allclose(back.centroids, index.centroids)
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert sorted(ivf.dense_topk_ivf(q, back).collect()) == sorted(ivf.dense_topk_ivf(q, index).collect())
    none = ivf.build_lists(t.embeddings.limit(0))
    assert ivf.dense_topk_ivf(q, none).collect() == []


# K3: segments -------------------------------------------------------------------------
def test_segments_are_immutable_and_vacuumed(spark, tmp_path):
    t, path = Tables(spark, SF_SMALL), str(tmp_path / "index")
    docs = t.documents
    q = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    index_store.build(docs.where("doc_id % 3 = 0"), path, buckets=4)
    before = {f: spark.read.parquet(f"{path}/{f}/segment=0").count() for f in ("chunks", "text")}
    for n in (1, 2):
        index_store.append(docs.where(f"doc_id % 3 = {n}"), path)
    assert {f: spark.read.parquet(f"{path}/{f}/segment=0").count() for f in before} == before
    assert [s["segment"] for s in index_store.manifest(spark, path).segments] == [0, 1, 2]
    whole = str(tmp_path / "whole")
    index_store.build(docs, whole, buckets=4)
    want = sorted(index_store.answer(spark, whole, q).collect())
    assert sorted(index_store.answer(spark, path, q).collect()) == want
    index_store.merge(spark, path)
    assert index_store.vacuum(spark, path) == [0, 1, 2]
    assert sorted(index_store.answer(spark, path, q).collect()) == want
    assert index_store.append(docs, path, skip_known=True).segments[-1]["total_rows"] == 0
    assert sorted(index_store.answer(spark, path, q).collect()) == want


def test_index_keeps_one_copy_of_the_texts(spark, tmp_path):
    """No working copy of the chunks stays, context and text are not stored joined as well."""
    import glob
    from quarry.session import ensure_checkpoint_dir
    path = str(tmp_path / "index")
    left = ensure_checkpoint_dir(spark).removeprefix("file:") + "/chunks-*/*.parquet"
    before = set(glob.glob(left))
    docs = spark.createDataFrame([(i, f"# Title {i}\n" + "some words here. " * 40, "s") for i in range(6)], "doc_id long, text string, source string")
    index_store.build(docs.where("doc_id < 3"), path, buckets=2, contextual=True, dim=8)
    index_store.append(docs.where("doc_id >= 3"), path)
    index_store.merge(spark, path)
    assert set(glob.glob(left)) == before
    assert "index_text" not in spark.read.parquet(f"{path}/chunks").columns
    # the context is searched as well as the text
    q = spark.createDataFrame([(1, "Part Title")], "query_id long, text string")
    assert index_store.hits(spark, path, q).count() == 2


def test_names_stay_with_the_rows_of_documents(spark):
    docs = spark.createDataFrame([(1, "# A\none two", "x"), (2, "# B\nthree", "y"), (2, "# C\nfour", None), (None, "# D\nfive", "z"), (3, None, "w")],
                                 "doc_id long, text string, source string")
    alone = index_store.contextual_chunks(docs.where("doc_id = 1 or doc_id = 3"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.text.split()[1], str(r.source), r.index_text == f"{r.context}\n{r.text}") for r in index_store.contextual_chunks(docs).collect())
    assert got == [(1, "A", "x", True), *((2, t, n, True) for t in "BC" for n in ("None", "y"))]


def test_a_second_commit_of_one_version_fails(spark, tmp_path):
    path = str(tmp_path / "index")
    now = index_store.build(Tables(spark, SF_SMALL).documents.limit(5), path, buckets=2)
    with pytest.raises(Exception):
        index_store._commit(spark, path, now.version, now.segments)
    with pytest.raises(ValueError):
        index_store.append(Tables(spark, SF_SMALL).documents, str(tmp_path / "none"))


# T1: pages that are hard to read -----------------------------------------------------------
@pytest.mark.parametrize("html,want", [
    ("<p>1 < 2 and 3 > 2 stays</p>", [("p", "1 < 2 and 3 > 2 stays")]),
    ('<p title="a > b">x</p>', [("p", "x")]),
    ("<script>var a = '<p>no</p>';</script>yes", [("text", "yes")]),
    ("<script>open <p>kept", [("text", "open"), ("p", "kept")]),
    ("a<!-- never <b>closed</b>", [("text", "a<!-- never closed")]),
    ("a<!-- > closed -->b", [("text", "a b")]),
    ("<NAV class=x>Menu<p>in</p></NAV>out", [("nav", "Menu"), ("nav", "in"), ("text", "out")]),
    ("<footer>f</footer>", [("footer", "f")]),
    ("<p a=b'c>q's</p>", [("p", "q's")]),
    ("<!DOCTYPE html><?xml v?><p>x", [("p", "x")]),
    ("me@x <me@x.org> </ > <3", [("text", "me@x <me@x.org> </ > <3")]),
    ("\x01p\x02 <p>marks\x03 stay text</p>", [("text", "p"), ("p", "marks stay text")]),
])
def test_pages_hard_to_read(spark, html, want):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [(r.kind, r.text) for r in page_blocks(df).orderBy("block_pos").collect()] == want


def test_long_pages_and_navigation_in_markdown(spark):
    many = "<p " + " ".join(f'a{i}="{i}>"' for i in range(3000)) + ">body</p>" + "<b>x " * 20_000
    rows = spark.createDataFrame([(1, many), (2, "<nav>menu</nav><h1>T</h1><p>p</p><footer>f</footer>"), (3, None)], "page_id long, html string")
    blocks = page_blocks(rows)
    assert blocks.where("page_id = 1").orderBy("block_pos").first().text == "body"
    assert [r.markdown for r in blocks_to_markdown(blocks).where("page_id = 2").collect()] == ["# T\n\np"]


# T2: section paths --------------------------------------------------------------------------
def _plain_sections(text):
    """Sections by a stack, line by line."""
    out, path, lines, stack, fence, index = [], "/", [], [], False, 0

    def close():
        if "".join(lines).strip():
            out.append((index, path, "\n".join(lines)))
    for line in text.split("\n"):
        if line.lstrip(" ").startswith("```"):
            fence = not fence
        elif not fence and line.startswith("#") and line.lstrip("#")[:1].isspace():
            close()
            level = len(line) - len(line.lstrip("#"))
            stack = [s for s in stack if s[0] < level]
            path = "/" + "".join(s[1] + "/" for s in stack)
            stack.append((level, line.lstrip("#")[1:].strip(" ")))
            lines, index = [], index + 1
        lines.append(line)
    close()
    return out


def test_sections_equal_a_stack(spark):
    rng = np.random.default_rng(5)
    parts = ["# a", "## b", "### c", "#### d", "x", "```", "##no", "", "  ", "###### e", "# ", "text # not"]
    texts = ["\n".join(rng.choice(parts, size=n)) for n in (0, 1, 2, 5, 20, 60, 200) for _ in range(4)]
    texts += ["#" * 3000 + " deep\n# top\n" + "#" * 2999 + " next\nend", "\n".join(f"{'#' * (1 + i % 5)} h{i}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.section_index, r.header_path, r.text) for r in markdown_sections(df).collect())
    assert got == sorted((i, *s) for i, t in enumerate(texts) for s in _plain_sections(t))
