import numpy as np
import pytest
from tests.conftest import SF_SMALL

from quarry.llm import lattice as L

SCHEMA = "vec_id long, embedding array<float>, label int, sid long, key long, v string"


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id) by all pairs."""
    ok = {i: np.array(v, dtype=np.float64) for i, v, lab in rows if i is not None and lab is not None and v and all(
        x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    links = {i: set() for i, _, _ in rows}
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    comp = {}
    for i in sorted(k for k in links if k is not None):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return sorted(((i, len(links[i]), comp.get(i)) for i, _, _ in rows), key=str)


def result(df, **settings):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in L.vector_classes(df, **settings).collect()), key=str)


def test_decoding_is_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 2
    points, dist = L.neighbours(x, 8)
    assert (points[:, 0] == L.decode(x)).all()
    assert (np.diff(dist, axis=1) >= -1e-12).all()
    assert np.allclose(((points / 2 - x[:, None, :]) ** 2).sum(axis=2), dist)
    same = points % 2
    assert (same == same[..., :1]).all() and (points.sum(axis=2) % 4 == 0).all()     # E8, doubled
    assert dist[:, 0].max() <= 1 + 1e-9                                               # covering radius 1
    # no other lattice point is nearer: the 240 shortest vectors around the decoded point
    short = [np.array(p) for p in _shortest()]
    for s in short:
        assert (((points[:, 0] + s) / 2 - x) ** 2).sum(axis=1).min() >= 0
        assert ((((points[:, 0] + s) / 2 - x) ** 2).sum(axis=1) >= dist[:, 0] - 1e-9).all()


def _shortest():
    from itertools import combinations, product
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(v) for v in product((1, -1), repeat=8) if sum(v) % 4 == 0]
    assert len(out) == 240
    return out


@pytest.mark.parametrize("dim", [3, 8, 20, 64])
def test_recall_at_the_threshold(dim):
    """Pairs at a cosine of 0.98 share a cell in some table."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    blocks = L.blocks_needed(5000)
    proj = L.projections(dim, blocks, L.tables_needed(dim, 0.98, blocks, L.PROBES, L.MISS))
    zero, found = np.zeros(len(x), dtype=np.uint64), np.zeros(len(x), dtype=bool)
    for p in proj:
        found |= (L.cells(x, p, L.cell_size(dim, 0.98), L.PROBES, zero) == L.cells(y, p, L.cell_size(dim, 0.98), 0, zero)).any(axis=1)
    assert found.mean() >= 0.998


def planted(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < .5:
            base = np.array(rows[rng.integers(len(rows))][1])
            v = base + rng.normal(size=dim) * rng.choice([0, .02, .03, .05]) * np.linalg.norm(base) / np.sqrt(dim) * 4
        else:
            v = rng.normal(size=dim)
        rows.append((i * 3 + 1, v.astype(np.float32).tolist(), int(rng.integers(2))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [1024, 7])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    rows = planted(block, 250)
    assert result(frame(spark, rows).repartition(3)) == brute(rows)


def test_documents_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert result(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_hard_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1),
            (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, v, 2), (12, [1.0, 2.0], 1), (None, v, 1)]
    got = result(frame(spark, rows))
    assert got == brute(rows)
    assert (1, 2, 1) in got and (4, 0, 4) in got and (None, 0, None) in got
    twice = result(frame(spark, rows).union(frame(spark, rows)))
    assert twice == sorted(got * 2, key=str)
    assert result(frame(spark, rows).limit(0)) == []
    assert len(result(frame(spark, [(1, None, None)]))) == 1


@pytest.mark.parametrize("block", [1024, 300])
def test_pairs_inside_a_cluster(spark, monkeypatch, block):
    """Links among 2,000 vectors of one label that lie around one direction
    (cosine 0.85): a cell's first vector is rarely near the others."""
    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    rng = np.random.default_rng(12)
    n, dim = 2000, 64
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    x = unit(np.sqrt(.85) * unit(rng.normal(size=dim)) + np.sqrt(.15) * unit(rng.normal(size=(n, dim))))
    y = rng.normal(size=(300, dim))
    y = unit(y - (y * x[:300]).sum(axis=1, keepdims=True) * x[:300])
    x = np.concatenate([x, .985 * x[:300] + np.sqrt(1 - .985 ** 2) * y])
    want = (x @ x.T >= .98).sum() - len(x)
    assert want >= 600
    got = L.vector_classes(frame(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).toPandas()
    assert len(got) == len(x) and got.n_links.sum() == want
    partner = got.set_index("vec_id").component_id
    assert all(partner[i] == partner[n + i] for i in range(300))
