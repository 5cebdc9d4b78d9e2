import random
import re
import zlib

import pytest
from tests.conftest import SF_SMALL

from quarry.llm.jaccard import jaccard_classes, keep_one
from quarry.llm.shards import byte_shards

SCHEMA = "doc_id long, text string, n long, sid string, part int, key long"


def frame(spark, data):
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in data], SCHEMA)


# --- n-gram Jaccard join -----------------------------------------------------

def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in (t or "")))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}


def brute(data, k, num, den):
    sets = {i: shingles(t, k) for i, t in data}
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x = len(sets[a] & sets[b])
                if den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                    links[a].add(b)
                    links[b].add(a)
    comp = {}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += links[x]
    return {i: (len(sets[i]), len(links[i]), comp[i]) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < .65:
            w = rng.choice(out)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if w:
                    j = rng.randrange(len(w))
                    w[j:j + 1] = rng.choice([[rng.choice(vocab)], [], [w[j], "new"]])
        else:
            w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 4, 30, 80, 200]))]
        out.append((i * 7 + 3, rng.choice([" ", "  ", "\n", "\t "]).join(x.upper() if rng.random() < .1 else x for x in w)))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (1, 5, 10)])
def test_join_brute_force(spark, k, num, den):
    data = corpus(k)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in jaccard_classes(frame(spark, data).repartition(3), k, num, den).collect()}
    assert got == brute(data, k, num, den)


def test_blocks_of_one_group(spark, monkeypatch):
    from quarry.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    rng = random.Random(0)
    base = [f"t{i}" for i in range(100)]
    data = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        data.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in jaccard_classes(frame(spark, data), 3, 90, 100).collect()}
    assert got == brute(data, 3, 90, 100)


def test_texts_of_a_small_group_are_sent_once(spark, monkeypatch):
    """Sizes of several bins link in a chain; a group that fits a block is one block."""
    from quarry.llm import jaccard
    seen = []
    data = [(i, " ".join(f"w{j}" for j in range(30 + i))) for i in range(40)]
    old = jaccard.staged

    def keep(df, name, *rest):
        out = old(df, name, *rest)
        if name == "blocks":
            seen.append(out.select("comp", "bin").distinct().count())
            seen.append(out.where("above is not null or below is not null").count())
        return out
    monkeypatch.setattr(jaccard, "staged", keep)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in jaccard_classes(frame(spark, data)).collect()}
    assert got == brute(data, 5, 8, 10) and seen == [1, 0]


def test_block_pairs_are_joined_in_shares(spark, monkeypatch):
    """The copies of texts are never all on disk at once, and no link is lost."""
    from quarry.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    data = [(i, " ".join([*(f"t{j}" for j in range(100)), f"x{i}"])) for i in range(40)]
    sent = []
    old = jaccard.staged

    def keep(df, name, *rest):
        out = old(df, name, *rest)
        if name == "links":
            sent.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "staged", keep)
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in jaccard_classes(frame(spark, data), 3, 90, 100).collect()}
    assert got == brute(data, 3, 90, 100)
    assert len(sent) == jaccard.ROUNDS and max(sent) < 0.6 * sum(sent)


def test_chance_fragments_do_not_join_a_component(spark, monkeypatch):
    """Texts that share a passage have equal fragments; only those with a near copy are compared."""
    from quarry.llm import jaccard
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    passage = " ".join(f"p{j}" for j in range(60))
    data = [(i, f"{passage} " + " ".join(f"x{i}-{j}" for j in range(40))) for i in range(40)]
    data += [(100 + i, data[i][1] + " end") for i in (3, 17)] + [(200, None), (201, passage), (202, passage)]
    sizes = {}
    old = jaccard.staged

    def keep(df, name, *rest):
        out = old(df, name, *rest)
        if name in ("candidates", "blocks"):
            sizes[name] = out.count()
        return out
    monkeypatch.setattr(jaccard, "staged", keep)
    df = frame(spark, [*data, data[3], (None, data[3][1])])
    got = {(r.doc_id, r.n_links, r.component_id) for r in jaccard_classes(df.repartition(3)).collect()}
    want = {(i, x, c) for i, (_, x, c) in brute(data, 5, 8, 10).items()}
    assert got == want | {(None, 0, None)}
    assert sizes["candidates"] > 20 and sizes["blocks"] == 4


def test_join_hard_cases(spark):
    data = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "One  TWO"), (6, "É x"), (7, "é x"), (8, "long " * 30_000), (9, "long " * 30_000)]
    df = frame(spark, [*data, (None, "one two")])
    rows = jaccard_classes(df, 3, 90, 100).collect()
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in rows}
    assert got.pop(None) == (1, 0, None)
    assert got == brute(data, 3, 90, 100)
    twice = jaccard_classes(df.union(df), 3, 90, 100).collect()
    assert sorted(map(str, twice)) == sorted(map(str, rows * 2))
    assert jaccard_classes(df.limit(0)).count() == 0
    one = keep_one(df.union(df))
    assert one.columns == df.columns
    assert sorted(str(r.doc_id) for r in one.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]


# --- shards ------------------------------------------------------------------

def placed(data, shards):
    """(doc_id, size, crc, shard, slot) one by one: the midpoint of each
    document's bytes in the whole order says its shard."""
    order = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    total, start, used, out = sum(x[1] for x in order), 0, [0] * shards, []
    for i, size, crc in order:
        s = min(shards - 1, (2 * start + size) * shards // (2 * total))
        out.append((i, size, crc, s, used[s]))
        used[s] += 1
        start += size
    return sorted(out, key=str)


def check_shards(data, rows, shards):
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows), key=str) == placed(data, shards)
    got = sorted(rows, key=lambda r: (r.shard, r.slot))
    total = sum(r.size for r in rows)
    weight = [0] * shards
    for r in got:
        weight[r.shard] += r.size
    largest = max((r.size for r in rows), default=0)
    assert all(abs(x - total / shards) <= largest for x in weight)
    for s in range(shards):
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    order = [r.doc_id for r in got if r.doc_id is not None]
    assert order == sorted(order)
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == want


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards(spark, shards):
    data = [*corpus(shards), (None, "no id"), (10**6, None), (10**6, None), (10**6 + 1, "é" * 5000)]
    check_shards(data, byte_shards(frame(spark, data).repartition(4), shards).collect(), shards)


def test_shards_documents_and_empty(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check_shards([(r.doc_id, r.text) for r in df.collect()], byte_shards(df).collect(), 40)
    assert byte_shards(df.limit(0)).count() == 0
    assert byte_shards(frame(spark, [(1, "")])).count() == 1
