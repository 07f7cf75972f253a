import itertools
import random

import numpy as np
import pytest

from recordloom.llm import near_duplicates as near


def brute(docs, width, percent):
    """Least linked key of every key, from all pairs."""
    sets = {k: near.shingles(t, width) for k, t in docs}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def corpus(seed):
    """Groups at every distance, chains, copies, and short texts."""
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 12)):
            docs.append(" ".join(edited(rng, base, rng.randrange(0, max(1, len(base) // 8)))))
        chain = base
        for _ in range(5):
            chain = edited(rng, chain, max(1, len(chain) // 20))
            docs.append(" ".join(chain))
    docs += ["one", "ONE", "one two", "One  Two", "one two three", "", "   ", "É è", "é È"] + docs[:6]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, width, percent", [(1, 2, 80), (2, 2, 80), (3, 5, 80), (4, 3, 90)])
def test_against_all_pairs(documents, seed, width, percent):
    docs = corpus(seed)
    rows = near.near_duplicates(documents(*[(k, t, "en") for k, t in docs]), width=width, percent=percent).collect()
    want = brute(docs, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(docs)


def test_groups_that_meet_only_across(documents, monkeypatch):
    """Small tiles and a wide fan of texts, of which few are near the bucket's least member."""
    monkeypatch.setattr(near, "TILE", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(edited(rng, base, 1 + i % 6))) for i in range(80)]
    rows = near.near_duplicates(documents(*[(k, t, "en") for k, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 2, 80)


def test_planted_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()}
    assert got == want


def test_bounds_keep_pairs_at_the_threshold():
    bounds = near.least_matches(0.8)
    assert len(bounds) == near.HASHES // near.BATCH and bounds == sorted(bounds) and 0 < bounds[0] < 0.8 * near.BATCH
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, size=(20000, near.HASHES)).astype("<u2")
    at = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype("<u2")
    far = np.where(rng.random(a.shape) < 0.45, a, a + 1).astype("<u2")
    assert len(near._surviving(a, at, bounds)[0]) >= len(a) - 2
    assert len(near._surviving(a, far, bounds)[0]) < 0.01 * len(a)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = list(range(2000))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.rep: r.component for r in near.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for pair in links for x in pair if root(x) != x}
    assert near.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_groups(documents):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(base)) for i in range(400)] + [(i, " ".join(edited(rng, base, 2))) for i in range(400, 700)] + [(i, f"lone text {i} a{i} b{i} c{i}") for i in range(700, 900)]
    rows = near.near_duplicates(documents(*[(k, t, "en") for k, t in docs])).collect()
    assert {r.component_id for r in rows if r.doc_id < 700} == {0} and sum(r.kept for r in rows) == 201


def test_odd_rows(odd, empty, clashing):
    rows = near.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[5].component_id == 4 and not by[5].kept and by[6].kept
    assert all(by[k].n_shingles == 0 and by[k].component_id == k and by[k].kept for k in (1, 2, 3))
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)] * 2
    assert near.near_duplicates(empty).count() == 0
    assert near.near_duplicates(clashing).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert near.near_duplicates(clashing).count() == 10
