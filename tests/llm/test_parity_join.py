"""The parity-sketch join against all pairs."""

import itertools
import random

import numpy as np
import pytest

from recordloom.llm import parity_join as parity


def words_of(text):
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\v\f\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out + [word] * bool(word)


def brute(docs, width, percent):
    """Size of the set and least linked key of every key, from all pairs."""
    sets = {}
    for k, t in docs:
        words = words_of(t)
        sets[k] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()
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
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(2)
        words = words or ["e"]
    return words


def corpus(seed):
    """Groups at every distance and size, chains, copies, and short texts."""
    rng = random.Random(seed)
    docs = []
    for _ in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 11, 12, 14, 20, 25, 40, 60, 100, 200]))]
        for _ in range(rng.randrange(1, 12)):
            docs.append(" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25))))
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 1 + len(chain) // 120)
            docs.append(" ".join(chain))
    docs += ["one", "ONE", "one two", "One  Two", "one two three", "", "   ", "É è", "é È"] + docs[:6]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, width, percent", [(1, 3, 90), (2, 3, 90), (3, 2, 80), (4, 1, 50), (5, 3, 100)])
def test_against_all_pairs(documents, seed, width, percent):
    docs = corpus(seed)
    rows = parity.joined(documents(*[(k, t, "en") for k, t in docs]), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, width, percent) and len(rows) == len(docs)


@pytest.mark.parametrize("tile, size", [(8, 16_000_000), (256, 2_000)])
def test_groups_that_meet_only_across(documents, monkeypatch, tile, size):
    """Small tiles and a wide fan of texts, of which few are near the bucket's least member."""
    monkeypatch.setattr(parity, "TILE", tile)
    monkeypatch.setattr(parity, "TILE_BYTES", size)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(edited(rng, base, 1 + i % 5))) for i in range(70)]
    rows = parity.joined(documents(*[(k, t, "en") for k, t in docs])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, 3, 90)


def test_planted_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity.joined(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_linked_sets_share_a_bucket(percent):
    """Sizes and differences at the threshold: a band in common, no more differing bits than elements, a bucket in common."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 60), 100, 333, 1000]:
        for larger in {size, size * 100 // percent, (size + size * 100 // percent) // 2}:
            together = -(-percent * (size + larger) // (100 + percent))
            if together > size:
                continue
            pool = rng.integers(-(2**63), 2**63 - 1, size + larger)
            a, b = pool[:size], np.concatenate([pool[:together], pool[size : size + larger - together]])
            assert len(b) == larger and 100 * together >= percent * (size + larger - together)
            shared = set(parity.bands_of(size, percent)) & set(parity.bands_of(larger, percent))
            assert shared or size == larger == together
            for band in shared:
                n = parity.shape(band, percent)[0]
                x, y = parity.sketch(a, n), parity.sketch(b, n)
                bits = parity.differing(x, y)
                assert bits <= size + larger - 2 * together <= parity.difference(size + larger, percent) and parity.possible(np.int64(size), np.int64(larger), bits, percent)
                if band == max(parity.bands_of(larger, percent)[:1], default=0) or size == larger:
                    assert set(parity.keys(x, band, size, percent)) & set(parity.keys(y, band, larger, percent))


def test_hot_groups(documents):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(130)]
    near = [(i, " ".join(edited(rng, base, 1))) for i in range(400, 700)]
    docs = [(i, " ".join(base)) for i in range(400)] + near + [(i, f"lone text {i} a{i} b{i} c{i}") for i in range(700, 900)]
    rows = parity.joined(documents(*[(k, t, "en") for k, t in docs])).collect()
    assert {r.component_id for r in rows if r.doc_id < 700} == {0} and all(r.component_id == r.doc_id for r in rows if r.doc_id >= 700)


def test_odd_rows(odd, empty, clashing):
    rows = parity.joined(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 10 and by[5].component_id == 4 and by[6].component_id == 6
    assert all(by[k].n_shingles == 0 and by[k].component_id == k for k in (1, 2, 3))
    assert [r.component_id for r in rows if r.doc_id is None] == [None] * 2
    assert parity.joined(empty).count() == 0
    assert parity.joined(clashing).columns == ["doc_id", "n_shingles", "component_id"] and parity.joined(clashing).count() == 10
