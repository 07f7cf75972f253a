"""Vector codes against plain whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from recordloom.llm import vector_codes as codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, rounds=4, entries=256):
    """The contract over (vec_id, vector, label), one part at a time."""
    kept = [(k, v, lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((k, len(v)) for k, v, _ in kept if k is not None)
    size = named[0][1] if named else 0
    whole = {i: [x.as_integer_ratio()[0] * 1024 // x.as_integer_ratio()[1] for x in map(float, v)] for i, (_, v, _) in enumerate(kept) if named and len(v) == size and size % 4 == 0}
    seeds = {}
    for i, v in whole.items():
        if kept[i][0] is not None:
            seeds[kept[i][0]] = min(seeds.get(kept[i][0], v), v)
    first = [seeds[k] for k in sorted(seeds)[:entries]]
    cut = lambda v, p: v[p * size // 4 : (p + 1) * size // 4]
    books = [[list(cut(v, p)) for v in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(p):
        return {i: min((far(cut(v, p), c), e) for e, c in enumerate(books[p])) for i, v in whole.items()} if first else {}

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for i, (_, e) in assign(p).items():
                groups.setdefault(e, []).append(cut(whole[i], p))
            for e, own in groups.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [assign(p) for p in range(4)]
    said = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], {}
    for i, (k, _, lab) in enumerate(kept):
        done = i in last[0]
        error = min(sum(a[i][0] for a in last), codes.MOST) if done else None
        by[lab] = min(by.get(lab, 0) + (error or 0), codes.MOST)
        out.append((k, "".join(f"{a[i][1]:02x}" for a in last) if done else None, error, lab))
    return sorted([(k, c, e, by[lab], said) for k, c, e, lab in out], key=repr)


def table(seed, n, size=8, scale=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, scale) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(n + i, rows[i % 7][1], 3) for i in range(n // 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [table(1, 400), table(2, 40, 16), table(3, 300, 4, 0.004), table(4, 60, 8, 1e7), table(5, 30, 8, 1e15), table(6, 30, 4, 1e200)])
def test_against_plain_numbers(spark, rows):
    got = codes.encoded(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


@pytest.mark.parametrize("kind", [np.int32, np.int64, object])
def test_trie_gives_the_nearest_entry(monkeypatch, kind):
    rng = np.random.default_rng(2)
    for leaves in (1, 3, 256):
        monkeypatch.setattr(codes, "LEAVES", leaves)
        parts = np.unique(rng.integers(-3, 4, size=(500, 5)), axis=0).astype(kind)
        book = rng.integers(-3, 4, size=(17, 5)).astype(kind)
        entry, error = codes.nearest(parts, book)
        table = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (entry == np.array(table.tolist()).argmin(axis=1)).all() and (error == table.min(axis=1)).all()


@pytest.mark.parametrize("bound", [5, 2**30, 2**40, 2**62, 2**100])
def test_stored_parts_sort_like_their_numbers(bound):
    rng = random.Random(bound)
    layout = codes.Layout(8, bound, 10)
    parts = [[rng.randrange(-bound, bound + 1) for _ in range(2)] for _ in range(300)] + [[-bound - 1, bound], [0, -1], [0, 0]]
    stored = [layout.stored(np.array(p, dtype=np.int64 if bound < 2**62 else object) if layout.width != 8 else np.array(p, dtype=np.int64)) for p in parts]
    assert [[int(x) for x in row] for row in layout.loaded(stored).tolist()] == parts
    assert [p for _, p in sorted(zip(stored, parts, strict=True))] == sorted(parts)


def test_floors_go_down_and_ties_to_the_lower_entry(spark):
    rows = [(0, [-0.0001] * 4, 1), (1, [0.0001] * 4, 1), (2, [0.0009] * 4, 1)]
    got = {r.vec_id: r for r in codes.encoded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].code == "00000000" and got[1].code == got[2].code == "01010101"


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (5, [0.1, 0.2, 0.3, 0.4], None), (5, [0.1, 0.2, 0.3, 0.4], None), (5, [-1.0, 0.2, 0.3, 0.4], 1), (None, [0.5] * 4, None), (6, None, 1), (7, [nan] * 4, 1),
        (8, [inf, 0.0, 0.0, 0.0], 1), (9, [None, 0.0, 0.0, 0.0], 1), (10, [0.0] * 8, 2), (11, [], 2), (12, [9.0] * 4, 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, codes.encoded(frame).collect()), key=repr) == plain(rows)
    clash = frame.selectExpr("*", *[f"1 as `{n}`" for n in ("vector", "part0", "code", "error", "of", "position", "n", "label_error")])
    assert sorted(map(tuple, codes.encoded(clash).collect()), key=repr) == plain(rows)
    assert codes.encoded(frame.limit(0)).count() == 0
    for some in ([(1, [0.0] * 6, 1), (2, [0.0] * 6, 1)], [(None, [1.0] * 4, 1)], [(1, [], 1), (2, [], None)]):
        assert sorted(map(tuple, codes.encoded(spark.createDataFrame(some, SCHEMA)).collect()), key=repr) == plain(some)


def test_one_vector_holds_most_rows(spark):
    rows = [(i, [0.25, -0.5, 0.75, 1.0], 1) for i in range(20000)] + [(20000 + i, [i / 50, 0.0, -i / 70, 0.5], i) for i in range(60)]
    got = codes.encoded(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
