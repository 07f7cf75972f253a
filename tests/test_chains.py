"""Pages ordered by their tokens."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import chains

SCHEMA = "source string, asked string, next_token string, body string"


def chain(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return chains.chain_pages(frame, F.col("asked"))


def pages(source, n):
    token = lambda i: f"t{source}{i * 7919 % 10007}"
    return [(source, token(i) if i else None, token(i + 1) if i < n - 1 else None, f"{source}{i}") for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_shuffled_pages_find_their_places(spark, n):
    rows = pages("a", n) + pages("b", 5)
    random.Random(n).shuffle(rows)
    found = chain(spark, rows)
    assert {r.body: (r.page_no, r.standing) for r in found.collect()} == {f"{s}{i}": (i, "chained") for s, m in (("a", n), ("b", 5)) for i in range(m)}
    assert {tuple(r) for r in chains.chain_completeness(found).collect()} == {("a", n, n, 0, 0, 0, 0, "complete"), ("b", 5, 5, 0, 0, 0, 0, "complete")}


def test_gaps_loops_forks_and_repeats(spark):
    gap = [r for r in pages("g", 9) if r[3] != "g4"]
    loop = [(*r[:2], r[2] or pages("l", 6)[2][1], r[3]) for r in pages("l", 6)]
    fork = [*pages("f", 5), ("f", "elsewhere", pages("f", 5)[3][1], "stray")]
    twice = pages("r", 4) + [pages("r", 4)[2]]
    headless = pages("h", 4)[1:]
    cut = pages("c", 5)[:3]
    found = chain(spark, gap + loop + fork + twice + headless + cut)
    got = {}
    for r in found.collect():
        got.setdefault(r.body, []).append((r.page_no, r.standing))
    assert [got[f"g{i}"] for i in range(9) if i != 4] == [[(i, "chained")] for i in range(4)] + [[(None, "behind a gap")]] * 4
    assert all(got[f"l{i}"] == [(None, "loop")] for i in range(6))
    assert got["stray"] == [(2, "fork")] and got["f2"] == [(2, "fork")] and got["f3"] == [(3, "chained")]
    assert sorted(got["r2"], key=repr) == [(2, "chained"), (None, "repeated")]
    verdicts = {r.source: r.verdict for r in chains.chain_completeness(found).collect()}
    assert verdicts == {"g": "partial", "l": "unknown", "f": "unknown", "r": "unknown", "h": "partial", "c": "partial"}


def test_odd_rows(spark):
    found = chain(spark, [(None, None, "x", "n0"), (None, "x", None, "n1"), ("s", None, None, None), ("e", "", "", "e")])
    assert {r.body: (r.page_no, r.standing) for r in found.collect()} == {"n0": (0, "chained"), "n1": (1, "chained"), None: (0, "chained"), "e": (None, "loop")}
    assert chain(spark, [("s", None, None, "b")]).limit(0).count() == 0
    assert chains.chain_pages(spark.createDataFrame([], SCHEMA), F.col("asked")).count() == 0


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    written = []
    keep = chains.stage
    monkeypatch.setattr(chains, "stage", lambda df, label: written.append(label) or keep(df, label))
    assert chain(spark, pages("a", 200)).agg(F.max("page_no")).first()[0] == 199
    assert len(written) <= 2 + 9
