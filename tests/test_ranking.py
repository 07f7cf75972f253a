"""Rank selection against a plain sort."""

import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import history, ordering, ranking


@pytest.fixture
def few(monkeypatch):
    """Searches in rounds, however few the rows."""
    monkeypatch.setattr(ranking, "FEW", 1)
    monkeypatch.setattr(ranking, "SPLITTERS", 3)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.1 else rng.randrange(30), rng.choice(["a", "b", None, ""]), i) for i in range(n)]


def order_key(row, down):
    return [(-(v is not None), [-ord(c) for c in v] if isinstance(v, str) else -v if v is not None else 0) if d else (v is not None, v if v is not None else 0) for v, d in zip(row, down, strict=True)]


@pytest.mark.parametrize("descending", [False, True, ["v"]])
def test_edges_of_all_ranks(spark, few, descending):
    table = rows_of(60)
    frame = spark.createDataFrame(table, "v int, s string, id long").repartition(4)
    down = [descending is True or bool(descending), descending is True]
    plain = sorted(((v, s) for v, s, _ in table), key=lambda r: (order_key(r[:1], down[:1]), order_key(r[1:], down[1:]) if r[1] is None or not down[1] else [(-1, [-ord(c) for c in r[1]] + [0])]))
    for k in (1, 2, 13, 40, 59, 60):
        found = ranking.edge(frame, ["v", "s"], k, descending)
        assert found.values == plain[k - 1]
        assert (found.before, found.equal) == (plain.index(plain[k - 1]), plain.count(plain[k - 1]))
    assert ranking.edge(frame, ["v", "s"], 61, descending) is None


def test_exactly_k_rows_are_left_out(spark, few):
    frame = spark.createDataFrame(rows_of(80), "v int, s string, id long").repartition(4)
    for k in (0, 1, 7, 41, 79, 80, 200):
        got = [r.id for r in ranking.behind(frame, ["v"], k).collect()]
        assert len(got) == len(set(got)) == max(0, 80 - k)
        within = [(r.s, r.id) for r in ranking.behind_within(frame, ["s"], ["v"], k).collect()]
        sizes = {s: sum(r[1] == s for r in rows_of(80)) for s in ("a", "b", None, "")}
        assert {s: sum(x == s for x, _ in within) for s in sizes} == {s: max(0, n - k) for s, n in sizes.items()}


@pytest.mark.parametrize(
    "kind, make",
    [
        ("date", lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(i)), ("double", lambda i: i / 7 - 3), ("binary", lambda i: bytes([i])),
        ("decimal(20,5)", lambda i: decimal.Decimal(i) / 8), ("boolean", lambda i: i > 20), ("string", lambda i: f"é{i:03}'\\"),
        ("timestamp", lambda i: datetime.datetime(2024, 3, 31, 0, 0) + datetime.timedelta(minutes=i, microseconds=i)),
        ("timestamp_ntz", lambda i: datetime.datetime(2024, 3, 31, 0, 0) + datetime.timedelta(minutes=i, microseconds=i)),
    ],
)
def test_types(spark, few, kind, make):
    frame = spark.createDataFrame([(make(i), i) for i in range(40)] + [(None, 99)], f"v {kind}, id int")
    assert sorted(r.id for r in ranking.behind(frame, ["v", "id"], 31, unique=True).collect()) == list(range(30, 40))
    assert sorted(r.id for r in ranking.behind(frame, ["v", "id"], 31, descending=True, unique=True).collect()) == [*range(9), 99]


def test_not_a_number_is_the_greatest(spark, few):
    frame = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (-0.0, 3), (0.0, 4), (None, 5)], "v double, id int")
    assert [r.id for r in ranking.behind(frame, ["v"], 4).collect()] == [1]
    assert sorted(r.id for r in ranking.behind(frame, ["v"], 1, descending=True).collect()) == [2, 3, 4, 5]


def test_one_hot_value_ends_the_search(spark, few):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("v"), "id")
    found = ranking.edge(frame, ["v"], 1500)
    assert (found.values, found.before, found.equal) == ((7,), 3, 2000)
    assert ranking.behind(frame, ["v"], 1500).count() == 1500


def test_nested_orders_are_numbered(spark):
    frame = spark.range(9).select(F.struct("id").alias("s"), "id")
    assert sorted(r.id for r in ranking.behind(frame, ["s"], 6).collect()) == [6, 7, 8]


def test_nothing_is_written_to_find_an_edge(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows were staged")

    monkeypatch.setattr(ordering, "stage", refuse)
    runs = spark.range(500).select(F.col("id").cast("string").alias("id"), F.col("id").alias("started_at"), F.lit(False).alias("pinned"))
    assert history.retention_by_count(runs, 450).count() == 50
    assert ordering.drop_rows(runs, 100, ["started_at"]).count() == 400
    plan = history.retention_by_count(runs, 450)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_sample_moves_only_the_order(spark, monkeypatch):
    staged = []
    keep = ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, label="stage": staged.append(df.columns) or keep(df, label))
    frame = spark.range(1000).select("id", (F.col("id") % 10).alias("v"), F.repeat(F.lit("x"), 50).alias("wide"))
    assert sorted(r.id for r in ordering.sample(frame, 11, ["id"], unique=True).collect()) == [round(i * 99.9) for i in range(11)]
    assert all("wide" not in c for c in staged)
    got = ordering.sample(frame, 21, ["v"]).collect()
    assert len(got) == len({r.id for r in got}) == 21
    want = [round(i * 49.95) // 100 for i in range(21)]
    assert sorted(r.v for r in got) == want
