"""Outer joins in one shuffle a side, with keys that hold most rows of one side or of both."""

import random

import pytest

from recordloom.operators import relate

ROWS = {
    "none": ([], []),
    "left": ([(1, None, "x")] * 3, []),
    "right": ([], [(None, None, "y")] * 2),
}


def made(seed):
    draw = random.Random(seed)
    key = lambda hot: draw.choice([hot] * 6 + [None, 1, 2, 3, 4, 5, 6, 7])
    left = [(key(9), draw.choice(["u", "v", None]), f"l{i % 50}") for i in range(150)]
    right = [(key(8), draw.choice(["u", "w", None]), f"r{i % 30}") for i in range(90)]
    return left + [(None, None, "l")] * 20, right + [(None, None, "r")] * 20


def joined(left, right, null_keys):
    same = lambda a, b: a == b and (null_keys == "match" or None not in a)
    rows = [(*x[:2], x[2], y[2]) for x in left for y in right if same(x[:2], y[:2])]
    rows += [(*x, None) for x in left if not any(same(x[:2], y[:2]) for y in right)]
    return rows + [(*y[:2], None, y[2]) for y in right if not any(same(x[:2], y[:2]) for x in left)]


@pytest.fixture
def frames(spark):
    return lambda left, right: tuple(spark.createDataFrame(r, "`k.1` int, s string, v string").repartition(4) for r in (left, right))


@pytest.mark.parametrize("hot_rows", [3, 100_000])
@pytest.mark.parametrize("null_keys", ["match", "sql"])
@pytest.mark.parametrize("case", [*ROWS, 1, 2])
def test_same_as_nested_loops(frames, rows, monkeypatch, case, null_keys, hot_rows):
    monkeypatch.setattr(relate, "HOT_ROWS", hot_rows)
    left, right = ROWS[case] if case in ROWS else made(case)
    got = relate.join_records(*frames(left, right), ["k.1", "s"], "outer", null_keys=null_keys)
    assert got.columns == ["k.1", "s", "v_x", "v_y"]
    assert rows(got) == sorted(joined(left, right, null_keys), key=repr)


def test_hot_keys_are_dealt_to_parts(frames, monkeypatch):
    monkeypatch.setattr(relate, "HOT_ROWS", 10)
    monkeypatch.setattr(relate, "HOT_PARTS", 20)
    left, right = frames([(1, "a", str(i)) for i in range(900)] + [(i, "a", "") for i in range(100)], [(1, "a", "r"), (2, "b", "r")])
    a, b = relate._prefixed(left, "a"), relate._prefixed(right, "b")
    hot = relate._hot(a, "a", ["k.1", "s"], True, "match")
    assert [(r[0], r[2].n) for r in hot.collect()] == [(1, 20)]
    parts = relate._dealt(a, "a", ["k.1", "s"], hot, "match").filter("`a.k.1` = 1").groupBy("`__a.part`").count().collect()
    assert len(parts) == 20 and max(r["count"] for r in parts) < 150
    assert relate._dealt(b, "b", ["k.1", "s"], hot, "match").count() == 21


def test_one_join_of_rows(frames):
    left, right = frames(*made(3))
    plan = relate.join_records(left, right, ["k.1", "s"], "outer")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and "LeftAnti" not in plan


def test_rows_with_maps(spark):
    left = spark.sql("SELECT 1 AS k, map('a', 1) AS m UNION ALL SELECT 2, map()")
    got = relate.join_records(left, spark.sql("SELECT 2 AS k, 'z' AS w UNION ALL SELECT 3, 'y'"), "k", "outer").collect()
    assert sorted((r.k, r.m, r.w) for r in got) == [(1, {"a": 1}, None), (2, {}, "z"), (3, None, "y")]


def test_a_broadcast_table_is_not_repeated_by_salt(spark):
    left, right = spark.range(100).selectExpr("id % 3 AS k", "id AS x"), spark.range(3).selectExpr("id AS k", "id * 10 AS y")
    small = relate.join_records(left, right, "k", salt=4)
    assert "explode" not in small._jdf.queryExecution().optimizedPlan().toString().lower()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = relate.join_records(left, right, "k", salt=4)
        assert "explode" in large._jdf.queryExecution().optimizedPlan().toString().lower()
        assert sorted(large.collect()) == sorted(small.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
