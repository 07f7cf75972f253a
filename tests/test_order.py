"""Order-dependent operators under many layouts, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import aggregate, history, ordering, recipes

SIZE = 3000


@pytest.fixture(scope="module")
def data():
    chance = random.Random(5)
    # Key 0 holds about two thirds of the rows, and half the rows are copies of one.
    return [
        (i, 0 if chance.random() < 0.66 else chance.randrange(1, 40), chance.choice([1, 1, 1, chance.randrange(50)]), chance.random() < 0.3)
        for i in range(SIZE)
    ]


@pytest.fixture(params=[1, 4, 24])
def frame(spark, data, request):
    chance = random.Random(request.param)
    shuffled = data[:]
    chance.shuffle(shuffled)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(shuffled, "id long, k int, v int, ok boolean").repartition(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_number_rows(frame, data):
    wanted = {r[0]: i for i, r in enumerate(sorted(data, key=lambda r: (r[2], r[0])), 1)}
    assert {r.id: r.row_number for r in ordering.number_rows(frame, ["v", "id"], unique=True).collect()} == wanted


def test_ties_keep_every_number_once(frame):
    found = [r.n for r in ordering.number_rows(frame.select("v"), ["v"], "n").collect()]
    assert sorted(found) == list(range(1, SIZE + 1))


def test_number_within(frame, data):
    wanted, seen = {}, {}
    for r in sorted(data, key=lambda r: (r[1], -r[0])):
        seen[r[1]] = wanted[r[0]] = seen.get(r[1], 0) + 1
    got = ordering.number_within(frame, ["k"], ["id"], "n", descending=True, unique=True)
    assert {r.id: r.n for r in got.collect()} == wanted


def test_running_sum(frame, data):
    rows = ordering.sequence_rows(frame, ["k"], ["id"], unique=True)
    got = {r.id: r.total for r in ordering.running_sum(rows, ["k"], "total", F.col("v")).collect()}
    totals, wanted = {}, {}
    for i, k, v, _ in sorted(data):
        totals[k] = wanted[i] = totals.get(k, 0) + v
    assert got == wanted


def test_group_parts_are_bounded_and_whole(frame, data):
    parts = aggregate.group_records(frame, "k", ["id"], rows_per_part=100, unique=True).collect()
    assert max(len(p["items"]) for p in parts) <= 100
    joined = {}
    for p in sorted(parts, key=lambda p: (p.k, p.part)):
        joined.setdefault(p.k, []).extend(x.id for x in p["items"])
    wanted = {}
    for i, k, *_ in sorted(data):
        wanted.setdefault(k, []).append(i)
    assert joined == wanted


def test_trailing_blocks(frame, data):
    got = ordering.trailing(frame, ["id"], 7, {"m": lambda over: over(F.sum("v"))}, unique=True, halo_rows=50)
    values = [r[2] for r in sorted(data)]
    assert {r.id: r.m for r in got.collect()} == {i: sum(values[max(0, i - 6) : i + 1]) for i in range(SIZE)}


def test_outages(frame, data):
    wanted, state = [], {}
    for i, k, _, ok in sorted(data):
        streak = state.setdefault(k, [])
        if not ok:
            streak.append(i)
            continue
        if len(streak) >= 5:
            wanted.append((k, len(streak), streak[0], streak[4], i))
        state[k] = []
    wanted += [(k, len(s), s[0], s[4], None) for k, s in state.items() if len(s) >= 5]
    requests = frame.withColumn("t", F.col("id"))
    got = history.outage_intervals(requests, "k", "t", "ok", "id")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_retention_by_size(frame, data):
    got = {
        r.id: r.verdict
        for r in history.retention_by_size(frame, 500, F.lit(0), size="v", accessed="id", expires=None, tie="k").collect()
    }
    left, total = {}, sum(r[2] for r in data)
    for i, _, v, _ in sorted(data):
        left[i] = "evicted" if total > 500 else "kept"
        total -= v if left[i] == "evicted" else 0
    assert got == left


def test_moving_average(frame, data):
    got = {r.id: r.moving_average for r in recipes.moving_average(frame, "v", ["id"], width=3, unique=True).collect()}
    values = [r[2] for r in sorted(data)]
    assert got[0] is None and got[1] is None
    assert all(abs(got[i] - sum(values[i - 2 : i + 1]) / 3) < 0.006 for i in range(2, SIZE))


def test_sample_positions(frame, data):
    ids = [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
    got = sorted(r.id for r in ordering.sample(frame, 11, ["v", "id"], unique=True).collect())
    assert got == sorted(ids[round(i * (SIZE - 1) / 10)] for i in range(11))


def test_limits_of_any_size_follow_one_rule(spark, data):
    frame = spark.createDataFrame(data, "id long, k int, v int, ok boolean")
    for k in (1, 3, 50, SIZE + 1):
        got = ordering.top_k(frame, ["k"], ["v"], k).select("k", "v", "rank").collect()
        wanted = []
        for key in {r[1] for r in data}:
            values = sorted((r[2] for r in data if r[1] == key), reverse=True)[:k]
            wanted += [(key, v, i) for i, v in enumerate(values, 1)]
        assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    for keep in (1, 2, 100, SIZE - 1, SIZE + 1):
        gone = history.retention_by_count(frame.withColumn("t", F.lit(1)), keep, time="t", tie="ok", pinned=None)
        assert gone.count() == max(0, SIZE - keep)


def test_retention_takes_null_times_for_the_oldest(spark):
    rows = [(i, None if i % 3 == 0 else i, "w") for i in range(9)]
    frame = spark.createDataFrame(rows, "id int, started_at int, workflow string")
    for scope in ((), ("workflow",)):
        gone = history.retention_by_count(frame, 4, pinned=None, scope=scope)
        assert sorted(r.id for r in gone.collect()) == [0, 1, 2, 3, 6]
        assert sorted(r.id for r in history.retention_by_count(frame, 7, pinned=None, scope=scope).collect()) == [0, 3]


def test_median_of_a_hot_value(frame, data):
    import statistics

    assert aggregate.median(frame, "v").first()[0] == statistics.median(r[2] for r in data)


def test_staged_files_can_be_dropped(spark):
    from recordloom import session

    session.stage(spark.range(3))
    assert session.drop_staged(spark) > 0 and session.drop_staged(spark) == 0


def test_rows_of_spanning_keys_are_not_shuffled_by_a_wide_key(spark):
    rows = ordering.sequence_rows(spark.range(2000).selectExpr("if(id % 3 = 0, null, 'k' || id % 2) AS k", "id AS n"), ["k"], ["n"], unique=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ordering.spanning_rows(rows, ["k"])
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        firsts = {r.k for r in rows.filter(f"{ordering.PLACE} = 0").collect()}
        assert {r.k for r in found.select("k").distinct().collect()} == firsts
        assert found.count() == sum(1 for r in rows.collect() if r.k in firsts)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
