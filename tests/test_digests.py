"""Digests of parts against a row by row comparison."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.errors import RecordError
from recordloom.operators import digests


def versions(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), rng.random(), [i]) for i in range(400)] + [(7, "again", 0.5, None)] * 3
    right = [r for r in left if r[0] % 50 != 3]
    right = [(i, "new" if i % 90 == 5 else s, v, l) for i, s, v, l in right] + [(1000, "more", 0.0, [])]
    make = lambda rows: spark.createDataFrame(rows, "id int, s string, v double, l array<int>")
    return make(left).repartition(3), make(right).repartition(5)


def test_changed_rows(spark, tmp_path):
    left, right = versions(spark)
    groups = {"words": ["s"], "values": ["v", "l"]}
    a, b = (digests.write_parts(df, f"{tmp_path}/{n}", ["id"], groups, parts=32) for n, df in (("a", left), ("b", right)))
    got = sorted(map(tuple, digests.changed_rows(spark, a, b, ["id"], groups).collect()))
    want = [(i, "left_only", "words,values") for i in range(3, 400, 50)]
    want += [(i, "changed", "words") for i in range(5, 400, 90)] + [(1000, "right_only", "words,values")]
    assert got == sorted(want)
    parts = {(r.part, r.group) for r in digests.changed_parts(spark, a, b).collect()}
    plan = digests.changed_rows(spark, a, b, ["id"], groups)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__part" in plan or "PartitionFilters: [__part" in plan
    assert 0 < len({p for p, _ in parts}) < 32


def test_same_rows_have_the_same_leaves(spark):
    left, _ = versions(spark)
    other = left.select("l", "v", "s", "id").repartition(9)
    assert digests.differing(digests.leaves(left, ["id"]), digests.leaves(other, ["id"])).count() == 0
    nulls = spark.createDataFrame([(1, None, "a"), (1, "a", None)], "id int, x string, y string")
    one, two = nulls.filter("x is null"), nulls.filter("y is null")
    both = {"all": ["x", "y"]}
    assert digests.differing(digests.leaves(one, ["id"], both), digests.leaves(two, ["id"], both)).count() == 1


def test_leaves_combine_upward(spark):
    left, _ = versions(spark)
    found = digests.leaves(left, ["id"], parts=64)
    pick = lambda df: sorted(map(tuple, df.select("part", "group", "rows", "low", "high").collect()))
    assert pick(digests.combined(digests.combined(found, 8))) == pick(digests.combined(found)) == pick(digests.combined(digests.leaves(left, ["id"], parts=5)))


def test_repeated_and_null_keys(spark, tmp_path):
    rows = [(None, "x")] * 2 + [(1, "y")] * 500
    a = digests.write_parts(spark.createDataFrame(rows, "id int, s string"), f"{tmp_path}/a", ["id"])
    b = digests.write_parts(spark.createDataFrame(rows[1:], "id int, s string"), f"{tmp_path}/b", ["id"])
    c = digests.write_parts(spark.createDataFrame(rows, "id int, s string").limit(0), f"{tmp_path}/c", ["id"])
    assert [tuple(r) for r in digests.changed_rows(spark, a, b, ["id"]).collect()] == [(None, "changed", "s")]
    assert sorted(map(tuple, digests.changed_rows(spark, a, c, ["id"]).collect()), key=repr) == [(1, "left_only", "s"), (None, "left_only", "s")]
    assert digests.changed_rows(spark, a, a, ["id"]).count() == 0
    with pytest.raises(RecordError):
        digests.write_parts(spark.range(1).withColumn("__part", F.lit(1)), f"{tmp_path}/d", ["id"])
