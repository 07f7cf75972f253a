"""Record operators on small frames."""

import pytest
from pyspark.sql import functions as F

from recordloom.errors import RecordError
from recordloom.operators import aggregate, filters, ordering, quality, relate, reshape, schema


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [(1, "London", 20, ("Ada",)), (2, "Baltimore", 240, ("Bob",)), (3, "London", 7, ("Cy",))],
        "id long, city string, total long, customer struct<name:string>",
    )


@pytest.fixture(scope="module")
def nested(spark):
    rows = [
        '{"id":1,"customer":{"name":"Ada","address":{"city":"X","zip":"01"}},"tags":["rush","gift"],"total":1.5}',
        '{"id":2,"customer":{"name":"Bob","address":{"city":"Y"}},"tags":[],"total":2.0}',
    ]
    ddl = "id long, customer struct<name:string,address:struct<city:string,zip:string>>, tags array<string>, total double"
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ddl).alias("r")).select("r.*")


def test_flatten(nested):
    flat = reshape.flatten(nested)
    assert flat.columns == ["id", "customer_name", "customer_address_city", "customer_address_zip", "tags", "total"]
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [(1, "Ada", "X", "01", "rush,gift", 1.5), (2, "Bob", "Y", None, None, 2.0)]


def test_flatten_separator_and_depth(nested):
    assert reshape.flatten(nested, sep=".").columns[2] == "customer.address.city"
    shallow = reshape.flatten(nested, max_depth=1)
    assert shallow.columns == nested.columns and shallow.schema["customer"].dataType.typeName() == "struct"


def test_flatten_clash_and_lists(spark):
    row = spark.sql("select 1 a_b, struct(2 b) a, array(1, null, 3) s, array(struct(1 x, cast(null as int) y)) o, array(array(1)) n, array(true) t")
    flat = reshape.flatten(row)
    assert flat.first().asDict() == {"a_b": 1, "a_b_2": 2, "s": "1,,3", "o": '[{"x":1,"y":null}]', "n": "[[1]]", "t": "true"}


def test_explode(spark, rows):
    df = spark.sql("select 1 id, array('a','b') tags union all select 2, array() union all select 3, null")
    assert rows(reshape.explode(df, "tags")) == [(1, "a"), (1, "b"), (2, None), (3, None)]
    objects = spark.sql("select 1 id, array(struct(1 x), struct(2 x)) o union all select 2, array()")
    out = reshape.explode(objects, "o")
    assert out.columns == ["id", "o_x"] and rows(out) == [(1, 1), (1, 2), (2, None)]
    assert rows(reshape.explode_rows(spark.sql("select 1 id, 5 n"), "n")) == [(1, None)]
    taken = spark.sql("select 9 o_x, array(struct(1 x)) o union all select 8, array()")
    assert rows(reshape.explode_rows(taken, "o")) == [(1,), (8,)]


def test_records(spark, rows, orders):
    wrapped = orders.agg(F.collect_list(F.struct("id", "city")).alias("data"), F.count("*").alias("total"))
    assert rows(reshape.records(wrapped)) == rows(orders.select("id", "city"))
    assert rows(reshape.records(spark.sql("select array(1,2) items"))) == [(1,), (2,)]
    named = orders.agg(F.collect_list(F.struct("id")).alias("orders"))
    assert reshape.records(named).columns == ["orders"]
    assert rows(reshape.records(named, search=True)) == [(1,), (2,), (3,)]
    assert reshape.records(orders) is orders


def test_unflatten(spark):
    df = reshape.unflatten(spark.sql("select 1 id, 2 user_id, 3 user_name_first, 4 x, 5 x_y"))
    assert df.first().asDict(recursive=True) == {"id": 1, "user": {"id": 2, "name": {"first": 3}}, "x": {"y": 5}}


def test_align(spark):
    a, b = spark.sql("select 1 id, 'x' s"), spark.sql("select 2 id, 3 n")
    assert reshape.align([a, b]).columns == ["id", "s", "n"]
    assert reshape.align([a, b], "intersection").columns == ["id"]
    assert reshape.align([a, b], "first").columns == ["id", "s"]
    with pytest.raises(RecordError):
        reshape.align([a, b], "some")


def test_select_rename_fill_pluck(orders, rows):
    with pytest.raises(RecordError, match="did you mean 'total'"):
        reshape.select(orders, "totl")
    assert rows(reshape.select(orders, ["id", "zz"], missing="null")) == [(1, None), (2, None), (3, None)]
    assert reshape.rename(orders, {"id": "key", "zz": "y"}).columns[0] == "key"
    assert reshape.fill_nulls(orders, {"note": "none"}).first()["note"] == "none"
    assert rows(reshape.pluck(orders, "zz", 0)) == [(0,), (0,), (0,)]


def test_infer_schema(spark, rows):
    df = spark.createDataFrame([('{"n":1,"s":"a","b":true,"m":1}',), ('{"n":1.5,"s":null,"b":false,"m":"x","z":null}',)], "j string")
    found = {r[0]: tuple(r)[1:] for r in schema.infer_json_schema(df, "j").collect()}
    assert found == {
        "n": ("number", 2, 0), "s": ("string", 2, 1), "b": ("boolean", 2, 0), "m": ("string", 2, 0), "z": ("null", 1, 1),
    }
    assert rows(reshape.json_columns(df, "j", "intersection").select("field")) == [("b",), ("m",), ("n",), ("s",)]
    whole = spark.createDataFrame([('{"a":123456789012345678901,"b":1.0}',)], "j string")
    assert rows(schema.infer_json_schema(whole, "j").select("field", "type")) == [("a", "integer"), ("b", "number")]
    typed = spark.sql("select 1 a, cast(null as string) b")
    assert rows(schema.infer_schema(typed).select("column", "type")) == [("a", "integer"), ("b", "null")]


def test_cast_schema(spark):
    df = spark.sql("select '12.7' a, 'yes' b, '5%' c, 3 d, 'x' e")
    out = schema.cast_schema(df, {"a": "integer", "b": "boolean", "c": "number", "d": "string", "e": "number", "gone": "string"})
    assert out.first().asDict() == {"a": 12, "b": True, "c": 0.05, "d": "3", "e": None}
    with pytest.raises(RecordError):
        schema.cast_schema(df, {"a": "date"})


def test_join(spark, orders, rows):
    reps = spark.createDataFrame([(1, "r1", "L"), (3, "r3", "L"), (9, "r9", "M")], "id long, rep string, city string")
    left = orders.select("id", "city")
    inner = relate.join_records(left, reps, "id")
    assert inner.columns == ["id", "city_x", "rep", "city_y"]
    assert rows(inner) == [(1, "London", "r1", "L"), (3, "London", "r3", "L")]
    assert rows(relate.join_records(left, reps, "id", "left"))[1] == (2, "Baltimore", None, None)
    assert rows(relate.join_records(left, reps, "id", "right"))[2] == (9, None, "r9", "M")
    assert [r[0] for r in rows(relate.join_records(left, reps, "id", "outer"))] == [1, 2, 3, 9]
    for how in ("inner", "left", "right", "outer"):
        assert rows(relate.join_records(left, reps, "id", how, salt=3)) == rows(relate.join_records(left, reps, "id", how))
    with pytest.raises(RecordError, match="no kind of join"):
        relate.join_records(left, reps, "id", "cross")
    with pytest.raises(RecordError, match="right side"):
        relate.join_records(left.withColumn("q", F.lit(1)), reps, "q")


def test_null_keys(spark, rows):
    a = spark.createDataFrame([(None, "a"), (1, "b")], "k int, x string")
    b = spark.createDataFrame([(None, "c"), (2, "d")], "k int, y string")
    assert rows(relate.join_records(a, b, "k")) == [(None, "a", "c")]
    assert rows(relate.join_records(a, b, "k", null_keys="sql")) == []
    assert len(rows(relate.join_records(a, b, "k", "outer"))) == 3
    assert len(rows(relate.join_records(a, b, "k", "outer", null_keys="sql"))) == 4


def test_reconcile(spark, rows):
    api = spark.createDataFrame([(1, 100), (2, 200), (4, 75)], "id long, total long")
    ledger = spark.createDataFrame([(1, 100), (2, 205), (3, 50)], "id long, total long")
    found = rows(relate.reconcile(api, ledger, "id", "total"))
    assert found == [(1, 100, 100, "matched"), (2, 200, 205, "mismatch"), (3, None, 50, "right_only"), (4, 75, None, "left_only")]
    twice = ledger.withColumn("seq", F.lit(1)).unionByName(spark.createDataFrame([(2, 200, 2)], "id long, total long, seq int"))
    assert rows(relate.reconcile(api.withColumn("seq", F.lit(1)), twice, "id", "total", order_by=["seq"]))[1] == (2, 200, 200, "matched")


def test_compare(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "z", None)], "k int, s string, n int")
    b = spark.createDataFrame([(2, "y", 5), (3, "z", None), (4, "w", 0)], "k int, s string, n int")
    found = {r.k: (r.status, [tuple(d) for d in r.diffs] if r.diffs is not None else None) for r in relate.compare(a, b, "k").collect()}
    assert found == {1: ("removed", None), 2: ("changed", [("n", "2", "5")]), 3: ("unchanged", []), 4: ("added", None)}


def test_group(orders, rows):
    assert rows(aggregate.group_agg(orders, "city")) == [("Baltimore", 1), ("London", 2)]
    assert rows(aggregate.group_agg(orders, "city", {"total": "sum"})) == [("Baltimore", 240), ("London", 27)]
    with pytest.raises(RecordError, match="works on numbers"):
        aggregate.group_agg(orders, "id", {"city": "sum"})
    with pytest.raises(RecordError, match="order_by"):
        aggregate.group_agg(orders, "id", {"city": "first"})


def test_group_nulls(spark, rows):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 6, 3), ("a", None, 4), (None, None, 5)], "g string, v int, o int")
    out = aggregate.group_agg(df, "g", {"v": ["count", "sum", "avg", "min", "first", "last"]}, order_by=["o"])
    assert rows(out) == [("a", 2, 11, 5.5, 5, 5, 6), (None, 0, 0, None, None, None, None)]


def test_median(spark):
    for values, expected in (([3, 1, 2], 2.0), ([4, 1, 3, 2], 2.5), ([7], 7.0), ([5, 5, 5, 1], 5.0), ([None, 2], 2.0), ([None], None)):
        df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
        assert aggregate.median(df, "v").first()[0] == expected


def test_any_all_and_path(spark, rows):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 2, None), ("b", 3, "y")], "g string, n int, s string")
    assert rows(aggregate.any_all(df, ["n", "s"], ["g"])) == [("a", True, False, True, False), ("b", True, True, True, True)]
    assert rows(aggregate.any_all(df.limit(0), ["n"])) == [(False, True)]
    odd = spark.sql("select struct('a' k) g, '5' v union all select struct('a'), 'x' union all select struct('b'), 'y'")
    assert rows(aggregate.aggregate_path(odd, "avg", "v", "g.k")) == [("a", 5.0, 2), ("b", 0.0, 1)]


def test_filters(orders, spark, rows):
    ids = lambda df: [r[0] for r in rows(df)]
    assert ids(filters.filter_rows(orders, "total", minimum=10, maximum=100)) == [1]
    assert ids(filters.filter_rows(orders, "city", contains="ondon")) == [1, 3]
    assert ids(filters.filter_rows(orders, "city", minimum=1)) == []
    assert ids(filters.filter_rows(orders, "city", equals=5)) == [] and ids(filters.filter_rows(orders, "id", equals="1")) == []
    assert ids(filters.filter_rows(orders, "id", equals=1)) == [1]
    flags = spark.sql("select 1 id, true b union all select 2, false")
    assert ids(filters.filter_by(flags, "b", "eq", True)) == [1] and ids(filters.filter_rows(flags, "b", equals=False)) == [2]
    lists = spark.sql("select 1 id, array('a') t union all select 2, null")
    assert ids(filters.filter_rows(lists, "t", contains="a")) == [1]
    assert ids(filters.filter_by(orders, "customer.name", "regex", "^A")) == [1]
    assert ids(filters.filter_by(orders, "total", "in", "7, 20")) == [1, 3]
    assert ids(filters.filter_by(orders, "city", "gt", 5)) == []
    assert ids(filters.filter_by(orders, "total", "lt", 100, mode="exclude")) == [2]
    with pytest.raises(RecordError):
        filters.filter_by(orders, "total", "like", 1)


def test_sort_head_pivot(orders, spark):
    assert [r.id for r in relate.sort_by(orders, "total", descending=True).collect()] == [2, 1, 3]
    gaps = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    listed = lambda df: [r.v for r in df.collect()]
    assert listed(relate.sort_by(gaps, "v")) == [None, 1, 2]
    assert listed(relate.sort_by(gaps, "v", True)) == [2, 1, None]
    assert listed(relate.sort_by(gaps, "v", nulls="last")) == [1, 2, None]
    assert [r.id for r in relate.head(orders, 2, ["total"]).collect()] == [3, 1]
    cells = spark.createDataFrame([(1, "a", 5, 1), (1, "a", None, 2), (1, "b", 7, 1), (2, "b", 8, 1)], "i int, c string, v int, o int")
    wide = reshape.pivot(cells, "i", "c", "v", ["o"])
    assert [tuple(r) for r in wide.orderBy("i").collect()] == [(1, None, 7), (2, None, 8)]


def test_dedupe(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (1, None, 2), (None, "c", 3), (None, "d", 4)], "k int, v string, o int")
    assert rows(relate.dedupe(df, "k", ["o"]).select("k", "v")) == [(1, "a"), (None, "c")]
    assert rows(relate.dedupe(df, "k", ["o"], keep="last").select("k", "v")) == [(1, None), (None, "d")]
    assert rows(relate.dedupe(df, "k", ["o"], keep="merge")) == [(1, "a", 2), (None, "d", 4)]
    assert relate.dedupe(df.union(df)).count() == 4


def test_lookup(orders, spark, rows):
    table = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, rep string, seq int")
    out = relate.lookup(orders.select("id"), table, "id", {"rep": "none"}, order_by=["seq"])
    assert rows(out) == [(1, "y"), (2, "none"), (3, "none")]


def test_sample(orders):
    take = lambda n: sorted(r.id for r in ordering.sample(orders, n, ["id"]).collect())
    assert take(2) == [1, 3] and take(1) == [1] and take(0) == [] and take(9) == [1, 2, 3]


def test_names_that_differ_in_case_only(spark, tmp_path):
    df = reshape.flatten(spark.sql("select named_struct('B', 1) a, 2 a_b"))
    assert df.columns == ["a_B", "a_b_2"]
    df.write.parquet(f"{tmp_path}/x")
    assert tuple(spark.read.parquet(f"{tmp_path}/x").first()) == (1, 2)


def test_describe_makes_no_copies_of_rows(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, None, -0.0), (2, "b", 1.5)], "i int, s string, f double")
    found = quality.describe(df)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.column: (r["count"], r.nulls, r.distinct) for r in found.collect()} == {"i": (3, 0, 2), "s": (2, 1, 2), "f": (3, 0, 2)}


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id as string) s", "id / 2 f").write.parquet(f"{tmp_path}/x")
    df = spark.read.parquet(f"{tmp_path}/x")
    cases = [("id", "gte", 90, 10), ("id", "lt", "5", 5), ("s", "eq", 7, 1), ("s", "in", "1, 2,x", 2), ("f", "gt", 49, 1), ("id", "eq", "12", 1), ("id", "in", [3, "4"], 2)]
    for path, operator, value, n in cases:
        got = filters.filter_by(df, path, operator, value)
        assert got.count() == n
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: []" not in plan, (path, operator, plan)
    assert filters.filter_by(df, "id", "gte", 90, mode="exclude").count() == 90
