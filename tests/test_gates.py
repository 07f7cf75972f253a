"""Quality gates and contracts."""

import json

import pytest
from pyspark.sql import functions as F

from recordloom.errors import GateFailed, RecordError
from recordloom.operators import contracts, quality


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "a", None), (2, None, None), (2, "c", None)], "id int, s string, z double")


def test_schema(df, rows):
    assert rows(quality.check_schema(df, {"id": "number", "s": "string", "z": "integer"})) == []
    assert rows(quality.check_schema(df, {"s": "number", "q": "string"})) == [("q", "missing", "string", None), ("s", "type", "number", "string")]
    assert rows(quality.check_schema(df, {"id": "integer", "s": "string"}, strict=True)) == [("z", "extra", None, "number")]
    assert quality.assert_schema(df, {"id": "integer"}) is df
    with pytest.raises(GateFailed, match="s: type") as caught:
        quality.assert_schema(df, {"s": "number"})
    assert caught.value.code == 4


def test_rowcount(df):
    assert quality.assert_rowcount(df, minimum=3, maximum=3, exactly=3) is df
    for checks in ({"minimum": 4}, {"maximum": 2}, {"exactly": 1}):
        with pytest.raises(GateFailed, match="found 3"):
            quality.assert_rowcount(df, **checks)


def test_unique(df, rows, spark):
    assert rows(quality.check_unique(df, "id")) == [(2, 2)]
    assert quality.assert_unique(df, ["id", "s"]) is df
    nulls = spark.createDataFrame([(None,), (None,)], "k int")
    with pytest.raises(GateFailed):
        quality.assert_unique(nulls, "k")


def test_no_nulls(df, rows):
    assert rows(quality.check_no_nulls(df)) == [("s", 1), ("z", 3)]
    assert rows(quality.check_no_nulls(df, "id", "gone")) == [("gone", 3)]
    assert quality.assert_no_nulls(df, "id") is df
    with pytest.raises(GateFailed, match=r"s \(1\), z \(3\)"):
        quality.assert_no_nulls(df)


def test_fused_gate(df, rows):
    found = {r.check: r.ok for r in quality.gate(df, rows=(1, 2), no_nulls=["id", "s"], that={"small": F.max("id") < 5}).collect()}
    assert found == {"rowcount": False, "no_nulls:id": True, "no_nulls:s": False, "small": True}
    assert quality.assert_that(df, F.sum("id") == 5) is df
    with pytest.raises(GateFailed, match="total"):
        quality.assert_that(df, F.sum("id") > 5, "total above 5")
    with pytest.raises(GateFailed):
        quality.assert_that(df, F.sum("z") > 0)  # unknown is not true


def test_observed(df):
    frame, watch = quality.observed(df, "counts", rows=F.count("*"), top=F.max("id"))
    frame.collect()
    assert watch.get == {"rows": 3, "top": 2}


def test_profile_and_describe(df, rows):
    assert rows(quality.profile(df)) == [("id", "integer", 3, 0), ("s", "string", 3, 1), ("z", "null", 3, 3)]
    assert rows(quality.describe(df)) == [("id", 3, 0, 2, 1.0, 2.0, 5 / 3), ("s", 2, 1, 2, None, None, None), ("z", 0, 3, 0, None, None, None)]
    assert rows(quality.describe(df, approximate=True).select("distinct")) == [(0,), (2,), (2,)]


def test_redact(spark):
    row = spark.sql("select 'key abcdef end' a, array('abcd', null) b, struct('xabcdefx' c, 5 n) s, map('abcd', 'abcdef') m, cast(null as struct<t:string>) z")
    out = quality.redact(row, ["abcd", "abcdef"]).first().asDict(recursive=True)
    mask = "[redacted]"
    assert out == {"a": f"key {mask} end", "b": [mask, None], "s": {"c": f"x{mask}x", "n": 5}, "m": {"abcd": mask}, "z": None}
    with pytest.raises(RecordError):
        quality.redact(row, ["abc"])


def test_export_safety(spark, rows):
    df = spark.sql("select 9007199254740993 big, 9007199254740992 edge, 1e17D f, 1.5D g, timestamp'2024-01-01' t, 'x' s")
    assert rows(quality.export_safety(df)) == [("big", "beyond 2^53", 1), ("f", "beyond 2^53", 1), ("t", "zoned time", 1)]


# -- contracts --------------------------------------------------------------------


def broken(spark, document, contract):
    df = spark.createDataFrame([(document if isinstance(document, str) else json.dumps(document),)], "j string")
    return sorted((r.path, r.rule) for r in contracts.contract_violations(df, "j", contract).collect())


@pytest.mark.parametrize(
    "document, contract, expected",
    [
        ({"a": 1}, {"type": "object", "required": ["a", "b"]}, [("$", "required")]),
        ({"a": None}, {"required": ["a"]}, []),
        ({"a": None}, {"properties": {"a": {"type": "string"}}}, [("$.a", "type")]),
        ({"a": [{"id": 1}, {"id": "x"}, 5]}, {"properties": {"a": {"items": {"type": "object", "properties": {"id": {"type": "integer"}}}}}},
         [("$.a[1].id", "type"), ("$.a[2]", "type")]),
        ([1, 2.5, True], {"type": "array", "items": {"type": "number"}}, [("$[2]", "type")]),
        (1, {"type": "integer"}, []),
        (1.5, {"type": "integer"}, [("$", "type")]),
        (1, {"type": "number"}, []),
        (True, {"type": "integer"}, [("$", "type")]),
        ("x", {"enum": ["x", "y"]}, []),
        ("z", {"enum": ["x", 1, None]}, [("$", "enum")]),
        (1.0, {"enum": [1]}, []),
        (None, {"enum": [None]}, []),
        (5, {"minimum": 6}, [("$", "minimum")]),
        (5, {"minimum": 5, "maximum": 5}, []),
        ("5", {"maximum": 9}, [("$", "maximum")]),
        (True, {"minimum": 0}, [("$", "minimum")]),
        ("ab", {"minLength": 3, "maxLength": 1, "pattern": "^c"}, [("$", "maxLength"), ("$", "minLength"), ("$", "pattern")]),
        ([1], {"minItems": 2, "maxItems": 0}, [("$", "maxItems"), ("$", "minItems")]),
        ({"it's": 1}, {"properties": {"it's": {"type": "string"}}}, [("$.it's", "type")]),
        ("{bad", {"type": "object"}, []),
        ([], {"type": "object", "required": ["a"]}, [("$", "type")]),
    ],
)
def test_contract(spark, document, contract, expected):
    if document == "{bad":
        assert broken(spark, "{bad", contract) == [("$", "json")]
    elif isinstance(document, str):
        assert broken(spark, json.dumps(document), contract) == expected
    else:
        assert broken(spark, document, contract) == expected


def test_references(tmp_path, spark):
    (tmp_path / "common.json").write_text(json.dumps({"id": {"type": "integer"}}))
    own = tmp_path / "own.json"
    contract = {"properties": {"a": {"$ref": "common.json#/id"}, "b": {"$ref": "#/defs/t"}}, "defs": {"t": {"type": "string"}}}
    own.write_text(json.dumps(contract))
    df = spark.createDataFrame([('{"a":"x","b":1}',)], "j string")
    found = contracts.contract_violations(df, "j", contract, source=own).collect()
    assert sorted(r.path for r in found) == ["$.a", "$.b"]
    for bad in ({"$ref": "http://x"}, {"$ref": "#/none"}, {"$ref": 5}, {"$ref": "other.json"}):
        with pytest.raises(RecordError):
            contracts.resolve(bad)
    with pytest.raises(RecordError, match="outside"):
        contracts.resolve({"$ref": "../x.json"}, own)
    loop = {"$ref": "#/a", "a": {"properties": {"x": {"$ref": "#/a"}}}}
    with pytest.raises(RecordError, match="itself"):
        contracts.resolve(loop)


def test_assert_contract(spark):
    df = spark.createDataFrame([('{"a":1}',)], "j string")
    assert contracts.assert_contract(df, "j", {"type": "object"}) is df
    with pytest.raises(GateFailed, match=r"\$\.a: type"):
        contracts.assert_contract(df, "j", {"properties": {"a": {"type": "string"}}})


def test_generate(spark):
    rows = [{"id": 1, "tags": ["a"], "o": {"x": 1}, "l": [{"id": 1, "n": "a"}, {"id": 2}]}, {"id": "b", "tags": [], "o": {"x": 2, "y": True}, "l": []}]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    made = contracts.generate(df, "j")
    assert made == {
        "type": "object",
        "required": ["id", "l", "o", "tags"],
        "properties": {
            "id": {},
            "l": {"type": "array", "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "n": {"type": "string"}}}},
            "o": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}, "y": {"type": "boolean"}}},
            "tags": {"type": "array", "items": {"type": "string"}},
        },
    }
    assert contracts.contract_violations(df, "j", made).count() == 0


def _deep(levels, leaf=1):
    value = leaf
    for _ in range(levels):
        value = {"a": value}
    return json.dumps(value)


def test_paths_of_any_depth(spark):
    frame = spark.createDataFrame([(_deep(40),), (_deep(2),), ('{"a": [[[1, {"b": null}]]]}',)], "body string")
    found = {(r.path, r.type): r.n for r in contracts.observed_paths(frame, "body").collect()}
    assert found["$" + ".a" * 40, "integer"] == 1 and found["$" + ".a" * 17, "object"] == 1 and found["$", "object"] == 3
    assert found["$.a[][][].b", "null"] == 1 and found["$.a.a", "integer"] == 1
    assert len({p for p, _ in found if set(p) <= set("$.a")}) == 41
    cut = contracts.observed_paths(frame, "body", max_depth=3)
    assert {r.path for r in cut.collect()} == {"$", "$.a", "$.a.a", "$.a[]"}


def test_paths_of_nothing(spark):
    for rows in ([], [("no json",)], [(None,)]):
        frame = spark.createDataFrame(rows, "body string")
        assert contracts.observed_paths(frame, "body").count() == 0 and contracts.generate(frame, "body") == {}


def test_generated_contract_reaches_the_leaf(spark):
    frame = spark.createDataFrame([(_deep(24),)], "body string")
    made = contracts.generate(frame, "body")
    node = made
    for _ in range(24):
        node = node["properties"]["a"]
    assert node == {"type": "integer"}
    assert contracts.contract_violations(frame, "body", made).count() == 0
    other = spark.createDataFrame([(_deep(24, "text"),)], "body string")
    assert [r.rule for r in contracts.contract_violations(other, "body", made).collect()] == ["type"]


def test_references_that_end_and_that_do_not(spark):
    leaf = {"type": "integer"}
    nested = leaf
    for _ in range(40):
        nested = {"properties": {"a": nested}}
    assert contracts.resolve({"$ref": "#/d/x", "d": {"x": nested}}) == nested
    twice = {"properties": {"p": {"$ref": "#/d/n"}, "q": {"$ref": "#/d/n"}}, "d": {"n": leaf}}
    assert contracts.resolve(twice)["properties"] == {"p": leaf, "q": leaf}
    with pytest.raises(RecordError, match="itself"):
        contracts.resolve({"$ref": "#/d/n", "d": {"n": {"properties": {"again": {"$ref": "#/d/n"}}}}})
