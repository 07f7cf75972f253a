"""Column functions on literal values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import arith, cast, dates, lists, logic, text

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
lit = F.lit


@pytest.mark.parametrize(
    "given, number, whole",
    [
        ("12.5%", 0.125, 0), ("1,234", 1234.0, 1234), ("$1,234.50", 1234.5, 1234), (" 1_000 ", 1000.0, 1000),
        ("abc", None, None), ("-$5", None, None), ("1e3", 1000.0, 1000), ("5f", None, None), ("€ 7", 7.0, 7),
        ("$5%", None, None), ("99999999999999999", 1e17, 99999999999999999), ("-12.9", -12.9, -12), ("", None, None),
    ],
)
def test_numbers_from_text(value, given, number, whole):
    assert value(cast.number(lit(given), S), cast.integer(lit(given), S)) == [number, whole]


def test_number_from_other_types(value):
    assert value(cast.number(lit(True), B), cast.number(lit(3), L), cast.integer(lit(-2.7), D)) == [1.0, 3.0, -2]
    assert value(cast.number(lit("x"), S, fallback=0.0), cast.integer(lit("x"), S, fallback=7)) == [0.0, 7]
    with pytest.raises(Exception, match="cannot read"):
        value(cast.number(lit("x"), S, strict=True))


@pytest.mark.parametrize(
    "given, expected",
    [("Yes", True), (" on ", True), ("1", True), ("no", False), ("OFF", False), ("", False), ("maybe", True), ("0", False)],
)
def test_booleans(value, given, expected):
    assert value(cast.boolean(lit(given), S)) is expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2024-01-05", dt.datetime(2024, 1, 5)),
        ("2024-1-5", dt.datetime(2024, 1, 5)),
        ("2024-01-05T10:20:30Z", dt.datetime(2024, 1, 5, 10, 20, 30)),
        ("2024-01-05T10:20:30.5+02:00", dt.datetime(2024, 1, 5, 8, 20, 30, 500000)),
        ("2024-01-05T10:20:30-0530", dt.datetime(2024, 1, 5, 15, 50, 30)),
        ("2024-01-05 10:20:30", dt.datetime(2024, 1, 5, 10, 20, 30)),
        ("05/01/2024", dt.datetime(2024, 1, 5)),
        ("01/25/2024", dt.datetime(2024, 1, 25)),
        ("05-Jan-2024", dt.datetime(2024, 1, 5)),
        ("20240105", dt.datetime(2024, 1, 5)),
        (" 2024-01-05 ", dt.datetime(2024, 1, 5)),
        ("2024", None), ("soon", None), ("2024-13-01", None), ("45/45/2024", None),
    ],
)
def test_dates_from_text(value, given, expected):
    assert value(dates.to_date(lit(given), S)) == expected


def test_dates_do_not_depend_on_the_session_zone(spark, value):
    zone = spark.conf.get("spark.sql.session.timeZone")
    expected = [dt.datetime(2024, 1, 5, 8, 20), 1704442800.0, dt.datetime(2024, 1, 5, 10, 10, 30), 2.5]
    d = dates.to_date(lit("2024-01-05T10:20:00+02:00"), S)
    columns = [
        d, dates.timestamp(d), dates.to_date(lit(1704449430), L),
        dates.date_diff(d, dates.date_add(d, days=-2, hours=-12)),
    ]
    try:
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert value(*columns) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_date_shifts_and_formats(value):
    d = dates.to_date(lit("2024-01-05T10:20:30.25"), S)
    assert value(dates.date_add(d, days=1.5, minutes=-3)) == dt.datetime(2024, 1, 6, 22, 17, 30, 250000)
    assert value(dates.date_add(d, hours=-0.5)) == dt.datetime(2024, 1, 5, 9, 50, 30, 250000)
    assert value(dates.date_format(d, "%d %b %Y at %H:%M")) == "05 Jan 2024 at 10:20"
    assert value(dates.date_format(dates.to_date(lit("05-Jan-2024"), S, "%d-%b-%Y"))) == "2024-01-05"
    assert value(dates.to_date(lit(1704449430250), L)) == dt.datetime(2024, 1, 5, 10, 10, 30, 250000)
    with pytest.raises(RecordError):
        dates.date_diff(d, d, "years")


def test_arithmetic(value):
    assert value(arith.floordiv(lit(-7), lit(2)), arith.mod(lit(-7), lit(2)), arith.mod(lit(7), lit(-2))) == [-4, 1, -1]
    assert value(arith.floordiv(lit(10), lit(4)), arith.floordiv(lit(9007199254740993), lit(1))) == [2, 9007199254740993]
    assert value(arith.floordiv(lit(-7.5), lit(2.0), whole=False)) == -4.0
    assert value(arith.round_to(lit(2.5)), arith.round_to(lit(3.5)), arith.round_to(lit(2.567), 1)) == [2, 4, 2.6]
    assert value(arith.power_whole(lit(2), 9), arith.clamp(lit(15), 0, 10), arith.clamp(lit(-1), 0, 10)) == [512, 10, 0]
    assert value(arith.div_safe(lit(1), lit(0), 0.0), arith.div_safe(lit(1), lit(0)), arith.div(lit(1), lit(4))) == [0.0, None, 0.25]
    assert value(arith.repeat_text(lit(3), lit("ab")), arith.repeat_list(lit(2), F.array(lit(1)))) == ["ababab", [1, 1]]
    for broken in (arith.div(lit(1), lit(0)), arith.floordiv(lit(1), lit(0))):
        with pytest.raises(Exception, match="(?i)zero"):
            value(broken)


@pytest.mark.parametrize(
    "given",
    [12345678.0, 1e16, 1.5e16, 1e-5, 0.0001, 0.1 + 0.2, 1e22, 123456789012345.6, 1.25e-7, 0.0005, -12345678.25, 0.0, 1e100, 9999999.5],
)
def test_number_text_reads_like_python(value, given):
    assert value(text.number_text(lit(given))) == str(given)


def test_stringify(value):
    assert value(text.stringify(lit(None).cast("string"), S), text.stringify(lit(True), B), text.stringify(lit(1.5), D)) == ["", "true", "1.5"]
    nested = F.struct(lit(1).alias("a"), lit(None).cast("string").alias("b"))
    kind = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", S)])
    assert value(text.stringify(nested, kind)) == '{"a":1,"b":null}'


def test_text(value):
    assert value(text.trim(lit(" \t a b\n ")), text.trim(lit("xxaxx"), "x")) == ["a b", "a"]
    assert value(text.split(lit("a.b.c"), ".", 1), text.replace(lit("aaa"), "a", "b", 2)) == [["a", "b.c"], "bba"]
    assert value(text.extract(lit("ab12"), r"(\d)(x)?", 2), text.extract(lit("zz"), r"\d"), text.extract(lit("ab12"), r"\d+")) == [None, None, "12"]
    assert value(text.extract_all(lit("a1b2"), r"([a-z])(\d)"), text.extract_all(lit("a1b2"), r"\d")) == [[["a", "1"], ["b", "2"]], ["1", "2"]]
    assert value(text.pad_left(lit("abc"), 2), text.pad_left(lit("7"), 3, "0"), text.pad_right(lit("7"), 3, "-")) == ["abc", "007", "7--"]
    assert value(text.pad_center(lit("ab"), 5, "*"), text.pad_center(lit("abc"), 6, "*")) == ["ab".center(5, "*"), "abc".center(6, "*")]
    assert value(text.title(lit("hello wORLD it's")), text.truncate(lit("abcdefgh"), 5)) == ["Hello World It'S", "ab..."]
    assert value(text.slug(lit(" Héllo, World! ")), text.slug(lit("A b"), False)) == ["h-llo-world", "A-b"]
    assert value(text.url_encode(lit("a b/c~*é"))) == "a%20b%2Fc~%2A%C3%A9"
    assert value(text.format_text("x {} y {} {}", (lit(1), T.IntegerType()), (lit(None), S))) == "x 1 y  {}"
    with pytest.raises(RecordError, match="not in the pattern"):
        text.extract(lit("a"), "a", 1)
    with pytest.raises(RecordError, match="nothing fills"):
        text.template("{a} {z}", {"a": (lit(1), L)})


def test_json(value):
    assert value(text.json_parse(lit("{bad"), strict=False)) is None
    with pytest.raises(Exception):
        value(text.json_parse(lit("{bad")))
    assert value(cast.type_of(F.parse_json(lit('{"a":1}')), T.VariantType()), cast.type_of(lit(None).cast("string"), S)) == ["object", "null"]


def test_logic(value):
    null = lit(None).cast("string")
    assert value(logic.eq(null, null), logic.ne(null, lit("a")), logic.lt(null, lit("a"))) == [True, True, None]
    with pytest.raises(Exception, match="cannot compare null"):
        value(logic.lt(null, lit("a"), strict=True))
    assert value(logic.is_empty(lit(" \t"), S), logic.is_empty(F.array(), T.ArrayType(S)), logic.is_empty(lit(0), L)) == [True, True, False]
    assert value(logic.truthy(lit(0.0), D), logic.truthy(null, S), logic.truthy(lit("0"), S)) == [False, False, True]
    assert value(logic.or_value(lit(0), L, lit(5)), logic.and_value(lit(0), L, lit(5)), logic.default(lit(" "), S, lit("d"))) == [5, 0, "d"]
    assert value(logic.contains(lit("a5b"), S, 5), logic.contains(null, S, "a")) == [True, False]


def test_lists(value):
    a = F.array(*[lit(x) for x in (3, 1, 3, 2)])
    assert value(lists.chunk(a, 3), lists.chunk(F.array().cast("array<int>"), 3)) == [[[3, 1, 3], [2]], []]
    assert value(lists.unique(a), lists.sort(a), lists.sort(a, descending=True)) == [[3, 1, 2], [1, 2, 3, 3], [3, 3, 2, 1]]
    assert value(lists.slice_list(a, 1, -1), lists.slice_list(a, -2), lists.take(a, 2), lists.drop(a, 10)) == [[1, 3], [3, 2], [3, 1], []]
    assert value(lists.item(a, -1), lists.first(a), lists.last(F.array().cast("array<int>"), 9)) == [2, 3, 9]
    assert value(lists.median(a), lists.average(a), lists.total(a), lists.difference(a, F.array(lit(3)))) == [2.5, 2.25, 9.0, [1, 2]]
    assert [tuple(p) for p in value(lists.zip_lists(a, F.array(lit("x"), lit("y"))))] == [(3, "x"), (1, "y")]
    assert value(lists.slice_text(lit("hello"), 1, -1)) == "ell"
    with pytest.raises(Exception):
        value(lists.item(a, 10))
    with pytest.raises(RecordError):
        lists.chunk(a, 0)


def test_lists_of_objects(value):
    item = lambda k, v: F.struct(lit(k).alias("k"), lit(v).alias("v"))
    a = F.array(item(2, "x"), item(1, "y"), item(2, "z"))
    plain = lambda found: [tuple(x) for x in found]
    assert plain(value(lists.unique(a, "k"))) == [(2, "x"), (1, "y")]
    assert plain(value(lists.sort(a, "k"))) == [(1, "y"), (2, "x"), (2, "z")]
    assert plain(value(lists.sort(a, "k", True))) == [(2, "x"), (2, "z"), (1, "y")]
    assert value(lists.pluck(a, "v")) == ["x", "y", "z"]


def test_any_all_of_lists(value):
    kind = T.ArrayType(T.LongType())
    empty, mixed = F.array().cast("array<bigint>"), F.array(lit(0), lit(None), lit(2)).cast("array<bigint>")
    assert value(lists.any_of(empty, kind), lists.all_of(empty, kind)) == [False, True]
    assert value(lists.any_of(mixed, kind), lists.all_of(mixed, kind)) == [True, False]


def test_objects(value):
    m, n = F.create_map(lit("a"), lit(1), lit("b"), lit(2)), F.create_map(lit("b"), lit(9), lit("c"), lit(3))
    assert value(lists.merge(m, n), lists.pick(m, "a", "z"), lists.omit(m, "a")) == [{"a": 1, "b": 9, "c": 3}, {"a": 1}, {"b": 2}]
    left, right = F.struct(lit(1).alias("a"), lit(2).alias("b")), F.struct(lit(9).alias("b"))
    kinds = [T.StructType([T.StructField(n, T.IntegerType()) for n in names]) for names in ("ab", "b")]
    assert value(lists.merge_structs(left, kinds[0], right, kinds[1])).asDict() == {"a": 1, "b": 9}
    assert value(lists.omit_struct(left, kinds[0], "a", "zz")).asDict() == {"b": 2}


def test_named_groups(spark):
    c = F.lit("id=42;name=x")
    for pattern in (r"id=(?<id>\d+);name=(\w)", r"id=(?P<id>\d+);name=(\w)"):
        row = spark.range(1).select(text.extract(c, pattern, "id"), text.extract(c, pattern, 2), text.extract_all(c, pattern)).first()
        assert tuple(row) == ("42", "x", [["42", "x"]])
    one = spark.range(1).select(text.extract_all(c, r"(?<=[=(])(?:\w)[)(]?\(?(?<n>\d)?")).first()[0]
    assert one[0] == "2"
    with pytest.raises(RecordError):
        text.extract(c, r"(?<id>\d+)", "name")
