"""CSV read in small pieces against the csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.sources import csv_records, files
from recordloom.sources.pieces import lines_of


@pytest.fixture
def pieces(spark):
    """Files are read in pieces of so many bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size if size > 1000 else 1))

    yield cut
    for k, v in kept.items():
        spark.conf.set(k, v)


def table(seed, n):
    rng = random.Random(seed)
    words = ["plain", "with, comma", 'a "quote"', "two\nlines", "three\n\n\nlines", '"', '",\n"', "long " * 30 + "\nend", "", 'x""y', "é\r\nü", " padded "]
    return [[f"k{i}", rng.choice(words), rng.choice(words)] for i in range(n)]


def written(rows, end="\n"):
    text = io.StringIO()
    csv.writer(text, lineterminator=end).writerows([["key", "a", "b"], *rows])
    return text.getvalue()


@pytest.mark.parametrize("size, end", [(16, "\n"), (50, "\r\n"), (333, "\n"), (1 << 20, "\n")])
def test_against_the_csv_module(spark, tmp_path, pieces, size, end):
    rows = table(size, 60)
    (tmp_path / "t.csv").write_text(written(rows, end), newline="")
    pieces(size)
    got = files.read_csv(spark, str(tmp_path / "t.csv"))
    want = sorted(tuple(None if c in files.MISSING else c for c in r) for r in rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    if size < 1000:
        assert lines_of(spark, [str(tmp_path / "t.csv")]).rdd.getNumPartitions() > 5


def test_a_cell_longer_than_many_pieces(spark, tmp_path, pieces):
    cell = "\n".join(f"line {i}" for i in range(200))
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{cell}"\n2,z\n')
    pieces(40)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t.csv")).collect())) == [(1, cell), (2, "z")]


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path, pieces):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,x\n6" pipe,"y\nz"\n')
    pieces(8)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t.csv")).collect())) == [('5" pipe', "x"), ('6" pipe', "y\nz")]


def test_files_with_other_headers(spark, tmp_path, pieces):
    (tmp_path / "a.csv").write_text('id,s\n1,"x\ny"\n')
    (tmp_path / "b.csv").write_text("n,id\n5,2\n")
    (tmp_path / "c.csv").write_text('"two\nlines",id\n7,3\n')
    pieces(12)
    got = files.read_csv(spark, [str(tmp_path / f) for f in ("a.csv", "b.csv")])
    assert sorted(map(tuple, got.select("id", "s", "n").collect())) == [(1, "x\ny", None), (2, None, 5)]
    pieces(1 << 20)
    assert files.read_csv(spark, str(tmp_path / "c.csv")).columns == ["two\nlines", "id"]


def test_a_schema_goes_by_place(spark, tmp_path, pieces):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n007,z\n')
    pieces(10)
    schema = T.StructType([T.StructField("p", T.StringType()), T.StructField("q", T.StringType())])
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t.csv"), schema=schema).collect())) == [("007", "z"), ("1", "x\ny")]


def test_short_long_and_blank_rows(spark, tmp_path, pieces):
    (tmp_path / "t.csv").write_text('\na,b\n\n"1\n",\n2\n3,4,5\n\n"open,6\n')
    pieces(9)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "t.csv")).collect()), key=repr) == sorted([("1\n", None), ("2", None), ("3", 4), ('open,6', None)], key=repr)


def test_torn_headers_and_empty_files(spark, tmp_path, pieces):
    (tmp_path / "t.csv").write_text('"a\n' + "very long\n" * 20 + 'name",b\n1,2\n')
    pieces(30)
    with pytest.raises(RecordError, match="header"):
        files.read_csv(spark, str(tmp_path / "t.csv"))
    (tmp_path / "e.csv").write_text("a,b\n")
    assert files.read_csv(spark, str(tmp_path / "e.csv")).columns == ["a", "b"]


def test_ends_inside():
    inside = csv_records.ends_inside
    assert not inside('a,"b",c', False, ",") and inside('a,"b', False, ",") and not inside('a,b"', False, ",")
    assert inside("plain", True, ",") and not inside('x",y', True, ",") and inside('x","y', True, ",")
    assert inside('x""', True, ",") and not inside('x"""', True, ",") and inside('"a""', False, ",")
    assert inside('a\t"b', False, "\t") and not inside('a,"b', False, "\t")


def test_lines_without_line_ends_in_cells_are_read_by_spark(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n')
    plan = files.read_csv(spark, str(tmp_path / "t.csv"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "FileScan csv" in plan
