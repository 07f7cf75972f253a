"""Large JSON lists read in small pieces against the json module and against Spark's own reading."""

import json
import random

import numpy as np
import pytest

from recordloom.sources import files, json_elements


@pytest.fixture
def pieces(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    for k, v in kept.items():
        spark.conf.set(k, v)


def documents(seed, n):
    rng = random.Random(seed)
    texts = ["plain", "}],[{", 'a "quote"', "\\", '\\"', "end \\\\", "é}ü", "line\nend", "", '",{"', "x" * 120, "\\}"]
    return [{"id": i, "s": rng.choice(texts), "o": {"k": rng.choice(texts), "l": [{"m": j, "t": rng.choice(texts)} for j in range(rng.randrange(4))]}} for i in range(n)]


@pytest.mark.parametrize("size, indent", [(30, None), (64, 1), (500, 4), (40, 0)])
def test_rows_as_spark_reads_them(spark, tmp_path, pieces, size, indent):
    values = documents(size, 40)
    (tmp_path / "t.json").write_text(json.dumps(values, indent=indent, ensure_ascii=size > 50))
    own = spark.read.option("multiLine", True).json(str(tmp_path / "t.json"))
    pieces(size)
    got = files.read_json(spark, str(tmp_path / "t.json"))
    assert got.schema == own.schema
    key = lambda r: r.id
    assert sorted(got.collect(), key=key) == sorted(own.collect(), key=key) and got.count() == 40


def test_several_files_with_white_space(spark, tmp_path, pieces):
    (tmp_path / "a.json").write_text("\n [ \n" + ",\n".join(json.dumps(d) for d in documents(1, 9)) + "\n]\n\n")
    (tmp_path / "b.json").write_text(json.dumps(documents(2, 11)) + "\n")
    (tmp_path / "c.json").write_text("[]")
    pieces(50)
    rows = files.read_json(spark, [str(tmp_path / f"{n}.json") for n in "abc"])
    assert sorted(r.id for r in rows.collect()) == sorted([*range(9), *range(11)])


def test_one_element_longer_than_many_pieces(spark, tmp_path, pieces):
    value = {"id": 1, "l": [{"m": f"{{{i}}}"} for i in range(100)]}
    (tmp_path / "t.json").write_text(json.dumps([value, {"id": 2, "l": []}]))
    pieces(60)
    assert {r.id: len(r.l) for r in files.read_json(spark, str(tmp_path / "t.json")).collect()} == {1: 100, 2: 0}


def test_single_documents_are_read_whole(spark, tmp_path, pieces):
    (tmp_path / "t.json").write_text(json.dumps({"items": documents(3, 20)}, indent=1))
    pieces(50)
    assert files.read_json(spark, str(tmp_path / "t.json")).selectExpr("size(items)").first()[0] == 20
    assert files.read_json_table(spark, str(tmp_path / "t.json")).count() == 20


def test_one_list_is_read_by_many_tasks(spark, tmp_path, pieces):
    (tmp_path / "t.json").write_text(json.dumps(documents(4, 300)))
    pieces(2000)
    got = files.read_json(spark, str(tmp_path / "t.json"))
    tasks = got.rdd.glom().map(len).collect()
    assert sum(tasks) == 300 and sum(n > 0 for n in tasks) >= 8


def test_structure_by_walking():
    rng = random.Random(6)
    for _ in range(300):
        raw = "".join(rng.choice('{}[],"\\a') for _ in range(rng.randrange(1, 40)))
        _, odd, steps = json_elements.structure(raw.encode())
        escaped = inside = False
        for i, c in enumerate(raw):
            if c == '"' and not escaped:
                inside = not inside
            escaped = c == "\\" and not escaped
            assert bool(odd[i]) == inside and steps[i] == (c in "{[") - (c in "}]")


def test_lists_of_lists_and_scalars_keep_their_elements(spark, tmp_path, pieces):
    (tmp_path / "t.json").write_text('[{"a": 1}, {"a": [1, 2, {"b": "]"}]}\t,{"a":"}"}]')
    pieces(5)
    lines = files.lines_of(spark, [str(tmp_path / "t.json")], json_elements.END)
    texts = [r.text.strip() for r in json_elements.elements(lines, json_elements.piece_states(lines)).collect()]
    assert sorted(texts) == sorted(['{"a": 1}', '{"a": [1, 2, {"b": "]"}]}', '{"a":"}"}'])
    assert np.array_equal(json_elements.structure(b"[]")[2], [1, -1])
