"""Files, tables, digests, publication, streams, user functions."""

import datetime as dt
import decimal
import json
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom import registry
from recordloom.errors import GateFailed, RecordError
from recordloom.operators import publish, quality
from recordloom.sources import files, tables
from recordloom.streaming import gates


# -- files ------------------------------------------------------------------------


def test_csv_types(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('code,n,f,b,s,gap,none\n00123,1,1.5,True,"x, ""y""\nz",5,\n7,2,2,False,NA,,\n')
    df = files.read(spark, str(path))
    assert dict(df.dtypes) == {"code": "string", "n": "bigint", "f": "double", "b": "boolean", "s": "string", "gap": "bigint", "none": "string"}
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("00123", 1, 1.5, True, 'x, "y"\nz', 5, None), ("7", 2, 2.0, False, None, None, None)]


def test_tsv_and_errors(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("a\tb\n1\t2,5\n")
    assert files.read(spark, str(path)).first().asDict() == {"a": 1, "b": "2,5"}
    files.save(spark.sql("select 1 a, 'x,y' b"), str(tmp_path / "b.tsv"))
    assert files.read(spark, str(tmp_path / "b.tsv")).first().asDict() == {"a": 1, "b": "x,y"}
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(RecordError, match="is empty"):
        files.read(spark, str(tmp_path / "empty.csv"))
    for path in ("x.txt", "x"):
        with pytest.raises(RecordError, match="formats"):
            files.format_of(path)
    assert files.format_of("x.txt", "csv") == "csv"


def test_json_tables(spark, tmp_path, rows):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"total": 2, "orders": [{"id": 1, "c": {"n": "a"}}, {"id": 2}]}, indent=2))
    assert rows(files.read_json_table(spark, str(path)).select("id", "c_n")) == [(1, "a"), (2, None)]
    lines = tmp_path / "b.jsonl"
    lines.write_text('{"a":1}\n\n{"a":2,"b":"x"}\n')
    assert rows(files.read(spark, str(lines))) == [(1, None), (2, "x")]


def test_round_trips(spark, tmp_path):
    schema = "id long, code string, money decimal(12,2), at timestamp, note string, big long"
    row = (1, "007", decimal.Decimal("1.00"), dt.datetime(2024, 1, 2, 3, 4, 5), None, 123456789012345678)
    df = spark.createDataFrame([row], schema)
    files.save(df, str(tmp_path / "a.parquet"))
    assert tuple(files.read(spark, str(tmp_path / "a.parquet")).first()) == row
    files.convert(spark, str(tmp_path / "a.parquet"), str(tmp_path / "b.csv"))
    back = files.read(spark, str(tmp_path / "b.csv")).first()
    assert (back.code, back.big, back.note) == ("007", 123456789012345678, None)
    files.save(df.select("id", "note"), str(tmp_path / "c.ndjson"))
    text = "".join(p.read_text() for p in (tmp_path / "c.ndjson").glob("part-*"))
    assert text == '{"id":1,"note":null}\n'
    empty = files.save(df.limit(0), str(tmp_path / "d.parquet"))
    assert files.read(spark, empty).count() == 0 and files.read(spark, empty).columns == df.columns


def _text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_save_keeps_the_rows_given(spark, tmp_path, rows):
    df = spark.sql("select 7 id, array(struct(1 n, struct('a' name) customer)) items union all select 8, array(struct(2, struct('b')))").orderBy("id").coalesce(1)
    files.save(df, str(tmp_path / "a.csv"))
    assert _text(tmp_path / "a.csv") == 'id,items\n7,"[{""n"":1,""customer"":{""name"":""a""}}]"\n8,"[{""n"":2,""customer"":{""name"":""b""}}]"\n'
    files.save(df, str(tmp_path / "a.parquet"))
    assert rows(files.read(spark, str(tmp_path / "a.parquet")).select("id")) == [(7,), (8,)]
    with pytest.raises(RecordError, match="columns="):
        files.save(df, str(tmp_path / "b.csv"), columns="unoin")
    files.save(df, str(tmp_path / "c.csv"), columns=["id"])
    assert _text(tmp_path / "c.csv") == "id\n7\n8\n"


def test_csv_lists_and_folders(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n")
    (tmp_path / "b.csv").write_text("b,a\ny,2\n")
    both = files.read(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert rows(both.select("a", "b")) == [(1, "x"), (2, "y")]
    files.save(spark.range(4).repartition(3), str(tmp_path / "f1.csv"))
    files.save(spark.range(4, 6).selectExpr("'t' s", "id"), str(tmp_path / "f2.csv"))
    assert rows(files.glob_read(spark, f"{tmp_path}/f*.csv").select("id", "s")) == sorted([(i, None) for i in range(4)] + [(i, "t") for i in (4, 5)], key=repr)


def test_glob(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("id,s\n1,x\n")
    (tmp_path / "b.csv").write_text("id,n\n2,5\n")
    (tmp_path / "c.csv").write_text("id,s\n3,z\n")
    assert rows(files.glob_read(spark, f"{tmp_path}/*.csv").select("id", "s", "n")) == [(1, "x", None), (2, None, 5), (3, "z", None)]
    parts = files.glob_read(spark, f"{tmp_path}/*.csv", concat=False)
    assert parts.select("part").distinct().count() == 3
    with pytest.raises(RecordError, match="nothing lies"):
        files.glob_read(spark, f"{tmp_path}/*.json")
    found = files.file_inventory(spark, str(tmp_path), "*.csv").select("name", "suffix", "bytes")
    assert rows(found) == [("a.csv", ".csv", 9), ("b.csv", ".csv", 9), ("c.csv", ".csv", 9)]


# -- tables -----------------------------------------------------------------------


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_table_modes(spark, table, rows):
    tables.table_write(spark.sql("select 1 id, 'a' s union all select 2, 'b'"), table)
    wide = tables.table_write(spark.sql("select 3 id, array(1, 2) tags"), table, "append")
    assert rows(wide) == [(1, "a", None), (2, "b", None), (3, None, "[1,2]")]
    batch = spark.sql("select 2 id, 'old' s, 1 o union all select 2, 'new', 2 union all select 9, 'z', 1")
    assert rows(tables.table_write(batch, table, "upsert", "id", ["o"]).select("id", "s", "tags", "o")) == [
        (1, "a", None, None), (2, "new", None, 2), (3, None, "[1,2]", None), (9, "z", None, 1),
    ]
    assert tables.table_write(batch.limit(0), table).count() == 4
    assert rows(tables.table_schema(spark, table).select("column"))[0] == ("id",)
    with pytest.raises(RecordError):
        tables.table_schema(spark, "nowhere")
    with pytest.raises(RecordError):
        tables.table_write(batch, table, "upsert")
    with pytest.raises(RecordError):
        tables.table_write(batch, table, "merge")


def test_replace_from_itself(spark, table, rows):
    tables.table_write(spark.sql("select 1 id, 'a' s union all select 2, 'b'"), table)
    tables.table_write(spark.table(table).filter("id = 2"), table)
    assert rows(spark.table(table)) == [(2, "b")]
    left = [t.name for t in spark.catalog.listTables() if t.name.startswith(table)]
    assert left == [table]


def test_upsert_into_nothing(spark, table, rows):
    assert rows(tables.table_write(spark.sql("select 1 id, 'a' s union all select null, 'n' union all select null, 'm'"), table, "upsert", "id")) == [
        (1, "a"), (None, "m"), (None, "n"),
    ]


def test_delete_update(spark, table, rows):
    tables.table_write(spark.sql("select * from values (1, 5), (2, null), (3, 7) t(id, n)"), table)
    assert tables.table_delete_where(spark, table, F.col("n") > 6) == 1
    assert tables.table_update_where(spark, table, F.col("n") == 5, {"n": F.col("n") + 1}) == 1
    assert rows(spark.table(table)) == [(1, 6), (2, None)]
    assert tables.table_delete_where(spark, table, F.col("n") > 100) == 0


def test_sql(spark, rows):
    df = spark.sql("select 1 id union all select 2")
    assert rows(tables.sql(spark, "select id from d where id = ?", 2, d=df)) == [(2,)]
    assert rows(tables.sql(spark, "select count(*) from d where cast(id as string) = ?", "1 or 1=1", d=df)) == [(0,)]


def test_sql_leaves_views_alone(spark, rows):
    spark.range(3).createOrReplaceTempView("d")
    one = tables.sql(spark, "select count(*) from d", d=spark.range(1))
    assert rows(one) == [(1,)] and spark.table("d").count() == 3
    spark.catalog.dropTempView("d")
    tables.sql(spark, "select 1 from unseen", unseen=spark.range(1))
    assert not spark.catalog.tableExists("unseen")


# -- digests and publication ------------------------------------------------------


def test_digest(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1, "y": 2}), (2, None, {"y": 2, "x": 1})], "id long, s string, m map<string,int>")
    one = publish.digest_of(df)
    assert one == publish.digest_of(df.repartition(5).orderBy(F.desc("id")).select("m", "s", "id"))
    swapped = spark.createDataFrame([(1, "a", {"y": 2, "x": 1}), (2, None, {"x": 1, "y": 2})], df.schema)
    assert one == publish.digest_of(swapped)
    changed = [df.limit(1), df.union(df), df.withColumn("id", F.col("id").cast("string")), df.withColumnRenamed("s", "t"), df.fillna("")]
    assert one not in {publish.digest_of(c) for c in changed}


def test_digest_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", -1.0)], "id long, s string, f double")
    record = publish.write_digested(df, f"{tmp_path}/d")
    assert record["rows"] == 2 and record["digest"] == publish.digest_of(df) == publish.digest_of(spark.read.parquet(f"{tmp_path}/d"))
    for i, none in enumerate((df.limit(0), spark.createDataFrame([], df.schema))):
        assert publish.write_digested(none, f"{tmp_path}/e{i}")["digest"] == publish.digest_of(none)


GATES = {"a": lambda df: quality.gate(df, rows=(3, None))}


def _outputs(spark, n):
    values = spark.range(n).withColumnRenamed("id", "value")
    return {"a": values, "b": values.selectExpr("value * 2 value")}


def _sizes(spark, folder):
    return [publish.published(spark, folder, name).count() for name in ("a", "b")]


def test_publish_then_refuse(spark, tmp_path):
    folder = str(tmp_path / "p")
    with pytest.raises(RecordError, match="publishes no output"):
        publish.published(spark, folder, "a")
    done = publish.publish_validated(_outputs(spark, 3), GATES, folder, "r1")
    assert sorted(done.outputs) == ["a", "b"] and _sizes(spark, folder) == [3, 3]
    held = publish.published(spark, folder, "a")
    with pytest.raises(GateFailed, match="nothing was published"):
        publish.publish_validated(_outputs(spark, 2), GATES, folder, "r2")
    assert _sizes(spark, folder) == [3, 3] and publish.standing(spark, folder).torn == ()
    publish.publish_validated(_outputs(spark, 5), GATES, folder, "r3")
    assert _sizes(spark, folder) == [5, 5] and held.count() == 3  # a reader keeps its generation


@pytest.mark.parametrize("crash", ["in the data", "before the seal", "before the pointer", "never"])
def test_crash_at_every_step(spark, tmp_path, crash, monkeypatch):
    """Whatever step fails, readers meet one whole generation, and recovery removes only torn ones."""
    folder = str(tmp_path / "p")
    first = publish.publish_validated(_outputs(spark, 3), GATES, folder, "r1")

    def fail(*_):
        raise OSError("cut off")

    with monkeypatch.context() as patch:
        if crash == "in the data":
            patch.setattr(publish, "write_digested", lambda df, path: df.write.parquet(path) if path.endswith("/a") else fail())
        elif crash == "before the seal":
            patch.setattr(publish.Files, "write_text", fail)
        elif crash == "before the pointer":
            patch.setattr(publish, "switch", fail)
        if crash == "never":
            publish.publish_validated(_outputs(spark, 4), GATES, folder, "r2")
        else:
            with pytest.raises(OSError):
                publish.publish_validated(_outputs(spark, 4), GATES, folder, "r2")
    found = publish.recover_publication(spark, folder, verify=True)
    after = publish.standing(spark, folder)
    assert found.sound and after.torn == ()
    if crash == "never":
        assert _sizes(spark, folder) == [4, 4] and after.ready == (first.name,)
        return
    assert found.current == first.name and _sizes(spark, folder) == [3, 3]
    assert (len(found.torn), len(found.ready)) == ((0, 1) if crash == "before the pointer" else (1, 0))
    if found.ready:
        publish.switch(spark, folder, found.ready[0])
        assert _sizes(spark, folder) == [4, 4]


def test_changed_data_is_not_sound(spark, tmp_path):
    folder = str(tmp_path / "p")
    done = publish.publish_validated(_outputs(spark, 3), {}, folder, "r1")
    spark.range(1).withColumnRenamed("id", "value").write.mode("overwrite").parquet(done.outputs["a"]["path"])
    assert publish.standing(spark, folder).sound and not publish.standing(spark, folder, verify=True).sound
    with pytest.raises(RecordError, match="no sealed generation"):
        publish.switch(spark, folder, "r9")


def test_reuse(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    run = lambda version, digest: publish.materialize_or_reuse(spark, f"{tmp_path}/m", "n", version, {"x": digest}, build)[1]
    assert [run(1, "a"), run(1, "a"), run(2, "a"), run(2, "b"), run(1, "a")] == [False, True, False, False, True]
    assert len(built) == 3
    note = next(p for p in (tmp_path / "m").glob("*.json"))
    kept = json.loads(note.read_text())
    spark.range(1).write.mode("overwrite").parquet(kept["path"])
    version, digest = json.loads(kept["identity"])["version"], json.loads(kept["identity"])["inputs"]["x"]
    assert run(version, digest) is False  # other files lie there now


# -- streams ----------------------------------------------------------------------


def test_stream_gate(spark, tmp_path):
    source = tmp_path / "in"
    for i, n in enumerate((3, 2)):
        spark.range(n).coalesce(1).write.parquet(f"{source}/f{i}")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    gate = lambda df: quality.gate(df, rows=(3, None))
    writer = gates.stream_gate(stream, gate, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check")
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/good").count() == 3
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_stream_dedupe(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (1, at), (2, at)], "k int, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, at timestamp").parquet(f"{tmp_path}/in")
    once = gates.stream_dedupe(stream, ["k"], "at", "1 hour")
    running = once.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    running.awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


# -- user functions ---------------------------------------------------------------


def test_registry(spark):
    name = f"sales.double_{uuid.uuid4().hex[:6]}"

    @registry.operator(name, version=3)
    def double(df, column, times=2):
        """Multiply a column."""
        return df.withColumn(column, F.col(column) * times)

    assert registry.describe(name).version == 3 and registry.describe(name).summary == "Multiply a column."
    assert registry.apply(name, spark.range(2), "id", times=5).collect()[1].id == 5
    with pytest.raises(RecordError, match="no parameter"):
        registry.apply(name, spark.range(2), "id", tims=5)
    with pytest.raises(RecordError, match="taken by another"):
        registry.operator(name)(lambda df: df)
    with pytest.raises(RecordError, match="no operator"):
        registry.describe("nothing.here")


def test_overloads():
    name = f"size_{uuid.uuid4().hex[:6]}"
    registry.overload(name, T.StringType)(lambda c: "text")
    registry.overload(name, T.NumericType)(lambda c: "number")
    assert registry.resolve(name, T.LongType())(None) == "number"
    assert registry.resolve(name, T.StringType())(None) == "text"
    with pytest.raises(RecordError):
        registry.resolve(name, T.BooleanType())
    with pytest.raises(RecordError, match="already has"):
        registry.overload(name, T.StringType)(lambda c: c)


def test_script(spark, rows):
    def script(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(twice=frame["id"] * 2)

    assert rows(registry.run_script(spark.range(3), script, "id long, twice long")) == [(0, 0), (1, 2), (2, 4)]


def test_shared_folder():
    from recordloom.session import shared_folder

    class Conf(dict):
        set = dict.__setitem__

    def folder(**conf):
        from types import SimpleNamespace

        return shared_folder(SimpleNamespace(conf=Conf({k.replace("_", "."): v for k, v in conf.items()})))

    assert folder(spark_checkpoint_dir="hdfs://x/y/") == "hdfs://x/y"
    assert folder(spark_sql_warehouse_dir="hdfs://w/") == "hdfs://w/_shared"


def test_there_always_is_a_table(spark, monkeypatch):
    """An upsert points the catalog to new files in one step; it renames and drops nothing."""
    name = "always_there"
    tables.table_write(spark.range(6).selectExpr("id", "'old' s"), name)
    said = []
    run = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, q, *a, **k: said.append(q) or run(self, q, *a, **k))
    tables.table_write(spark.range(4, 8).selectExpr("id", "'new' s", "id * 2 more"), name, "upsert", "id")
    assert tables.table_delete_where(spark, name, F.col("id") == 0) == 1
    assert tables.table_update_where(spark, name, F.col("id") == 1, {"s": F.lit("set")}) == 1
    assert not [q for q in said if "RENAME" in q or "DROP" in q] and sum("SET LOCATION" in q for q in said) == 3
    got = sorted(map(tuple, spark.table(name).collect()), key=repr)
    assert got == sorted([(1, "set", None), (2, "old", None), (3, "old", None)] + [(i, "new", 2 * i) for i in range(4, 8)], key=repr)
    tables.table_write(spark.range(2).selectExpr("cast(id as string) id"), name)
    assert spark.table(name).dtypes == [("id", "string")]
    spark.sql(f"DROP TABLE {name}")
