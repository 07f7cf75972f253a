"""Run-history questions."""

import pytest
from pyspark.sql import functions as F

from recordloom.errors import RecordError
from recordloom.operators import control, history, recipes


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (f"id{i}", f"Run-{i}", "orders" if i < 5 else "refunds", "fast" if i == 3 else None, f"2024-01-0{i}", "prod", i in (7, 8), "ok" if i % 2 else "failed", 10 * i)
        for i in range(1, 9)
    ]
    return spark.createDataFrame(rows, "id string, name string, workflow string, mode string, started_at string, env string, pinned boolean, status string, duration_ms long")


def ids(df):
    return [r.id for r in df.collect()]


def test_recent(runs):
    assert ids(history.recent(runs, 2)) == ["id8", "id7"]
    assert ids(history.recent(runs, 2, "orders")) == ["id4", "id3"]


def test_find(runs):
    assert ids(history.find(runs, "id3")) == ["id3"] and ids(history.find(runs, "Run-4")) == ["id4"]
    assert ids(history.find(runs.filter("id = 'id5'"), "run")) == ["id5"]
    with pytest.raises(RecordError, match="could be any"):
        history.find(runs, "id")
    with pytest.raises(RecordError, match="neither"):
        history.find(runs, "zzz")


def test_search(spark, runs):
    tags = spark.createDataFrame([("id1", "Nightly"), ("id1", "nightly2")], "run_id string, tag string")
    steps = spark.createDataFrame([("id2", "Timeout nightly"), ("id6", None)], "run_id string, error string")
    assert ids(history.search(runs, tags, steps, "NIGHTLY")) == ["id2", "id1"]
    assert ids(history.search(runs, tags, steps, "fast")) == ["id3"]
    assert ids(history.search(runs, tags, steps, "refund", limit=1)) == ["id8"]


def test_prune(runs):
    assert sorted(ids(history.retention_by_count(runs, 5))) == ["id1"]
    assert sorted(ids(history.retention_by_count(runs, 5, pinned=None))) == ["id1", "id2", "id3"]
    assert len(ids(history.retention_by_count(runs, 0))) == 6
    assert ids(history.retention_by_count(runs, 50)) == []
    assert ids(history.retention_by_count(runs.limit(0), 5)) == []
    assert sorted(ids(history.retention_by_count(runs, 1, scope=["workflow"]))) == ["id1", "id2", "id3", "id5"]


def test_evict(spark):
    rows = [("a", 10, 1, None), ("b", 10, 2, 5), ("c", 10, 3, None), ("d", 10, 4, 99), ("e", 10, 5, None)]
    entries = spark.createDataFrame(rows, "key string, bytes long, accessed int, expires int")
    got = {r.key: r.verdict for r in history.retention_by_size(entries, 20, F.lit(5)).collect()}
    assert got == {"a": "evicted", "b": "expired", "c": "evicted", "d": "kept", "e": "kept"}


def test_producers(spark, runs):
    rows = [("id1", "out", "r", "/a.csv", "d1"), ("id3", "out", "r", "/a.csv", "d2"), ("id4", "in", "r", "/a.csv", "d2"), ("id5", "out", "r", "/b.csv", "d1")]
    ports = spark.createDataFrame(rows, "run_id string, direction string, name string, path string, digest string")
    found = history.producers_of(ports, runs, "/a.csv", "d2").collect()
    assert [(r.run_id, r.run_name, r.changed) for r in found] == [("id3", "Run-3", False), ("id1", "Run-1", True)]


def test_diff(runs):
    found = [tuple(r) for r in history.run_diff(runs, "id1", "id2").collect()]
    assert found == [("status", "ok", "failed", True), ("duration_ms", "10", "20", True)]
    assert [r.comparable for r in history.run_diff(runs, "id1", "id5").collect()] == [False]


def test_report(spark, runs, rows):
    steps = spark.createDataFrame([("id1", "ok", 1, 5), ("id1", "failed", 3, 0)], "run_id string, status string, attempts int, duration_ms long")
    found = history.run_report(runs.filter("id in ('id1', 'id2')"), steps).select("run_id", "steps", "failed", "attempts", "measured", "duration_ms")
    assert rows(found) == [("id1", 2, 1, 4, 1, 5), ("id2", 0, 0, 0, 0, None)]


def test_latency(spark):
    steady = [("a", i, 10.0) for i in range(40)]
    worse = [("b", i, 10.0 if i < 24 else 13.0) for i in range(40)]
    few = [("c", i, 1.0) for i in range(31)]
    df = spark.createDataFrame(steady + worse + few, "host string, at int, ms double")
    got = {r.host: (r.samples, r.flat) for r in history.latency_flatness(df, "host", ["at"], "ms").collect()}
    assert got == {"a": (32, True), "b": (32, False), "c": (31, False)}


def test_map_rows(spark, rows):
    df = spark.createDataFrame([("b",), ("a",)], "s string")
    out = control.map_rows(df, {"t": F.concat("s", F.col("i").cast("string"))}, ["s"], "i", ["s"], unique=True)
    assert rows(out) == [("a", 0, "a0"), ("b", 1, "b1")]
    assert rows(control.entries(spark.sql("select map('k', 1) m"), "m")) == [("k", 1)]
    with pytest.raises(RecordError):
        control.map_rows(df, {}, index="i")


def test_iterate(spark):
    start = spark.createDataFrame([(1,)], "n int")
    double = lambda df: df.select((F.col("n") * 2).alias("n"))
    large = lambda df: df.first().n >= 100
    assert control.iterate(start, double, large).first().n == 128
    assert control.iterate(start, double, large, cut_every=3).first().n == 128
    assert control.iterate(start, double, lambda df: True, check_first=True) is start
    with pytest.raises(RecordError, match="did not end"):
        control.iterate(start, double, lambda df: False, max_iterations=3)


def test_trend(spark):
    values = [1.0, 3.0, 2.0, 5.0, 100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = recipes.trend_analysis(df, "v", ["i"], unique=True).first()
    assert (found.direction, found.slope, found["mean"], found.data_points) == ("upward", 20.0, 22.2, 5)
    assert (found.avg_change, found.avg_pct_change) == (24.75, round((200 - 33.33 + 150 + 1900) / 4, 2))
    odd = recipes.anomalies(df, "v", ["i"], threshold=1.9, unique=True).collect()
    assert [(r["index"], r["value"], r["z_score"]) for r in odd] == [(4, 100.0, 2.0)]


def test_recipes(spark, rows):
    texts = spark.createDataFrame([(1, "Good good GREAT bad"), (2, "hate, awful; ok"), (3, "plain good bad")], "id int, t string")
    assert rows(recipes.lexicon_sentiment(texts, "t").drop("t")) == [(1, "positive", 1), (2, "negative", 2), (3, "neutral", 0)]
    assert rows(recipes.word_frequency(texts, "t", top=1)) == [("good", 3)]
    assert rows(recipes.shares(texts.withColumn("k", F.col("id") > 1), "k")) == [(False, 1, 33.3), (True, 2, 66.7)]
    arrays = spark.sql("select 7 id, array(1,2,3) a, array(10, null) b")
    assert rows(recipes.parallel_arrays(arrays, ["a", "b"], "b", ["id"])) == [(7, 1, 10)]
    layout = {"id": (["key", "id"], 0), "value": (["amount"], 0.0)}
    assert rows(recipes.provider_normalise(texts, "p", layout)) == [("p", 1, 0.0), ("p", 2, 0.0), ("p", 3, 0.0)]
    assert rows(recipes.summary(spark.sql("select '5' a union all select 'x'"), ["a"])) == [("a", 2, 0.0, 5.0, 2.5)]
    assert rows(recipes.completion_rate(texts.withColumn("k", F.lit("a")), "k", F.col("id") < 3)) == [("a", 3, 2, 1, 66.7)]


def test_paths_are_compared_in_canonical_form(value, spark):
    cases = {
        "out/a.csv": "out/a.csv", "out/./a.csv": "out/a.csv", "out//b/../a.csv": "out/a.csv", "/x/../../y/": "/y", "../a/./b": "../a/b",
        "s3a://in//out/../a": "s3a://in/a", "../../a": "../../a", "a/..": "", "": "",
    }
    frame = spark.createDataFrame(list(cases.items()), "given string, wanted string")
    got = {r.given: r.got for r in frame.select("given", history.canonical_path(F.col("given")).alias("got")).collect()}
    assert got == cases
    ports = spark.createDataFrame([("r1", "out/./a.csv", "d", "out"), ("r1", "out/b.csv", "d", "out")], "run_id string, path string, digest string, direction string")
    runs = spark.createDataFrame([("r1", "n", 1)], "id string, name string, started_at int")
    assert history.producers_of(ports, runs, "out//a.csv").count() == 1
