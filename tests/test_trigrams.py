"""Searches through the trigram index give what a scan gives, and read few rows."""

import re

import pytest
from pyspark.sql import functions as F

from recordloom.operators import history, trigrams
from recordloom.session import scratch

TEXTS = ["Nightly-load", "nightly", "ni", "", None, "a%b_c", "ÄÖÜ straße 😀😀😀x", "aaaaaa", "back\\slash", "İstanbul", "nig htly", "x" * 5000 + "needle"]


def test_trigrams(value):
    lit = lambda x: F.lit(x).cast("string")
    assert value(*[trigrams.trigrams(lit(x)) for x in (None, "", "ab", "abc", "aaaa", "ÄB😀d")]) == [[], [], [], ["abc"], ["aaa"], ["äb😀", "b😀d"]]


@pytest.fixture(scope="module")
def tables(spark):
    runs = spark.createDataFrame(
        [(f"id{i:03d}", x, "flow", "full", f"2026-01-01 00:{i:02d}:00") for i, x in enumerate(TEXTS)] + [(None, "nightly", "flow", "full", None)],
        "id string, name string, workflow string, mode string, started_at string")
    tags = spark.createDataFrame([("id001", "gold"), ("id002", "Nightly"), ("id003", None), (None, "gold")], "run_id string, tag string")
    steps = spark.createDataFrame([("id004", "no needle here"), ("id004", "no needle here"), ("id005", None)], "run_id string, error string")
    path = scratch(spark, "trigrams")
    for part in (F.lit(True), F.lit(False)):
        late = lambda df, key: df.filter((F.col(key) > "id004").eqNullSafe(part) | (part & F.col(key).isNull()))
        history.index_history(late(runs, "id"), late(tags, "run_id"), late(steps, "run_id"), path)
    history.index_history(runs, tags, steps.limit(0), path)  # texts added twice
    return runs.filter("id IS NOT NULL"), tags, steps, path


@pytest.mark.parametrize("named", [1000, 0])
@pytest.mark.parametrize("text", ["NIGHT", "ght", "needle", "öü", "ÄÖÜ", "😀😀😀", "aaa", "a%c", "b_c", "%%%", "k\\s", "gold", "nowhere", "ni", "", "straße", "full", "i̇st"])
def test_same_as_scan(tables, monkeypatch, text, named):
    monkeypatch.setattr(trigrams, "NAMED", named)
    runs, tags, steps, path = tables
    found = [r.id for r in history.search(runs, tags, steps, text, None, index=path).collect()]
    assert found == [r.id for r in history.search(runs, tags, steps, text, None).collect()]


def test_only_rows_that_can_match_are_read(spark, tables):
    runs, tags, steps, path = tables
    stored = scratch(spark, "runs")
    runs.write.parquet(stored)
    plan = history.search(spark.read.parquet(stored), tags, steps, "needle", index=path)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all(re.search(r"DataFilters: \[.*id#\d+ IN \(id0(04|11),id0(04|11)\)", line) for line in scans)
    postings = trigrams.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[.*trigram#\d+ IN \(", postings)


def test_empty_index(spark, tables):
    runs, tags, steps, _ = tables
    path = scratch(spark, "trigrams")
    history.index_history(runs.limit(0), tags.limit(0), steps.limit(0), path)
    assert history.search(runs.limit(0), tags.limit(0), steps.limit(0), "needle", index=path).count() == 0


def test_postings_are_sorted_and_reduced_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(trigrams, "SORTED", 2000)
    monkeypatch.setattr(trigrams, "REDUCED", 50)
    path = scratch(spark, "trigrams")
    trigrams.add(spark.range(1000).selectExpr("id AS key", "concat('needle', id % 10) AS text"), path)
    found = trigrams.candidates(spark, path, "needle")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.key for r in found.collect()} == set(range(1000))
    assert len(spark.read.parquet(f"{path}/postings").inputFiles()) > 2
