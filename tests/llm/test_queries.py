"""Registered queries: SQL twins, contracts, and the pipeline against brute force."""

import oracle
import pytest

import corpus_pipeline
from recordloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_answer(spark, name):
    assert oracle.difference(spark, oracle.connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_registered():
    import __spark_entry__

    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
