"""Every registered query against its SQL twin, on the smallest tables."""

import os

import oracle
import pytest

from recordloom import plans

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = plans.oracle_sql()
BUILT = plans.queries()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_answer(spark, db, name):
    assert oracle.difference(spark, db, FOLDER, BUILT[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(BUILT) - set(SQL)))
def test_runs(spark, name):
    assert BUILT[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
