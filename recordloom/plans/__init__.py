"""Registered queries: each one a Spark plan over the given tables, with its SQL twin.

A query receives ``Tables`` and returns a lazy DataFrame. ``sql`` is the same question for
an independent engine; queries without one cannot be asked in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from recordloom.session import tune

MODULES = ("relational", "scalars", "shapes", "gates", "storage", "paging", "runs", "reports")


class Tables:
    """The tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_QUERIES: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its own name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if build.__name__ in _QUERIES:
            raise ValueError(f"query {build.__name__} is registered twice")
        _QUERIES[build.__name__] = (build, sql)
        return build

    return register


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Tables(tune(spark), folder))

    return {name: bind(build) for name, (build, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
