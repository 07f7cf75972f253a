"""Digests of the parts of a table, combined upward, so that two versions are compared by what differs.

Rows are dealt over parts by a hash of their key. For every part and group of columns there is a leaf: the
number of rows and the exact sum of their hashes, which depends on no order. Sums of leaves are the digests of larger
parts, up to the whole. Two tables are compared leaf by leaf; only parts whose leaves differ are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError, require_columns
from recordloom.operators.publish import _canonical
from recordloom.operators.schema import col

#: Parts of a table; a leaf must hold fewer than 2^31 rows.
PARTS = 256
PART = "__part"
_HALVES = ("low", "high")


def _value(df: DataFrame, name: str) -> list[Column]:
    """What is hashed of a cell: the value, and whether there is one."""
    kind = df.schema[name].dataType
    nested = isinstance(kind, (T.MapType, T.StructType, T.ArrayType, T.VariantType))
    shown = F.to_json(F.struct(_canonical(col(name), kind).alias("v")), {"ignoreNullFields": "false"}) if nested else col(name)
    return [shown, col(name).isNull()]


def _hash(df: DataFrame, names: Sequence[str]) -> Column:
    return F.xxhash64(*[c for n in names for c in _value(df, n)])


def _groups(df: DataFrame, key: Sequence[str], groups: dict[str, Sequence[str]] | None) -> dict[str, list[str]]:
    """The groups of columns; by default every column but the key is one of its own."""
    require_columns(df.columns, key)
    if groups is None:
        groups = {c: [c] for c in df.columns if c not in key} or {"key": list(key)}
    require_columns(df.columns, [c for names in groups.values() for c in names])
    return {g: list(names) for g, names in groups.items()}


def _halved(df: DataFrame, key: Sequence[str], groups: dict[str, list[str]]) -> tuple[dict[str, Column], list[Column]]:
    """The hash of key and cells for each group, and the sums of both its halves, which cannot overflow."""
    hashes = {f"__h{i}": _hash(df, [*key, *names]) for i, names in enumerate(groups.values())}
    sums = []
    for i in range(len(groups)):
        sums += [F.sum(F.col(f"__h{i}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low{i}"), F.sum(F.shiftright(f"__h{i}", 32)).alias(f"high{i}")]
    return hashes, sums


def part_of(df: DataFrame, key: Sequence[str], parts: int = PARTS) -> Column:
    return F.pmod(_hash(df, key), F.lit(parts)).cast("int")


def leaves(df: DataFrame, key: Sequence[str], groups: dict[str, Sequence[str]] | None = None, parts: int = PARTS) -> DataFrame:
    """``part, group, rows, low, high``: one row per part and group of columns; parts without rows are absent."""
    named = _groups(df, key, groups)
    hashes, sums = _halved(df, key, named)
    dealt = df.select(part_of(df, key, parts).alias("part"), *[h.alias(n) for n, h in hashes.items()])
    found = dealt.groupBy("part").agg(F.count("*").alias("rows"), *sums)
    lines = [F.struct(F.lit(g).alias("group"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")) for i, g in enumerate(named)]
    return found.select("part", "rows", F.inline(F.array(*lines))).select("part", "group", "rows", "low", "high")


def combined(found: DataFrame, span: int | None = None) -> DataFrame:
    """The digests of ``span`` neighbouring parts as one part, or of the whole table as part 0."""
    part = F.lit(0) if span is None else F.floor(F.col("part") / span).cast("int")
    return found.groupBy(part.alias("part"), "group").agg(*[F.sum(n).alias(n) for n in ("rows", *_HALVES)])


def write_parts(
    df: DataFrame, path: str, key: Sequence[str], groups: dict[str, Sequence[str]] | None = None, parts: int = PARTS
) -> str:
    """Write a table by parts, with its leaves beside it. Parts that are large are written by several tasks."""
    if PART in df.columns:
        raise RecordError(f"a column is named {PART}")
    df.withColumn(PART, part_of(df, key, parts)).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{path}/rows")
    leaves(df, key, groups, parts).coalesce(1).write.parquet(f"{path}/leaves")
    df.limit(0).write.parquet(f"{path}/columns")  # a table without rows has no parts
    return path


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a written table, with their part."""
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(T.StructType([*columns.fields, T.StructField(PART, T.IntegerType())])).parquet(f"{path}/rows")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``part, group, left_rows, right_rows`` of the leaves (or combined digests) that are not alike."""
    sided = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    of = lambda n, side: F.max(F.when(F.col("side") == side, F.col(n)))
    both = sided.groupBy("part", "group").agg(
        *[F.coalesce(of("rows", s), F.lit(0)).alias(n) for s, n in enumerate(("left_rows", "right_rows"))],
        *[of(n, s).alias(f"{n}{s}") for n in _HALVES for s in (0, 1)],
    )
    alike = reduce(lambda a, b: a & b, [F.col(f"{n}0").eqNullSafe(F.col(f"{n}1")) for n in _HALVES])
    return both.filter(~alike | (F.col("left_rows") != F.col("right_rows"))).select("part", "group", "left_rows", "right_rows")


def changed_parts(spark: SparkSession, left: str, right: str) -> DataFrame:
    """The leaves in which two written tables differ; their rows are not read."""
    return differing(spark.read.parquet(f"{left}/leaves"), spark.read.parquet(f"{right}/leaves"))


def changed_rows(
    spark: SparkSession, left: str, right: str, key: Sequence[str], groups: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Key, ``change`` (left_only, right_only, changed) and ``groups`` that differ, from the parts that differ alone.

    Keys may repeat: the rows of one key are compared as a whole, in any order. Both sides are stacked and
    grouped, so a hot key is reduced before it meets the other side.
    """
    wanted = sorted(r.part for r in changed_parts(spark, left, right).select("part").distinct().collect())
    sides = [read_parts(spark, p).filter(F.col(PART).isin(wanted)) for p in (left, right)]
    named = _groups(sides[0].drop(PART), key, groups)
    hashed = []
    for side, df in enumerate(sides):
        hashes, sums = _halved(df, key, named)
        hashed.append(df.select(*[col(k) for k in key], F.lit(side).alias("__side"), *[h.alias(n) for n, h in hashes.items()]))
    rows = hashed[0].unionByName(hashed[1])
    signed = lambda c: F.when(F.col("__side") == 0, c).otherwise(-c)
    halves = [
        F.sum(signed(half)) for i in range(len(named))
        for half in (F.col(f"__h{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(f"__h{i}", 32))
    ]
    counts = [F.count_if(F.col("__side") == s).alias(f"__n{s}") for s in (0, 1)]
    per_key = rows.groupBy(*[col(k) for k in key]).agg(*counts, *[h.alias(f"__d{i}") for i, h in enumerate(halves)])
    off = [F.when((F.col(f"__d{2 * i}") != 0) | (F.col(f"__d{2 * i + 1}") != 0), F.lit(g)) for i, g in enumerate(named)]
    found = per_key.withColumn("__off", F.array_compact(F.array(*off)))
    change = F.when(F.col("__n1") == 0, "left_only").when(F.col("__n0") == 0, "right_only").otherwise("changed")
    apart = (F.size("__off") > 0) | (F.col("__n0") != F.col("__n1"))
    return found.filter(apart).select(*[col(k) for k in key], change.alias("change"), F.array_join("__off", ",").alias("groups"))
