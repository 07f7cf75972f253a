"""Grouping and whole-frame aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError, require_columns
from recordloom.functions import logic
from recordloom.operators import ordering
from recordloom.operators.schema import col, field

HOW = ("count", "sum", "min", "max", "avg", "first", "last")
GROUP_ROWS = 10_000


def _aggregate(df: DataFrame, name: str, how: str, order_by: Sequence[str]) -> Column:
    c, dtype = col(name), df.schema[name].dataType
    if how in ("sum", "avg") and not isinstance(dtype, T.NumericType):
        raise RecordError(f"{how} works on numbers, and {name!r} is {dtype.simpleString()}")
    if how == "count":
        return F.count(c)
    if how == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if how == "avg":
        return F.avg(c)
    if how in ("min", "max"):
        return F.min(c) if how == "min" else F.max(c)
    if how in ("first", "last"):
        if not order_by:
            raise RecordError(f"{how} needs order_by: rows of a frame have no order of their own")
        place = F.when(c.isNotNull(), F.struct(*[col(o) for o in order_by]))
        return F.min_by(c, place) if how == "first" else F.max_by(c, place)
    raise RecordError(f"{how!r} is no aggregate here; choose from {', '.join(HOW)}")


def group_agg(
    df: DataFrame,
    by: str | Sequence[str],
    agg: dict[str, str | Sequence[str]] | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Group and aggregate; null is a group. Result columns are named ``column_how``.

    Without ``agg`` the groups are counted. Nulls are skipped, an empty sum is 0, and first
    and last are the first and last non-null value in ``order_by``.
    """
    keys = [by] if isinstance(by, str) else list(by)
    require_columns(df.columns, [*keys, *(agg or {}), *order_by])
    grouped = df.groupBy(*[col(k) for k in keys])
    if not agg:
        return grouped.agg(F.count("*").alias("count"))
    wanted = [(n, how) for n, hows in agg.items() for how in ([hows] if isinstance(hows, str) else hows)]
    return grouped.agg(*[_aggregate(df, n, how, order_by).alias(f"{n}_{how}") for n, how in wanted])


def aggregate_path(df: DataFrame, operation: str, path: str | None = None, group: str | None = None) -> DataFrame:
    """``group, value, count`` over a nested path; values that are not numbers are left out.

    An empty group gives 0, as does a group without numbers.
    """
    from recordloom.functions import cast

    key = field(df, group)[0].cast("string") if group else F.lit("all")
    if operation == "count" or path is None:
        value = F.count("*").cast("double")
    elif operation in ("sum", "avg", "min", "max"):
        c, dtype = field(df, path)
        value = F.coalesce(getattr(F, operation)(cast.number(c, dtype)), F.lit(0.0))
    else:
        raise RecordError(f"{operation!r} is no operation here; choose from count, sum, avg, min, max")
    return df.groupBy(key.alias("group")).agg(value.alias("value"), F.count("*").alias("count"))


def totals(df: DataFrame, name: str) -> DataFrame:
    """One row: ``count, sum, avg, min, max`` of a numeric column."""
    wanted = ("count", "sum", "avg", "min", "max")
    return df.agg(*[_aggregate(df, name, how, ()).alias(how) for how in wanted])


def median(df: DataFrame, name: str) -> DataFrame:
    """One row, ``median``: exact, without holding the values in one task.

    Values are reduced to counts and laid out in order over many chunks. The chunk sizes, one
    row per chunk, tell where the middle is, and only that chunk is looked into.
    """
    counts = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.count("*").alias("n"))
    rows = ordering.sequence_rows(counts, [], ["v"], unique=True)
    sizes = rows.groupBy(ordering.CHUNK).agg(F.sum("n").alias("n")).orderBy(ordering.CHUNK).collect()
    total = sum(r["n"] for r in sizes)
    if total == 0:
        return rows.agg(F.lit(None).cast("double").alias("median"))
    middles, before, ends = ((total + 1) // 2, total // 2 + 1), 0, []
    for r in sizes:
        ends += [(r[ordering.CHUNK], m - before) for m in middles if before < m <= before + r["n"]]
        before += r["n"]
    within = W.partitionBy(ordering.CHUNK).orderBy(ordering.PLACE)
    near = rows.filter(F.col(ordering.CHUNK).isin(*{c for c, _ in ends})).withColumn("upto", F.sum("n").over(within))
    hits = [
        F.max(F.when((F.col(ordering.CHUNK) == c) & (F.col("upto") >= m) & (F.col("upto") - F.col("n") < m), F.col("v")))
        for c, m in ends
    ]
    return near.agg(((hits[0] + hits[1]) / 2).alias("median"))


def any_all(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``name_any`` and ``name_all`` by truthiness; any of nothing is false, all of it true."""
    out = []
    for name in names:
        held = logic.truthy(col(name), df.schema[name].dataType)
        out.append(F.coalesce(F.bool_or(held), F.lit(False)).alias(f"{name}_any"))
        out.append(F.coalesce(F.bool_and(held), F.lit(True)).alias(f"{name}_all"))
    return df.groupBy(*[col(b) for b in by]).agg(*out)


def group_records(
    df: DataFrame, by: str, order_by: Sequence[str], rows_per_part: int = GROUP_ROWS, unique: bool = False
) -> DataFrame:
    """``by, part, items``: the records of each key, in order, in lists of bounded length.

    A key with at most ``rows_per_part`` records has one list (part 0). A larger one
    continues in parts 1, 2, …, so that no task ever holds a whole hot key.
    """
    numbered = ordering.number_within(df, [by], order_by, "__n", unique=unique)
    part = F.floor((F.col("__n") - 1) / rows_per_part)
    item = F.struct(F.col("__n"), F.struct(*[col(c) for c in df.columns]).alias("item"))
    grouped = numbered.groupBy(col(by), part.alias("part")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select(col(by), "part", F.transform("items", lambda x: x["item"]).alias("items"))
