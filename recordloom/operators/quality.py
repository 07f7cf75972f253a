"""Data-quality gates.

``check_*`` returns a lazy frame that describes the outcome; ``assert_*`` runs the check,
raises ``GateFailed`` when it does not hold, and otherwise returns its input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import GateFailed, RecordError, require_columns
from recordloom.operators.schema import col, declared_schema, infer_schema

MASK = "[redacted]"
MIN_SECRET = 4
SHOWN = 5


def _satisfies(observed: str, wanted: str) -> bool:
    return observed in (wanted, "null") or wanted == "string" or (observed, wanted) == ("integer", "number")


def check_schema(df: DataFrame, schema: dict[str, str], strict: bool = False) -> DataFrame:
    """``column, problem, expected, found``: missing, wrong type and, when strict, extra.

    Types come from the plan. The data is read (one pass) only if a declared type is wrong,
    to let a column that is null throughout satisfy any type.
    """
    observed = declared_schema(df)
    wrong = [n for n, wanted in schema.items() if n in observed and not _satisfies(observed[n], wanted)]
    if wrong:
        observed |= {r.column: r.type for r in infer_schema(df.select(*[col(n) for n in wrong])).collect()}
    rows = [(n, "missing", wanted, None) for n, wanted in schema.items() if n not in observed]
    rows += [(n, "type", schema[n], observed[n]) for n in wrong if not _satisfies(observed[n], schema[n])]
    if strict:
        rows += [(n, "extra", None, observed[n]) for n in observed if n not in schema]
    return df.sparkSession.createDataFrame(rows, "column string, problem string, expected string, found string")


def assert_schema(df: DataFrame, schema: dict[str, str], strict: bool = False) -> DataFrame:
    problems = check_schema(df, schema, strict).collect()
    if problems:
        detail = "; ".join(f"{p.column}: {p.problem}, expected {p.expected}, found {p.found}" for p in problems)
        raise GateFailed(f"the columns do not match the schema: {detail}")
    return df


def _rows_ok(count: Column, minimum: int | None, maximum: int | None, exactly: int | None) -> Column:
    ok = F.lit(True)
    if exactly is not None:
        ok = ok & (count == exactly)
    if minimum is not None:
        ok = ok & (count >= minimum)
    if maximum is not None:
        ok = ok & (count <= maximum)
    return ok


def check_rowcount(
    df: DataFrame, minimum: int | None = None, maximum: int | None = None, exactly: int | None = None
) -> DataFrame:
    """One row: ``rows, ok``."""
    counted = df.agg(F.count("*").alias("rows"))
    return counted.select("rows", _rows_ok(F.col("rows"), minimum, maximum, exactly).alias("ok"))


def assert_rowcount(
    df: DataFrame, minimum: int | None = None, maximum: int | None = None, exactly: int | None = None
) -> DataFrame:
    found = check_rowcount(df, minimum, maximum, exactly).first()
    if not found.ok:
        raise GateFailed(f"expected min={minimum} max={maximum} exactly={exactly} rows, found {found.rows}")
    return df


def check_unique(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``count``; null counts as a value."""
    keys = [by] if isinstance(by, str) else list(by)
    require_columns(df.columns, keys)
    return df.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias("count")).filter("count > 1")


def assert_unique(df: DataFrame, by: str | Sequence[str]) -> DataFrame:
    found = check_unique(df, by).limit(SHOWN + 1).collect()
    if found:
        shown = ", ".join(str(tuple(r)[:-1]) for r in found[:SHOWN])
        raise GateFailed(f"{by} is not unique: {shown}{' and more' if len(found) > SHOWN else ''}")
    return df


def check_no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """``column, nulls`` for the named columns (all by default) that hold any null.

    A column the frame lacks is null in every row. One aggregate pass for all columns.
    """
    names = list(columns) or df.columns
    counts = df.agg(
        *[
            (F.count_if(col(n).isNull()) if n in df.columns else F.count("*")).alias(f"c{i}")
            for i, n in enumerate(names)
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("nulls")) for i, n in enumerate(names)]
    )
    return counts.select(F.inline(rows)).filter("nulls > 0")


def assert_no_nulls(df: DataFrame, *columns: str) -> DataFrame:
    found = check_no_nulls(df, *columns).orderBy("column").collect()
    if found:
        raise GateFailed("null values in: " + ", ".join(f"{r.column} ({r.nulls})" for r in found))
    return df


def gate(
    df: DataFrame,
    rows: tuple[int | None, int | None] = (None, None),
    no_nulls: Sequence[str] = (),
    that: dict[str, Column] | None = None,
) -> DataFrame:
    """Several checks fused in one pass: ``check, ok, found``.

    ``that`` maps a name to a boolean aggregate over the frame, such as ``F.max('x') < 10``.
    """
    that = that or {}
    summary = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(col(n).isNull()).alias(f"n{i}") for i, n in enumerate(no_nulls)],
        *[expression.alias(f"t{i}") for i, expression in enumerate(that.values())],
    )
    line = lambda name, ok, found: F.struct(
        F.lit(name).alias("check"), F.coalesce(ok, F.lit(False)).alias("ok"), found.cast("string").alias("found")
    )
    lines = [line("rowcount", _rows_ok(F.col("rows"), *rows, None), F.col("rows"))]
    lines += [line(f"no_nulls:{n}", F.col(f"n{i}") == 0, F.col(f"n{i}")) for i, n in enumerate(no_nulls)]
    lines += [line(name, F.col(f"t{i}"), F.col(f"t{i}")) for i, name in enumerate(that)]
    return summary.select(F.inline(F.array(*lines)))


def assert_gate(df: DataFrame, **checks) -> DataFrame:
    failed = [r for r in gate(df, **checks).collect() if not r.ok]
    if failed:
        raise GateFailed("; ".join(f"{r.check} does not hold (found {r.found})" for r in failed))
    return df


def assert_that(df: DataFrame, condition: Column, message: str = "the condition does not hold") -> DataFrame:
    """Check one boolean aggregate, such as ``F.sum('total') > 0``."""
    return assert_gate(df, that={message: condition})


def observed(df: DataFrame, name: str, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """The frame with metrics collected while some later action runs it, at no extra pass."""
    watch = Observation(name)
    return df.observe(watch, *[a.alias(n) for n, a in aggregates.items()]), watch


def profile(df: DataFrame) -> DataFrame:
    """``column, type, rows, nulls`` in one aggregate pass."""
    names, types = df.columns, declared_schema(df)
    counts = df.agg(F.count("*").alias("rows"), *[F.count(col(n)).alias(f"c{i}") for i, n in enumerate(names)])
    lines = [
        F.struct(
            F.lit(n).alias("column"),
            F.when((F.col(f"c{i}") == 0), "null").otherwise(types[n]).alias("type"),
            F.col("rows"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
        )
        for i, n in enumerate(names)
    ]
    return counts.select(F.inline(F.array(*lines)))


def describe(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, count, nulls, distinct, min, max, mean``; the last three for numbers only.

    Counts, bounds and means are one pass. For exact distinct counts the values of all columns
    are stacked as (column, text) pairs, of which each task sends every pair once; a row is never
    copied whole. ``approximate`` uses a sketch in the first pass instead.
    """
    names = df.columns
    parts: list[Column] = [F.count("*").alias("rows")]
    for i, n in enumerate(names):
        c = col(n)
        parts.append(F.count(c).alias(f"c{i}"))
        if approximate:
            parts.append(F.approx_count_distinct(_value_text(c, df.schema[n].dataType)).alias(f"d{i}"))
        if isinstance(df.schema[n].dataType, T.NumericType):
            parts += [
                F.min(c).cast("double").alias(f"l{i}"),
                F.max(c).cast("double").alias(f"h{i}"),
                F.avg(c).cast("double").alias(f"m{i}"),
            ]
    numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema.fields]
    none = F.lit(None).cast("double")
    lines = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(n).alias("column"),
            F.col(f"c{i}").alias("count"),
            (F.col("rows") - F.col(f"c{i}")).alias("nulls"),
            (F.col(f"d{i}") if approximate else F.lit(0).cast("long")).alias("distinct"),
            *[(F.col(f"{mark}{i}") if numeric[i] else none).alias(name) for mark, name in (("l", "min"), ("h", "max"), ("m", "mean"))],
        )
        for i, n in enumerate(names)
    ]
    found = df.agg(*parts).select(F.inline(F.array(*lines)))
    kept = ["column", "count", "nulls", "distinct", "min", "max", "mean"]
    if approximate:
        return found.select(*kept)
    pairs = [F.struct(F.lit(i).alias("place"), _value_text(col(n), df.schema[n].dataType).alias("text")) for i, n in enumerate(names)]
    stacked = df.select(F.inline(F.array(*pairs))).filter("text is not null").groupBy("place", "text").agg(F.lit(1).alias("one"))
    distinct = stacked.groupBy("place").agg(F.count("*").alias("held"))
    joined = found.join(distinct, "place", "left").withColumn("distinct", F.coalesce("held", F.lit(0).cast("long")))
    return joined.select(*kept)


def _value_text(c: Column, dtype: T.DataType) -> Column:
    """Text that is the same for equal values: both zeros are one."""
    if isinstance(dtype, (T.MapType, T.VariantType, T.StructType, T.ArrayType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, "0.0").otherwise(c.cast("string"))
    return c.cast("string")


def redact(df: DataFrame, secrets: Sequence[str]) -> DataFrame:
    """Known secret values masked in every text of the frame, nested ones too."""
    short = [s for s in secrets if s and len(s) < MIN_SECRET]
    if short:
        raise RecordError(f"secrets need {MIN_SECRET} characters or more; one has {len(short[0])}")
    ordered = sorted({s for s in secrets if s}, key=lambda s: (-len(s), s))

    def scrub(c: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            for secret in ordered:
                c = F.replace(c, F.lit(secret), F.lit(MASK))
            return c
        if not _holds_text(dtype):
            return c
        if isinstance(dtype, T.StructType):
            rebuilt = F.struct(*[scrub(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
            return F.when(c.isNotNull(), rebuilt)
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda x: scrub(x, dtype.elementType))
        return F.transform_values(c, lambda _, v: scrub(v, dtype.valueType))

    return df.select(
        *[scrub(col(f.name), f.dataType).alias(f.name) if _holds_text(f.dataType) else col(f.name) for f in df.schema.fields]
    )


def _holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def export_safety(df: DataFrame) -> DataFrame:
    """``column, problem, rows``: whole numbers a spreadsheet would change, zoned times.

    A spreadsheet holds numbers as doubles, so whole values beyond 2^53 lose digits.
    """
    limit = 2**53
    counted, lines = [], []
    for i, f in enumerate(df.schema.fields):
        c = col(f.name)
        if isinstance(f.dataType, (T.IntegralType, T.DecimalType)):
            unsafe = (c > limit) | (c < -limit)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            unsafe = ((c > float(limit)) | (c < float(-limit))) & (c == F.rint(c)) & (F.abs(c) < float("inf"))
        elif isinstance(f.dataType, T.TimestampType):
            unsafe = c.isNotNull()
        else:
            continue
        problem = "zoned time" if isinstance(f.dataType, T.TimestampType) else "beyond 2^53"
        counted.append(F.count_if(unsafe).alias(f"c{i}"))
        lines.append(F.struct(F.lit(f.name).alias("column"), F.lit(problem).alias("problem"), F.col(f"c{i}").alias("rows")))
    if not counted:
        return df.sparkSession.createDataFrame([], "column string, problem string, rows long")
    return df.agg(*counted).select(F.inline(F.array(*lines))).filter("rows > 0")
