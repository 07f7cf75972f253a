"""Type names, inference and widening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import cast, text


def col(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """Column and type behind a dotted path; an unknown part fails in the analyzer."""
    found = df.select(_walk(path).alias("v"))
    return _walk(path), found.schema["v"].dataType


def _walk(path: str) -> Column:
    head, *rest = path.split(".")
    out = col(head)
    for part in rest:
        out = out[part]
    return out


def type_name(dtype: T.DataType) -> str:
    """null, boolean, integer, number, string, datetime, list or object."""
    if isinstance(dtype, T.NullType):
        return "null"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.ArrayType):
        return "list"
    if isinstance(dtype, (T.StructType, T.MapType, T.VariantType)):
        return "object"
    return "string"


def declared_schema(df: DataFrame) -> dict[str, str]:
    """Column types by name, from the plan alone."""
    return {f.name: type_name(f.dataType) for f in df.schema.fields}


def infer_schema(df: DataFrame) -> DataFrame:
    """``column, type`` with all-null columns reported as ``null``; one aggregate pass."""
    names = df.columns
    counts = df.agg(*[F.count(col(name)).alias(f"c{i}") for i, name in enumerate(names)])
    declared = declared_schema(df)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
                F.when(F.col(f"c{i}") > 0, F.lit(declared[name])).otherwise("null").alias("type"),
            )
            for i, name in enumerate(names)
        ]
    )
    return counts.select(F.inline(rows))


def bind(c: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` applied to ``c``, which is worked out once per row however often it is used."""
    return F.get(F.transform(F.array(c), build), F.lit(0))


def shape_type(shape: Column) -> Column:
    """The type name of a value with this variant schema."""
    return (
        F.when(shape == "STRING", "string")
        .when(shape == "BIGINT", "integer")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "list")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.isNull() | (shape == "VOID"), "null")
        # Whole numbers beyond 64 bits arrive as wide decimals; 1.0 as a narrow one.
        .when(F.rlike(shape, F.lit(r"^DECIMAL\((19|[23]\d),0\)$")), "integer")
        .when(shape.startswith("DECIMAL") | shape.isin("DOUBLE", "FLOAT"), "number")
        .otherwise("string")
    )


def variant_type(v: Column) -> Column:
    """The type name of one JSON value."""
    return bind(F.schema_of_variant(v), shape_type)


def json_fields(df: DataFrame, json_column: str) -> DataFrame:
    """One row per (row, key) of a column of JSON objects: ``key, value`` as VARIANT."""
    v = F.try_parse_json(col(json_column))
    return df.select(F.explode(F.try_variant_get(v, "$", "map<string,variant>")).alias("key", "value"))


def infer_json_schema(df: DataFrame, json_column: str) -> DataFrame:
    """``field, type, present, nulls`` over a column of JSON objects.

    Types widen as integer with number to number, any other mix to string. The data is
    reduced to (key, type) counts before anything is shuffled.
    """
    seen = (
        json_fields(df, json_column)
        .select("key", variant_type(F.col("value")).alias("type"))
        .groupBy("key", "type")
        .agg(F.count("*").alias("n"))
    )
    kinds = F.collect_set(F.when(F.col("type") != "null", F.col("type")))
    return (
        seen.groupBy(F.col("key").alias("field"))
        .agg(
            kinds.alias("kinds"),
            F.sum("n").alias("present"),
            F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"),
        )
        .select("field", widen(F.col("kinds")).alias("type"), "present", "nulls")
    )


def widen(kinds: Column) -> Column:
    """The one type that admits every type in the set."""
    return (
        F.when(F.array_size(kinds) == 0, "null")
        .when(F.array_size(kinds) == 1, F.get(kinds, F.lit(0)))
        .when(F.sort_array(kinds) == F.array(F.lit("integer"), F.lit("number")), "number")
        .otherwise("string")
    )


def cast_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Coerce named columns to integer, number, boolean or string; unreadable is null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    unknown = sorted(set(schema.values()) - {"integer", "number", "boolean", "string"})
    if unknown:
        raise RecordError(f"{unknown[0]!r} is no target type; choose from integer, number, boolean, string")
    changed = {n: cast.to_type(col(n), types[n], wanted) for n, wanted in schema.items() if n in types}
    return df.withColumns(changed) if changed else df


def stringify(df: DataFrame, name: str) -> Column:
    return text.stringify(col(name), df.schema[name].dataType)
