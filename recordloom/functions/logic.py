"""Comparison, null handling and truthiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import text


def eq(left: Column, right: Column) -> Column:
    """Equal, with null equal to null."""
    return left.eqNullSafe(right)


def ne(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def _ordered(left: Column, right: Column, strict: bool, symbol: str, result: Column) -> Column:
    if not strict:
        return result
    null = left.isNull() | right.isNull()
    return F.when(null, F.raise_error(F.lit(f"cannot compare null with '{symbol}'"))).otherwise(result)


def lt(left: Column, right: Column, strict: bool = False) -> Column:
    return _ordered(left, right, strict, "<", left < right)


def le(left: Column, right: Column, strict: bool = False) -> Column:
    return _ordered(left, right, strict, "<=", left <= right)


def gt(left: Column, right: Column, strict: bool = False) -> Column:
    return _ordered(left, right, strict, ">", left > right)


def ge(left: Column, right: Column, strict: bool = False) -> Column:
    return _ordered(left, right, strict, ">=", left >= right)


def is_null(c: Column) -> Column:
    return c.isNull()


def is_empty(c: Column, dtype: T.DataType) -> Column:
    """Null, blank text, or a list or object without elements."""
    if isinstance(dtype, T.StringType):
        return c.isNull() | (text.trim(c) == "")
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def coalesce(*values: Column) -> Column:
    return F.coalesce(*values)


def default(c: Column, dtype: T.DataType, fallback: Column) -> Column:
    return F.when(is_empty(c, dtype), fallback).otherwise(c)


def truthy(c: Column, dtype: T.DataType) -> Column:
    """False for null, false, zero, empty text and empty lists or objects."""
    if isinstance(dtype, T.BooleanType):
        held = c
    elif isinstance(dtype, T.NumericType):
        held = c != 0
    elif isinstance(dtype, (T.StringType, T.BinaryType)):
        held = F.length(c) > 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        held = F.size(c) > 0
    else:
        held = c.isNotNull()
    return F.coalesce(held, F.lit(False))


def negate(c: Column, dtype: T.DataType) -> Column:
    return ~truthy(c, dtype)


def and_value(left: Column, left_type: T.DataType, right: Column) -> Column:
    """The right side when the left is truthy, else the left: an operand, not a boolean."""
    return F.when(truthy(left, left_type), right).otherwise(left)


def or_value(left: Column, left_type: T.DataType, right: Column) -> Column:
    return F.when(truthy(left, left_type), left).otherwise(right)


def ternary(condition: Column, dtype: T.DataType, yes: Column, no: Column) -> Column:
    return F.when(truthy(condition, dtype), yes).otherwise(no)


def contains(c: Column, dtype: T.DataType, item: object) -> Column:
    """Text inside text, a member of a list, or a key of an object; false for null."""
    if isinstance(dtype, T.StringType):
        held = F.contains(c, item if isinstance(item, Column) else F.lit(str(item)))
    elif isinstance(dtype, T.ArrayType):
        held = F.array_contains(c, item)
    elif isinstance(dtype, T.MapType):
        held = F.map_contains_key(c, item)
    else:
        raise RecordError(f"cannot test membership in {dtype.simpleString()}")
    return F.coalesce(held, F.lit(False))


def contains_by(item: object, c: Column, dtype: T.DataType) -> Column:
    return contains(c, dtype, item)
