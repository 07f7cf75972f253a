"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import cast
from recordloom.operators.schema import field


def filter_rows(
    df: DataFrame, column: str, equals: object = None, contains: object = None,
    minimum: float | None = None, maximum: float | None = None,
) -> DataFrame:
    """Rows that pass every given check; a null never does.

    ``contains`` looks inside text, or for a member of a list. Bounds fail on what is not a
    number.
    """
    c, dtype = field(df, column)
    if equals is not None:
        df = df.filter(c == F.lit(equals) if _same_kind(dtype, equals) else F.lit(False))
    if contains is not None:
        if isinstance(dtype, T.StringType):
            df = df.filter(F.contains(c, F.lit(str(contains))))
        elif isinstance(dtype, T.ArrayType):
            df = df.filter(F.array_contains(c, contains))
        else:
            df = df.filter(F.lit(False))
    for bound, test in ((minimum, lambda b: c >= b), (maximum, lambda b: c <= b)):
        if bound is not None:
            df = df.filter(test(bound) if isinstance(dtype, T.NumericType) else F.lit(False))
    return df


def _same_kind(dtype: T.DataType, value: object) -> bool:
    """Whether a value could equal one of a column: text, numbers and booleans stay apart."""
    for kind, python in ((T.StringType, str), (T.BooleanType, bool)):
        if isinstance(dtype, kind) or isinstance(value, python):
            return isinstance(dtype, kind) and isinstance(value, python)
    return True


def predicate(c: Column, dtype: T.DataType, operator: str, value: object) -> Column:
    """A condition by operator name: eq ne gt gte lt lte regex in nin."""
    text = F.initcap(c.cast("string")) if isinstance(dtype, T.BooleanType) else c.cast("string")
    text = F.coalesce(text, F.lit("None"))
    if operator in ("gt", "gte", "lt", "lte"):
        left, right = cast.number(c, dtype), F.lit(float(value))
        held = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[operator]
        return F.coalesce(held, F.lit(False))
    if operator in ("eq", "ne"):
        same = text == str(value)
        return same if operator == "eq" else ~same
    if operator == "regex":
        return F.rlike(text, F.lit(str(value)))
    if operator in ("in", "nin"):
        words = [w.strip() for w in str(value).split(",")] if isinstance(value, str) else [str(w) for w in value]
        return text.isin(*words) if operator == "in" else ~text.isin(*words)
    raise RecordError(f"unknown operator {operator!r}; use eq ne gt gte lt lte regex in nin")


def _at_the_scan(c: Column, dtype: T.DataType, operator: str, value: object) -> Column | None:
    """The same condition in the column's own type, which a scan can use; None where it is not the same.

    It is null where the general one is false, so it serves to include only.
    """
    orders = {"gt": lambda b: c > b, "gte": lambda b: c >= b, "lt": lambda b: c < b, "lte": lambda b: c <= b}
    if operator in orders and isinstance(dtype, T.NumericType):
        bound = float(value)
        whole = isinstance(dtype, T.IntegralType) and bound.is_integer() and abs(bound) < 2**53
        if whole or isinstance(dtype, T.DoubleType):
            return orders[operator](F.lit(int(bound) if whole else bound).cast(dtype if abs(bound) < 2**31 else "bigint"))
    words = [str(value)] if operator == "eq" else value if operator == "in" and not isinstance(value, str) else None
    if operator == "in" and isinstance(value, str):
        words = [w.strip() for w in value.split(",")]
    if isinstance(dtype, T.StringType) and words and "None" not in map(str, words):
        return c.isin(*map(str, words))
    if isinstance(dtype, T.IntegralType) and words and all(str(w) == str(int(w)) for w in words if str(w).lstrip("-").isdigit()):
        numbers = [int(w) for w in words if str(w).lstrip("-").isdigit()]
        if len(numbers) == len(words) and all(abs(n) < 2**31 for n in numbers):
            return c.isin(*numbers)
    return None


def filter_by(df: DataFrame, path: str, operator: str, value: object, mode: str = "include") -> DataFrame:
    """Rows that meet the condition, or with ``mode='exclude'`` those that do not."""
    c, dtype = field(df, path)
    if mode == "include":
        typed = _at_the_scan(c, dtype, operator, value)
        if typed is not None:
            return df.filter(typed)
    held = predicate(c, dtype, operator, value)
    return df.filter(held if mode == "include" else ~held)
