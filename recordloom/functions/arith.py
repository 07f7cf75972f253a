"""Arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(left: Column, right: Column) -> Column:
    return left + right


def add_text(left: Column, right: Column) -> Column:
    return F.concat(left, right)


def add_list(left: Column, right: Column) -> Column:
    return F.concat(left, right)


def append(left: Column, item: Column) -> Column:
    return F.array_append(left, item)


def sub(left: Column, right: Column) -> Column:
    return left - right


def mul(left: Column, right: Column) -> Column:
    return left * right


def repeat_text(times: Column, value: Column) -> Column:
    return F.repeat(value, times.cast("int"))


def repeat_list(times: Column, value: Column) -> Column:
    return F.flatten(F.array_repeat(value, times.cast("int")))


def div(left: Column, right: Column) -> Column:
    """True division; a zero divisor is an error."""
    return F.when(right == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(
        F.try_divide(left.cast("double"), right.cast("double"))
    )


def div_safe(left: Column, right: Column, fallback: object = None) -> Column:
    return F.coalesce(F.try_divide(left.cast("double"), right.cast("double")), F.lit(fallback).cast("double"))


def floordiv(left: Column, right: Column, whole: bool = True) -> Column:
    """Divide and round toward minus infinity; a zero divisor is an error.

    ``whole`` is the form for integers, exact past 2^53; otherwise both sides are doubles.
    """
    exact = left - mod(left, right)
    return F.call_function("div", exact, right) if whole else F.rint(exact / right)


def mod(left: Column, right: Column) -> Column:
    """Remainder with the sign of the divisor; a zero divisor is an error."""
    rest = left % right
    return F.when((rest != 0) & ((rest < 0) != (right < 0)), rest + right).otherwise(rest)


def power(left: Column, right: Column) -> Column:
    return F.pow(left, right)


def power_whole(left: Column, right: int) -> Column:
    """An integer to a whole power, exact in 64 bits; overflow is an error."""
    if right < 0:
        return F.pow(left, F.lit(right))
    result = F.lit(1).cast("long")
    for _ in range(right):
        result = result * left.cast("long")
    return result


def neg(c: Column) -> Column:
    return -c


def absolute(c: Column) -> Column:
    return F.abs(c)


def round_to(c: Column, places: int = 0) -> Column:
    """Round half to even; to a whole number when no places are kept."""
    rounded = F.bround(c, places)
    return rounded.cast("long") if places <= 0 else rounded


def floor(c: Column) -> Column:
    return F.floor(c)


def ceil(c: Column) -> Column:
    return F.ceil(c)


def clamp(c: Column, low: object, high: object) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
