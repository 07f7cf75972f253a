"""Dates as UTC wall-clock ``TIMESTAMP_NTZ``, so no result depends on the session zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import text

# Seconds per unit, and strftime directives with their Spark letters.
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_LOCAL = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d{1,6})?)?)?$"
_ZONED = r"^(\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:[.,]\d{1,6})?)?)(Z|z|[+-]\d{2}:?\d{2}(?::?\d{2})?)$"
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
_NAMED = r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"
_DIGITS = r"^\d{8}$"
_MILLIS_ABOVE = 1e11


def spark_pattern(strftime: str) -> str:
    """The Spark pattern for a strftime format."""

    def one(found: re.Match[str]) -> str:
        letter, literal = found.group(1), found.group(0)
        if letter == "%":
            return "%"
        if letter:
            if letter not in DIRECTIVES:
                raise RecordError(f"no Spark pattern for %{letter}")
            return DIRECTIVES[letter]
        return "'" + literal.replace("'", "''") + "'"

    return re.sub(r"%(.)|[A-Za-z']+", one, strftime)


def _local(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")


def _zoned(c: Column) -> Column:
    """ISO text with an offset, in UTC."""
    zone = F.regexp_extract(c, _ZONED, 2)
    digits = F.rpad(F.translate(zone, "+-:Zz", ""), 6, "0")  # Z reads as no offset
    part = lambda start: F.substring(digits, start, 2).try_cast("int")
    seconds = part(1) * 3600 + part(3) * 60 + part(5)
    offset = F.when(F.startswith(zone, F.lit("-")), -seconds).otherwise(seconds)
    return _local(F.regexp_extract(c, _ZONED, 1)) - F.make_dt_interval(secs=offset)


def _with_month_name(c: Column) -> Column:
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(c, -8, 3)))
    return F.concat_ws("-", F.right(c, F.lit(4)), month.cast("string"), F.substring_index(c, "-", 1)).try_cast("timestamp_ntz")


def _read(c: Column) -> Column:
    """The layouts tried without a format; each text fits at most one of these shapes."""
    return (
        F.when(F.rlike(c, F.lit(_LOCAL)), _local(c))
        .when(F.rlike(c, F.lit(_SLASHED)), F.coalesce(*[F.regexp_replace(c, _SLASHED, to).try_cast("timestamp_ntz") for to in ("$3-$2-$1", "$3-$1-$2")]))
        .when(F.rlike(c, F.lit(_ZONED)), _zoned(c))
        .when(F.rlike(c, F.lit(_NAMED)), _with_month_name(c))
        .when(F.rlike(c, F.lit(_DIGITS)), F.concat_ws("-", F.left(c, F.lit(4)), F.substring(c, 5, 2), F.substring(c, 7, 2)).try_cast("timestamp_ntz"))
    )


def to_date(c: Column, dtype: T.DataType, format: str | None = None, strict: bool = False) -> Column:
    """A point in time from text, a number of epoch seconds (or milliseconds), or a date."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, T.TimestampType):
        return F.to_utc_timestamp(c.cast("timestamp_ntz"), F.current_timezone()).cast("timestamp_ntz")
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):
        seconds = F.when(c > _MILLIS_ABOVE, c / 1000).otherwise(c.cast("double"))
        return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    if not isinstance(dtype, T.StringType):
        raise RecordError(f"a {dtype.simpleString()} is no date")
    value = text.trim(c)
    if format is not None:
        found = F.try_to_timestamp(value, F.lit(spark_pattern(format))).cast("timestamp_ntz")
    else:
        found = _read(value)
    if strict:
        problem = F.raise_error(F.concat(F.lit("cannot read as a date: "), c)).cast("timestamp_ntz")
        return F.when(c.isNotNull() & found.isNull(), problem).otherwise(found)
    return found


def date_format(c: Column, format: str = "%Y-%m-%d") -> Column:
    return F.date_format(c, spark_pattern(format))


def date_add(c: Column, days: float = 0, hours: float = 0, minutes: float = 0) -> Column:
    """Shift a point in time; fractions allowed."""
    micros = round((days * 86400 + hours * 3600 + minutes * 60) * 1_000_000)
    sign = "-" if micros < 0 else ""
    seconds, rest = divmod(abs(micros), 1_000_000)
    return c + F.expr(f"INTERVAL '{sign}{seconds}.{rest:06d}' SECOND")


def seconds_between(left: Column, right: Column) -> Column:
    """Exact decimal seconds from ``right`` to ``left``."""
    return (left - right).cast("interval second").cast("decimal(20,6)")


def date_diff(left: Column, right: Column, unit: str = "days") -> Column:
    """Gap in a unit, with its fraction."""
    if unit not in UNIT_SECONDS:
        raise RecordError(f"{unit!r} is no unit of time here; choose from {', '.join(UNIT_SECONDS)}")
    return seconds_between(left, right).cast("double") / UNIT_SECONDS[unit]


def timestamp(c: Column) -> Column:
    """Seconds since the epoch, with their fraction."""
    return seconds_between(c, F.lit("1970-01-01").cast("timestamp_ntz")).cast("double")


def now() -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def today() -> Column:
    return now().cast("date").cast("timestamp_ntz")
