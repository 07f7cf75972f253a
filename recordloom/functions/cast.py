"""Casts from text and between scalar types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import logic, text

# Words read as true and as false, and currency signs dropped in front.
TRUE_WORDS = ("true", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "no", "n", "0", "off", "")
CURRENCY = "$£€"

_WHOLE = r"^[+-]?\d+$"
_REAL = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def _cleaned(c: Column) -> Column:
    return F.translate(text.trim(c), ",_", "")


def _real(c: Column) -> Column:
    bare = text.trim(c)
    return F.when(F.rlike(bare, F.lit(_REAL)), bare.try_cast("double"))


def _without_currency(c: Column) -> Column:
    return text.trim(F.ltrim(c, F.lit(CURRENCY)))


def number(c: Column, dtype: T.DataType, fallback: object = None, strict: bool = False) -> Column:
    """A double from text such as ``$1,234.50``, ``12.5%`` or ``1_000``, or from a number."""
    if isinstance(dtype, T.BooleanType):
        found = F.when(c, 1.0).when(~c, 0.0)
    elif isinstance(dtype, T.NumericType):
        found = c.cast("double")
    elif isinstance(dtype, T.StringType):
        clean = _cleaned(c)
        percent = F.when(F.endswith(clean, F.lit("%")), _real(F.regexp_replace(clean, "%$", "")) / 100)
        found = F.coalesce(percent, _real(_without_currency(clean)))
    else:
        found = F.lit(None).cast("double")
    return _or_fallback(c, found, fallback, strict)


def integer(c: Column, dtype: T.DataType, fallback: object = None, strict: bool = False) -> Column:
    """A whole number, cut toward zero; whole-number text stays exact over 64 bits."""
    if isinstance(dtype, T.IntegralType):
        return _or_fallback(c, c.cast("long"), fallback, strict)
    if isinstance(dtype, T.StringType):
        bare = _without_currency(_cleaned(c))
        exact = F.when(F.rlike(bare, F.lit(_WHOLE)), bare.try_cast("long"))
        found = F.coalesce(exact, number(c, dtype).try_cast("long"))
    else:
        found = number(c, dtype).try_cast("long")
    return _or_fallback(c, found, fallback, strict)


def _or_fallback(c: Column, found: Column, fallback: object, strict: bool) -> Column:
    if fallback is not None:
        return F.coalesce(found, F.lit(fallback))
    if strict:
        message = F.concat(F.lit("cannot read as a number: "), F.coalesce(c.cast("string"), F.lit("null")))
        return F.coalesce(found, F.raise_error(message).cast("double"))
    return found


def boolean(c: Column, dtype: T.DataType) -> Column:
    """Known words first, then truthiness."""
    if not isinstance(dtype, T.StringType):
        return logic.truthy(c, dtype)
    word = F.lower(text.trim(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(logic.truthy(c, dtype))


def as_list(c: Column, dtype: T.DataType) -> Column:
    """A list as it is, null as an empty list, anything else as a list of one."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(c, F.array().cast(dtype))
    kept = F.array(c)
    return F.when(c.isNull(), F.array().cast(T.ArrayType(dtype))).otherwise(kept)


def type_of(c: Column, dtype: T.DataType) -> Column:
    """null, boolean, number, string, list or object."""
    if isinstance(dtype, T.VariantType):
        shape = F.schema_of_variant(c)
        return (
            F.when(c.isNull() | (shape == "VOID"), "null")
            .when(shape == "BOOLEAN", "boolean")
            .when(shape.startswith("ARRAY"), "list")
            .when(shape.startswith("OBJECT"), "object")
            .when(shape == "STRING", "string")
            .otherwise("number")
        )
    names = (
        (T.BooleanType, "boolean"),
        (T.NumericType, "number"),
        (T.StringType, "string"),
        (T.ArrayType, "list"),
        ((T.StructType, T.MapType), "object"),
    )
    name = next((label for kind, label in names if isinstance(dtype, kind)), dtype.simpleString())
    return F.when(c.isNull(), "null").otherwise(name)


def to_type(c: Column, dtype: T.DataType, wanted: str) -> Column:
    """The column cast of ``cast_schema``: unreadable values become null."""
    if wanted == "integer":
        return integer(c, dtype)
    if wanted == "number":
        return number(c, dtype)
    if wanted == "boolean":
        return F.when(c.isNotNull(), boolean(c, dtype))
    if wanted == "string":
        return F.when(c.isNotNull(), text.stringify(c, dtype))
    raise RecordError(f"{wanted!r} is no target type; choose from integer, number, boolean, string")
