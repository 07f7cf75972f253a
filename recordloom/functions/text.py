"""Text helpers."""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_QUOTE = re.compile(r"([\\.\[\]{}()*+?^$|#-])")


def quote(literal: str) -> str:
    """A Java regular expression that matches ``literal`` itself."""
    return _QUOTE.sub(r"\\\1", literal)


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column, chars: str | None = None) -> Column:
    """Strip all white space, tabs and line ends included; or the given characters."""
    return F.btrim(c, F.lit(WHITE_SPACE if chars is None else chars))


def split(c: Column, sep: str = ",", limit: int = -1) -> Column:
    """Cut at a literal separator; ``limit`` is the number of cuts."""
    return F.split(c, quote(sep), limit + 1 if limit >= 0 else -1)


def split_trimmed(c: Column, sep: str = ",", strip: bool = True) -> Column:
    parts = split(c, sep)
    return F.transform(parts, trim) if strip else parts


def replace(c: Column, old: str, new: str, count: int = -1) -> Column:
    if count < 0:
        return F.replace(c, F.lit(old), F.lit(new))
    return F.array_join(split(c, old, count), new)


def starts_with(c: Column, prefix: str) -> Column:
    return F.startswith(c, F.lit(prefix))


def ends_with(c: Column, suffix: str) -> Column:
    return F.endswith(c, F.lit(suffix))


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _groups(pattern: str) -> tuple[str, list[str | None]]:
    """The pattern in Java's spelling, and the name (or None) of each of its groups, in order."""
    pattern = pattern.replace("(?P<", "(?<")
    names: list[str | None] = []
    at, in_class = 0, False
    while at < len(pattern):
        sign = pattern[at]
        if sign == "\\":
            quoted = pattern.find("\\E", at) if pattern[at + 1 : at + 2] == "Q" else -1
            at = quoted + 2 if quoted >= 0 else at + 2
            continue
        if sign in "[]":
            in_class = sign == "["
        elif sign == "(" and not in_class:
            named = re.match(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern[at:])
            if named or pattern[at + 1 : at + 2] != "?":
                names.append(named[1] if named else None)
        at += 1
    return pattern, names


def extract(c: Column, pattern: str, group: int | str = 0, keep_empty: bool = False) -> Column:
    """First match or one of its groups, by number or name; null when nothing, or not that group, matched.

    Names are written ``(?<name>…)`` or ``(?P<name>…)``. Spark reads an absent optional group and
    one that matched empty text alike, as empty: it becomes null here, or stays empty with
    ``keep_empty`` for patterns such as ``a(b*)``.
    """
    pattern, names = _groups(pattern)
    if group not in names if isinstance(group, str) else group > len(names):
        raise RecordError(f"group {group} is not in the pattern {pattern!r}")
    group = names.index(group) + 1 if isinstance(group, str) else group
    if group == 0:
        return F.regexp_substr(c, F.lit(pattern))
    found = F.regexp_extract(c, pattern, group)
    if keep_empty:
        return F.when(F.rlike(c, F.lit(pattern)), found)
    return F.nullif(found, F.lit(""))


def extract_all(c: Column, pattern: str) -> Column:
    """Every match: its text, its only group, or an array of its groups."""
    pattern, names = _groups(pattern)
    if len(names) <= 1:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(len(names)))
    each = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(1, len(names) + 1)]
    return F.transform(each[0], lambda _, i: F.array(*[F.get(column, i) for column in each]))


def pad_left(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def pad_right(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def pad_center(c: Column, width: int, fill: str = " ") -> Column:
    """Centre the text; an odd spare place goes left when the width is odd, else right."""
    spare = F.lit(width) - F.length(c)
    left = F.floor(spare / 2).cast("int") + (spare.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1)))
    return F.when(F.length(c) >= width, c).otherwise(
        F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), spare - left))
    )


def title(c: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substr(r, F.lit(2)))), ""
    )


def truncate(c: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > length, F.concat(F.left(c, F.lit(length - len(suffix))), F.lit(suffix))).otherwise(c)


def slug(c: Column, lower_case: bool = True) -> Column:
    text = F.lower(c) if lower_case else c
    allowed = "a-z0-9" if lower_case else "a-zA-Z0-9"
    return F.regexp_replace(F.regexp_replace(text, f"[^{allowed}]+", "-"), "^-+|-+$", "")


def number_text(c: Column) -> Column:
    """A double as the shortest plain text: exponents only from 1e16 and below 1e-4."""
    raw, size = c.cast("string"), F.abs(c)
    # Java writes an exponent from 1e7 and below 1e-3; spell those ranges out.
    large = F.rtrim(c.try_cast("decimal(26,10)").cast("string"), F.lit("0"))
    large = F.when(F.endswith(large, F.lit(".")), F.concat(large, F.lit("0"))).otherwise(large)
    small = F.rtrim(c.try_cast("decimal(38,24)").cast("string"), F.lit("0"))
    power = F.substring_index(raw, "E", -1).try_cast("int")
    digits = F.abs(power).cast("string")
    exponent = F.concat(
        F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", ""),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits),
    )
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (c == 0), raw)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(F.isnan(c), F.lit("nan"))
        .when(size == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(exponent)
    )


def stringify(c: Column, dtype: T.DataType) -> Column:
    """Text of a value: null is empty, booleans are lower-case, nested values are JSON."""
    if isinstance(dtype, T.NullType):
        return F.lit("")
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(json_encode(c), F.lit(""))
    if isinstance(dtype, T.VariantType):
        return F.coalesce(F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c)), F.lit(""))
    if isinstance(dtype, T.BinaryType):
        return F.coalesce(F.decode(c, "UTF-8"), F.lit(""))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(number_text(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def join(c: Column, dtype: T.ArrayType, sep: str = ",") -> Column:
    """A list as one text; null elements are empty."""
    return F.array_join(F.transform(c, lambda x: stringify(x, dtype.elementType)), sep)


def template(pattern: str, columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``{field}`` places filled from columns; an unknown field is an error."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(pattern):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            if name not in columns:
                raise RecordError(f"nothing fills {{{name}}}; fields: {', '.join(columns)}")
            parts.append(stringify(*columns[name]))
    return F.concat(*parts) if parts else F.lit("")


def interpolate(pattern: str, columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``{{field}}`` places filled from columns; single braces are plain text."""
    parts = [F.lit("")]
    for index, piece in enumerate(re.split(r"\{\{\s*([^{}]+?)\s*\}\}", pattern)):
        if index % 2 and piece not in columns:
            raise RecordError(f"nothing is named {piece!r}; available: {', '.join(columns)}")
        parts.append(stringify(*columns[piece]) if index % 2 else F.lit(piece))
    return F.concat(*parts)


def format_text(pattern: str, *values: tuple[Column, T.DataType]) -> Column:
    """``{}`` places filled in order; spare places stay, spare values are dropped."""
    pieces = pattern.split("{}")
    parts = [F.lit(pieces[0])]
    for index, piece in enumerate(pieces[1:]):
        parts.append(stringify(*values[index]) if index < len(values) else F.lit("{}"))
        parts.append(F.lit(piece))
    return F.concat(*parts)


def url_encode(c: Column) -> Column:
    """Percent-encode everything but letters, digits and ``-._~``."""
    encoded = F.url_encode(c)
    for old, new in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def json_parse(c: Column, strict: bool = True) -> Column:
    """JSON text as VARIANT; bad text is an error, or null when not strict."""
    return F.parse_json(c) if strict else F.try_parse_json(c)


def json_encode(c: Column, pretty: bool = False) -> Column:
    """JSON with nulls kept, compact unless ``pretty``."""
    return F.to_json(c, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
