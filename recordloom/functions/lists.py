"""Lists (arrays) and objects (maps, structs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError
from recordloom.functions import logic


def count(c: Column, dtype: T.DataType) -> Column:
    """Elements of a list or object, characters of a text; zero for null."""
    size = F.length(c) if isinstance(dtype, T.StringType) else F.size(c)
    return F.when(c.isNull(), 0).otherwise(size).cast("long")


def first(c: Column, fallback: object = None) -> Column:
    found = F.get(c, F.lit(0))
    return found if fallback is None else F.when(F.array_size(c) > 0, found).otherwise(F.lit(fallback))


def last(c: Column, fallback: object = None) -> Column:
    found = F.try_element_at(c, F.lit(-1))
    return found if fallback is None else F.when(F.array_size(c) > 0, found).otherwise(F.lit(fallback))


def item(c: Column, index: int) -> Column:
    """Zero-based element, negative from the end; out of range is an error."""
    return F.element_at(c, index + 1 if index >= 0 else index)


def slice_list(c: Column, start: int | None = None, stop: int | None = None) -> Column:
    """``[start:stop]`` with negative positions counted from the end."""
    size = F.array_size(c)
    low = _position(0 if start is None else start, size)
    high = size if stop is None else _position(stop, size)
    return F.slice(c, low + 1, F.greatest(high - low, F.lit(0)))


def slice_text(c: Column, start: int | None = None, stop: int | None = None) -> Column:
    size = F.length(c)
    low = _position(0 if start is None else start, size)
    high = size if stop is None else _position(stop, size)
    return F.substr(c, low + 1, F.greatest(high - low, F.lit(0)))


def _position(index: int, size: Column) -> Column:
    return F.least(F.lit(index), size) if index >= 0 else F.greatest(size + index, F.lit(0))


def take(c: Column, n: int) -> Column:
    return slice_list(c, 0, n)


def drop(c: Column, n: int) -> Column:
    return slice_list(c, n, None)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def flatten_lists(c: Column, depth: int = 1) -> Column:
    for _ in range(depth):
        c = F.flatten(c)
    return c


def unique(c: Column, by: str | None = None) -> Column:
    """Distinct elements, or those with a new field value, in first-seen order."""
    if by is None:
        return F.array_distinct(c)
    keys = F.transform(c, lambda x: F.struct(x[by].alias("k")))
    return F.filter(c, lambda x, i: F.array_position(keys, F.struct(x[by].alias("k"))) == i + 1)


def sort(c: Column, by: str | None = None, descending: bool = False) -> Column:
    """Sorted elements, null first; the other way round when descending."""
    if by is None:
        return F.sort_array(c, asc=not descending)
    keyed = F.transform(c, lambda x, i: F.struct(x[by].alias("k"), (-i if descending else i).alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed, asc=not descending), lambda x: x["x"])


def pluck(c: Column, field: str) -> Column:
    return F.transform(c, lambda x: x[field])


def keep(c: Column, predicate) -> Column:
    """Elements for which the predicate holds."""
    return F.filter(c, predicate)


def project(c: Column, dtype: T.DataType) -> Column:
    """One level down: values of an object, elements of nested lists."""
    if isinstance(dtype, T.MapType):
        return F.map_values(c)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.ArrayType):
        return F.flatten(c)
    return c


def chunk(c: Column, size: int) -> Column:
    """Batches of ``size`` elements; the last may be shorter."""
    if size <= 0:
        raise RecordError("a batch holds at least one element")
    starts = F.sequence(F.lit(0), F.array_size(c) - 1, F.lit(size))
    batches = F.transform(starts, lambda i: F.slice(c, i + 1, F.lit(size)))
    return F.when(F.array_size(c) > 0, batches).otherwise(F.when(c.isNotNull(), F.filter(F.array(c), lambda _: F.lit(False))))


def zip_lists(left: Column, right: Column) -> Column:
    """Pairs by position, as long as the shorter list."""
    pairs = F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.slice(pairs, F.lit(1), F.least(F.array_size(left), F.array_size(right)))


def difference(left: Column, right: Column) -> Column:
    """Elements of the left that the right does not hold, repeats kept."""
    return F.filter(left, lambda x: ~F.exists(right, lambda y: y.eqNullSafe(x)))


def total(c: Column) -> Column:
    """Sum of the elements, null skipped; zero for an empty list."""
    kept = F.filter(c, lambda x: x.isNotNull())
    return F.aggregate(kept, F.lit(0).cast("double"), lambda a, x: a + x)


def average(c: Column) -> Column:
    kept = F.filter(c, lambda x: x.isNotNull())
    return F.try_divide(total(kept), F.array_size(kept))


def minimum(c: Column) -> Column:
    return F.array_min(c)


def maximum(c: Column) -> Column:
    return F.array_max(c)


def median(c: Column) -> Column:
    """Exact middle value; the mean of the two middle values for an even count."""
    kept = F.sort_array(F.filter(c, lambda x: x.isNotNull()))
    half = F.call_function("div", F.array_size(kept), F.lit(2)).cast("int")
    high = F.get(kept, half)
    low = F.get(kept, half - 1)
    return F.when(F.array_size(kept) % 2 == 1, high.cast("double")).otherwise((low + high) / 2)


def any_of(c: Column, dtype: T.ArrayType) -> Column:
    return F.coalesce(F.exists(c, lambda x: logic.truthy(x, dtype.elementType)), F.lit(False))


def all_of(c: Column, dtype: T.ArrayType) -> Column:
    return F.coalesce(F.forall(c, lambda x: logic.truthy(x, dtype.elementType)), F.lit(True))


def keys(c: Column) -> Column:
    return F.map_keys(c)


def values(c: Column) -> Column:
    return F.map_values(c)


def entries(c: Column) -> Column:
    return F.map_entries(c)


def pick(c: Column, *names: str) -> Column:
    return F.map_filter(c, lambda k, _: k.isin(*names))


def omit(c: Column, *names: str) -> Column:
    return F.map_filter(c, lambda k, _: ~k.isin(*names))


def pick_struct(c: Column, dtype: T.StructType, *names: str) -> Column:
    kept = [name for name in names if name in dtype.fieldNames()]
    return F.struct(*[c[name].alias(name) for name in kept])


def omit_struct(c: Column, dtype: T.StructType, *names: str) -> Column:
    kept = [name for name in dtype.fieldNames() if name not in names]
    return F.struct(*[c[name].alias(name) for name in kept])


def merge(*maps: Column) -> Column:
    """One object from several, later keys winning; needs no session setting."""
    out = maps[0]
    for later in maps[1:]:
        taken = F.map_keys(later)
        out = F.map_concat(_without(out, taken), later)
    return out


def _without(c: Column, taken: Column) -> Column:
    return F.map_filter(c, lambda k, _: ~F.array_contains(taken, k))


def merge_structs(left: Column, left_type: T.StructType, right: Column, right_type: T.StructType) -> Column:
    names = list(dict.fromkeys([*left_type.fieldNames(), *right_type.fieldNames()]))
    return F.struct(*[(right if n in right_type.fieldNames() else left)[n].alias(n) for n in names])
