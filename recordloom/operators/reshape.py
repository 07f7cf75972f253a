"""Records, flattening, exploding and column layout.

Schemas are walked on the driver; every operator adds one projection to the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import RecordError, require_columns
from recordloom.functions import text
from recordloom.operators.schema import col

# The keys a list of records is commonly wrapped in, in order of preference.
ENVELOPES = ("data", "items", "results", "records", "rows")
MAX_DEPTH = 12
#: Bound of the schema that ``expand_maps`` makes on the driver; more keys are refused, never cut.
MAX_MAP_KEYS = 10_000


def records(df: DataFrame, search: bool = False) -> DataFrame:
    """The rows inside a frame of documents; call it where rows are known to be whole documents.

    Ordinary rows may hold a list of that name too, and would lose their other columns. The first envelope name that holds a list wins; with ``search`` any other list of
    objects is taken next. A frame without either is its own rows. List elements that are
    not objects become a column named ``value``.
    """
    lists = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    found = next((name for name in ENVELOPES if name in lists), None)
    if found is None and search:
        found = next((n for n, t in lists.items() if isinstance(t.elementType, T.StructType)), None)
    if found is None:
        return df
    if isinstance(lists[found].elementType, T.StructType):
        return df.select(F.inline(col(found)))
    return df.select(F.explode(col(found)).alias("value"))


def flatten(
    df: DataFrame,
    sep: str = "_",
    explode: str | Sequence[str] | None = None,
    max_depth: int = MAX_DEPTH,
    expand_maps: bool = False,
) -> DataFrame:
    """Nested objects to ``a_b`` columns, depth first.

    Lists of scalars become comma-joined text, other lists JSON text, empty lists null.
    Objects deeper than ``max_depth`` stay. A name already taken, in whatever case, gets ``_2``, ``_3``.
    ``expand_maps`` gives each key of a top-level map its own column (one pass to find them).
    """
    for name in [explode] if isinstance(explode, str) else list(explode or []):
        df = explode_rows(df, name)
    if expand_maps:
        df = _expand_maps(df)
    out: dict[str, Column] = {}
    for f in df.schema.fields:
        _walk(f.name, col(f.name), f.dataType, sep, max_depth, 1, out)
    return df.select(*[c.alias(name) for name, c in out.items()])


def _walk(
    name: str, c: Column, dtype: T.DataType, sep: str, max_depth: int, depth: int, out: dict[str, Column]
) -> None:
    if isinstance(dtype, T.StructType) and depth < max_depth:
        for f in dtype.fields:
            _walk(f"{name}{sep}{f.name}", c[f.name], f.dataType, sep, max_depth, depth + 1, out)
        return
    place, index = name, 2
    taken = {n.lower() for n in out}  # tables and files tell names apart without case
    while place.lower() in taken:
        place, index = f"{name}_{index}", index + 1
    out[place] = _cell(c, dtype)


def _cell(c: Column, dtype: T.DataType) -> Column:
    if not isinstance(dtype, T.ArrayType):
        return c
    if isinstance(dtype.elementType, (T.ArrayType, T.StructType, T.MapType)):
        written = text.json_encode(c)
    else:
        written = text.join(c, dtype)
    return F.when(F.array_size(c) > 0, written)


def _expand_maps(df: DataFrame) -> DataFrame:
    for f in [f for f in df.schema.fields if isinstance(f.dataType, T.MapType)]:
        keys = df.select(F.explode(F.map_keys(col(f.name))).alias("k")).distinct()
        found = [row.k for row in keys.orderBy("k").limit(MAX_MAP_KEYS + 1).collect()]
        if len(found) > MAX_MAP_KEYS:
            raise RecordError(f"{f.name!r} has more than {MAX_MAP_KEYS} distinct keys; keep it as a map")
        fields = [F.try_element_at(col(f.name), F.lit(k)).alias(str(k)) for k in found]
        if fields:
            df = df.withColumn(f.name, F.struct(*fields))
    return df


def explode_rows(df: DataFrame, name: str) -> DataFrame:
    """One row per element of a list; an empty or missing list keeps its row.

    Objects become ``name_key`` columns and ``name`` goes; scalars stay under ``name``. A
    column that is not a list is cleared to null.
    """
    dtype = df.schema[name].dataType if name in df.columns else None
    if not isinstance(dtype, T.ArrayType):
        return df.withColumn(name, F.lit(None).cast(dtype or T.NullType()))
    others = [c for c in df.columns if c != name]
    element = "__element"
    rows = df.select(*[col(c) for c in others], F.explode_outer(col(name)).alias(element))
    if not isinstance(dtype.elementType, T.StructType):
        return rows.withColumnRenamed(element, name)
    new = {f"{name}_{f.name}": F.col(element)[f.name] for f in dtype.elementType.fields}
    # An existing column of the same name is taken over wherever there is an element.
    kept = [
        F.when(F.col(element).isNotNull(), new.pop(c)).otherwise(col(c)).alias(c) if c in new else col(c)
        for c in others
    ]
    return rows.select(*kept, *[c.alias(n) for n, c in new.items()])


def explode(df: DataFrame, name: str) -> DataFrame:
    """``explode_rows`` followed by ``flatten``."""
    return flatten(explode_rows(df, name))


def to_table(df: DataFrame, documents: bool = False) -> DataFrame:
    """The rows, flattened; with ``documents`` the records inside them."""
    return flatten(records(df) if documents else df)


def extract_column(
    df: DataFrame, field: str, pattern: str, group: int = 1, into: str | None = None
) -> DataFrame:
    """A group of the first match in a field, put into a new column or over the field itself."""
    require_columns(df.columns, [field])
    source = text.stringify(col(field), df.schema[field].dataType)
    return df.withColumn(into or field, text.extract(source, pattern, group))


def normalize(df: DataFrame, sep: str = "_") -> DataFrame:
    return flatten(df, sep=sep)


def align(frames: Sequence[DataFrame], columns: str = "union") -> DataFrame:
    """Stack frames with the columns of all, of all in common, or of the first."""
    names = list(dict.fromkeys(n for frame in frames for n in frame.columns))
    if columns == "first":
        names = list(frames[0].columns)
    elif columns == "intersection":
        names = [n for n in names if all(n in frame.columns for frame in frames)]
    elif columns != "union":
        raise RecordError(f"unknown column policy {columns!r}; use union, intersection or first")
    kept = [frame.select(*[col(n) for n in names if n in frame.columns]) for frame in frames]
    out = kept[0]
    for frame in kept[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.select(*[col(n) for n in names])


def json_columns(df: DataFrame, json_column: str, columns: str = "union", order_by: Sequence[str] = ()) -> DataFrame:
    """``field, present`` of the keys a column of JSON objects would keep under a policy.

    Presence of a key is not the same as a non-null value, so keys are counted as keys. The
    policy ``first`` keeps the keys of the first object in ``order_by``.
    """
    if columns not in ("union", "intersection", "first"):
        raise RecordError(f"unknown column policy {columns!r}; use union, intersection or first")
    keys = F.json_object_keys(col(json_column))
    counts = df.select(F.explode(keys).alias("field")).groupBy("field").agg(F.count("*").alias("present"))
    if columns == "intersection":
        return counts.filter(F.col("present") == df.count())
    if columns == "first":
        require_columns(df.columns, order_by)
        first = df.agg(F.min_by(col(json_column), F.struct(*[col(o) for o in order_by])).alias("j"))
        return counts.join(first.select(F.explode(F.json_object_keys("j")).alias("field")), "field", "left_semi")
    return counts


def unflatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """``a_b`` columns back to nested objects; a scalar in the way is replaced."""
    tree: dict = {}
    for name in df.columns:
        *parents, leaf = name.split(sep)
        cursor = tree
        for part in parents:
            if not isinstance(cursor.get(part), dict):
                cursor[part] = {}
            cursor = cursor[part]
        cursor[leaf] = col(name)

    def build(node: dict | Column) -> Column:
        if isinstance(node, dict):
            return F.struct(*[build(child).alias(name) for name, child in node.items()])
        return node

    return df.select(*[build(node).alias(name) for name, node in tree.items()])


def _names(columns: tuple) -> list[str]:
    return list(columns[0]) if len(columns) == 1 and not isinstance(columns[0], str) else list(columns)


def select(df: DataFrame, *columns: str | Iterable[str], missing: str = "error") -> DataFrame:
    """Named columns; an unknown one is an error, or null with ``missing='null'``."""
    wanted = _names(columns)
    if missing == "error":
        require_columns(df.columns, wanted)
    return df.select(*[col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in wanted])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """New names; unknown old names are ignored."""
    return df.withColumnsRenamed(mapping)


def map_fields(
    df: DataFrame, mapping: dict[str, str], include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Keep, drop and rename columns in one projection; old names decide what is kept."""
    kept = [n for n in df.columns if n not in exclude and (not include or n in include)]
    return df.select(*[col(n).alias(mapping.get(n, n)) for n in kept])


def pluck(df: DataFrame, column: str, default: object = None) -> DataFrame:
    """One column; the default stands in only where the frame lacks the column."""
    if column in df.columns:
        return df.select(col(column))
    return df.select(F.lit(default).alias(column))


def fill_nulls(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Null or absent fields replaced; an absent column is added."""
    return df.withColumns(
        {n: F.coalesce(col(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in defaults.items()}
    )


def pivot(
    df: DataFrame,
    index: str,
    column: str,
    value: str,
    order_by: Sequence[str],
    values: Sequence[object] | None = None,
) -> DataFrame:
    """Distinct values of ``column`` as columns; the last row in order wins a cell.

    Give ``values`` when they are known: else one distinct pass finds them, and more than
    ``spark.sql.pivotMaxValues`` is an error.
    """
    require_columns(df.columns, [index, column, value, *order_by])
    # The value is wrapped so that a last row holding null still wins.
    last = F.max_by(F.struct(col(value).alias("v")), F.struct(*[col(o) for o in order_by]))
    wide = df.groupBy(col(index)).pivot(column, list(values) if values is not None else None).agg(last)
    cells = [col(n)["v"].alias(n) for n in wide.columns if n != index]
    return wide.select(col(index), *cells)
