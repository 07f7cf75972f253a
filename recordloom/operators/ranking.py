"""The k-th row of a frame, found by counting, and the rows on either side of it.

Nothing is numbered, moved or written to find it. Each round takes a few splitters of the rows still
in question, counts what lies between and on them in one pass over the order columns, and keeps the
one interval that holds the rank; a value that is hot is an interval of its own, so it ends the search.
The rows themselves are then only filtered. A frame is read several times: it must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.errors import require_columns
from recordloom.operators import ordering
from recordloom.operators.schema import col

#: Splitters of a round, and ranks that are read off the first rows of an interval.
SPLITTERS, FEW = 63, 10_000
_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


@dataclass(frozen=True)
class Edge:
    """The values of the k-th row in order, how many rows are before any with these, and how many have them."""

    values: tuple[object, ...]
    before: int
    equal: int


class Order:
    """Columns to order by; null is the least value, so it comes first, or last where the order goes down."""

    def __init__(self, df: DataFrame, names: Sequence[str], descending: bool | Sequence[str] = False):
        require_columns(df.columns, names)
        self.names = list(names)
        self.down = [descending is True or n in (descending or ()) for n in self.names]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        self.kinds = [kinds[n] for n in self.names]

    @property
    def plain(self) -> bool:
        """Whether every column is of a type whose values can be named in an expression."""
        return all(isinstance(k, _PLAIN) for k in self.kinds)

    def sorting(self, names: Sequence[str] | None = None, back: bool = False) -> list[Column]:
        return [col(n).desc() if d != back else col(n).asc() for n, d in zip(names or self.names, self.down, strict=True)]

    def told(self) -> list[Column]:
        """The order columns in a form that reaches the driver and comes back as it was."""
        shown = []
        for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)):
            c = col(n)
            if isinstance(k, T.TimestampType):
                c = F.unix_micros(c)
            elif isinstance(k, (T.TimestampNTZType, T.DateType)):
                c = c.cast("string")
            shown.append(c.alias(f"__o{i}"))
        return shown

    def _literal(self, value: object, kind: T.DataType) -> Column:
        if isinstance(kind, T.TimestampType):
            return F.timestamp_micros(F.lit(value))
        return F.lit(value).cast(kind)

    def same(self, point: Sequence[object]) -> Column:
        """Rows with just these values."""
        found = F.lit(True)
        for n, k, v in zip(self.names, self.kinds, point, strict=True):
            found = found & (col(n).isNull() if v is None else F.coalesce(col(n) == self._literal(v, k), F.lit(False)))
        return found

    def before(self, point: Sequence[object]) -> Column:
        """Rows that come before any with these values."""
        found = F.lit(False)
        for i in range(len(self.names) - 1, -1, -1):
            c, v = col(self.names[i]), point[i]
            at = None if v is None else self._literal(v, self.kinds[i])
            if self.down[i]:
                ahead = c.isNotNull() if v is None else F.coalesce(c > at, F.lit(False))
            else:
                ahead = F.lit(False) if v is None else c.isNull() | (c < at)
            equal = c.isNull() if v is None else F.coalesce(c == at, F.lit(False))
            found = ahead | (equal & found)
        return found


def _interval(order: Order, points: list[tuple[object, ...]], low: int, high: int) -> Column:
    """2i for rows between splitters i - 1 and i, 2i + 1 for rows equal to splitter i; found by halving."""
    if low == high:
        return F.lit(2 * low)
    middle = (low + high) // 2
    return (
        F.when(order.before(points[middle]), _interval(order, points, low, middle))
        .when(order.same(points[middle]), F.lit(2 * middle + 1))
        .otherwise(_interval(order, points, middle + 1, high))
    )


def _splitters(inside: DataFrame, order: Order) -> list[tuple[object, ...]]:
    """A few of the rows in order, drawn by a hash of the row's place; equal ones once."""
    drawn = F.xxhash64(F.monotonically_increasing_id(), *[col(n) for n in order.names])
    few = inside.withColumn("__draw", drawn).orderBy("__draw").limit(SPLITTERS)
    return list(dict.fromkeys(tuple(r) for r in few.orderBy(*order.sorting()).select(*order.told()).collect()))


def edge(df: DataFrame, order_by: Sequence[str], k: int, descending: bool | Sequence[str] = False) -> Edge | None:
    """The ``k``-th row in order; None if there are fewer rows. Ties count as many rows."""
    order = Order(df, order_by, descending)
    keys = inside = df.select(*[col(n) for n in order.names])
    passed = 0
    while k - passed > FEW:
        points = _splitters(inside, order)
        counts = dict(inside.groupBy(_interval(order, points, 0, len(points)).alias("at")).count().collect())
        for at in sorted(counts):
            if passed + counts[at] >= k:
                break
            passed += counts[at]
        else:
            return None
        if at % 2:
            return Edge(points[at // 2], passed, counts[at])
        if at // 2 < len(points):
            inside = inside.filter(order.before(points[at // 2]))
        if at:
            inside = inside.filter(~order.before(points[at // 2 - 1]) & ~order.same(points[at // 2 - 1]))
    last = inside.orderBy(*order.sorting()).offset(k - passed - 1).limit(1).select(*order.told()).collect()
    if not last:
        return None
    point = tuple(last[0])
    before, equal = keys.agg(F.count_if(order.before(point)), F.count_if(order.same(point))).first()
    return Edge(point, before, equal)


def behind(df: DataFrame, order_by: Sequence[str], k: int, descending: bool | Sequence[str] = False, unique: bool = False) -> DataFrame:
    """The rows behind the first ``k``: exactly ``k`` rows are left out, ties by arrival.

    Only where the edge cuts through ties are these numbered, and nothing else. ``unique`` promises that there
    are none. Orders by nested columns number all rows.
    """
    if k <= 0:
        return df
    order = Order(df, order_by, descending)
    if not order.plain:
        return ordering.number_rows(df, order_by, "__n", descending=descending, unique=unique).filter(F.col("__n") > k).drop("__n")
    found = edge(df, order_by, k, descending)
    if found is None:
        return df.filter(F.lit(False))
    later = df.filter(~order.before(found.values) & ~order.same(found.values))
    if unique or found.before + found.equal == k:
        return later
    ties = ordering.number_rows(df.filter(order.same(found.values)), order_by, "__n", descending=descending)
    return later.unionByName(ties.filter(F.col("__n") > k - found.before).drop("__n"))


def behind_within(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], k: int, descending: bool | Sequence[str] = False
) -> DataFrame:
    """The rows behind the first ``k`` of every key.

    Keys and order columns alone are laid out and numbered; the edges they give, one row for each key with
    more than ``k`` rows, meet the rows. Ties that an edge cuts through are numbered by arrival.
    """
    if k <= 0:
        return df
    order = Order(df, order_by, descending)
    named = [col(n) for n in dict.fromkeys([*keys, *order_by])]
    numbered = ordering.number_within(df.select(*named), keys, order_by, "__n", descending, unique=True)
    named_edge = [*[col(n).alias(f"__k{i}") for i, n in enumerate(keys)], *[col(n).alias(f"__e{i}") for i, n in enumerate(order.names)]]
    edges = numbered.filter(F.col("__n") == k).select(*named_edge)
    at_key = [col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(keys)]
    at_edge = [col(n).eqNullSafe(F.col(f"__e{i}")) for i, n in enumerate(order.names)]
    both = lambda parts: [*parts][0] if len(parts) == 1 else parts[0] & both(parts[1:])
    marks = [f"__k{i}" for i in range(len(keys))] + [f"__e{i}" for i in range(len(order.names))]
    sizes = numbered.join(edges, both(at_key + at_edge)).groupBy(*marks).agg(F.min("__n").alias("__first"), F.max("__n").alias("__last"))
    placed = df.join(sizes, both(at_key))
    later = F.lit(False)
    for i in range(len(order.names) - 1, -1, -1):
        c, v = col(order.names[i]), F.col(f"__e{i}")
        past = F.coalesce(c < v, v.isNotNull() & c.isNull()) if order.down[i] else F.coalesce(c > v, c.isNotNull() & v.isNull())
        later = past | (c.eqNullSafe(v) & later)
    drop = [*marks, "__first", "__last"]
    rest = placed.filter(later).drop(*drop)
    cut = placed.filter(both(at_edge) & (F.col("__last") > k))
    ties = ordering.number_within(cut, keys, order_by, "__n", descending)
    return rest.unionByName(ties.filter(F.col("__n") > k - F.col("__first") + 1).drop("__n", *drop))
