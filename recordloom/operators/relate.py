"""Joins, lookups, reconciliation, stacking, deduplication, sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.errors import RecordError, require_columns
from recordloom.operators import ordering
from recordloom.operators.reshape import align
from recordloom.operators.schema import col

HOW = ("inner", "left", "right", "outer")
#: In an outer join a key is hot on a side where it holds more than so many rows; the most common ones are dealt to parts,
#: so many keys at most, each to so many parts at most.
HOT_ROWS, HOT_KEYS, HOT_PARTS = 100_000, 1000, 1000


def _listed(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _matching(a: DataFrame, b: DataFrame, keys: Sequence[str], null_keys: str) -> Column:
    """Key condition between frames whose columns carry the prefixes ``a.`` and ``b.``."""
    if null_keys not in ("match", "sql"):
        raise RecordError("null_keys is 'match' or 'sql'")
    condition = None
    for k in keys:
        x, y = a[f"`a.{k}`"], b[f"`b.{k}`"]
        one = x.eqNullSafe(y) if null_keys == "match" else x == y
        condition = one if condition is None else condition & one
    return condition


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[col(n).alias(f"{prefix}.{n}") for n in df.columns])


def join_records(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    null_keys: str = "match",
    salt: int = 1,
) -> DataFrame:
    """Equi-join on shared names; clashing other columns get ``_x`` and ``_y``.

    ``null_keys='match'`` pairs null with null, ``'sql'`` never does. The physical join is
    Spark's choice by size, with adaptive splitting of hot keys. ``salt`` also splits them
    by hand: rows of the preserved side get one of ``salt`` tags, the other side is repeated
    once per tag, and no row is lost. Where Spark will broadcast a side no key is hot in a
    task, and nothing is repeated. An outer join shuffles each side once and splits its
    hot keys itself (``_outer``), because Spark does not split a hot key of a full outer join;
    ``salt`` is not needed there and has no effect.
    """
    keys = _listed(on)
    if how not in HOW:
        raise RecordError(f"how={how!r} is no kind of join here; choose from {', '.join(HOW)}")
    require_columns(left.columns, keys, "left")
    require_columns(right.columns, keys, "right")
    a, b = _prefixed(left, "a"), _prefixed(right, "b")
    if how == "outer":
        paired = _outer(a, b, keys, null_keys)
    else:
        kept, other = (b, a) if how == "right" else (a, b)
        if _broadcast(other) or (how == "inner" and _broadcast(kept)):
            salt = 1  # a broadcast table would be as many times as large
        kept, other = _salted(kept, other, salt)
        condition = _matching(a, b, keys, null_keys)
        if salt > 1:
            condition = condition & (kept["__salt"] == other["__salt"])
        paired = kept.join(other, condition, "inner" if how == "inner" else "left")

    side = "b" if how == "right" else "a"
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    layout = [(k, f"{side}.{k}") if k in keys else (f"{k}_x" if k in shared else k, f"a.{k}") for k in left.columns]
    layout += [(f"{n}_y" if n in shared else n, f"b.{n}") for n in right.columns if n not in keys]
    return paired.select(*[col(source).alias(name) for name, source in layout])


def _hot(df: DataFrame, prefix: str, keys: Sequence[str], splits_a: bool, null_keys: str) -> DataFrame:
    """Keys that hold so many rows of a side that one task should not meet them all: at most ``HOT_KEYS``.

    A key with more than one row in ``HOT_KEYS`` is always among them. ``n`` is the number of parts
    its rows are dealt to. Counts are reduced on the map side and read the key columns alone.
    """
    counts = df.groupBy(*[col(f"{prefix}.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS)
    if null_keys == "sql":
        counts = counts.dropna(subset=[f"`{k}`" for k in keys])
    hot = counts.orderBy(F.col("__n").desc()).limit(HOT_KEYS)
    parts = F.least(F.ceil(F.col("__n") / HOT_ROWS), F.lit(HOT_PARTS).cast("long"))
    return hot.select(*[col(k) for k in keys], F.struct(parts.alias("n"), F.lit(splits_a).alias("splits_a")).alias("__deal"))


def _dealt(df: DataFrame, prefix: str, keys: Sequence[str], hot: DataFrame, null_keys: str) -> DataFrame:
    """Rows with the part they go to: hot rows of the split side to one each, those of the other side to all."""
    mark = f"__{prefix}"
    named = hot.select(*[col(k).alias(f"{mark}.{k}") for k in keys], F.col("__deal").alias(f"{mark}.deal"))
    same = F.lit(True)
    for k in keys:
        same = same & df[f"`{prefix}.{k}`"].eqNullSafe(named[f"`{mark}.{k}`"])
    n, splits_a = col(f"{mark}.deal")["n"], col(f"{mark}.deal")["splits_a"]
    spread = _content(df)
    copied = F.coalesce(splits_a != F.lit(prefix == "a"), F.lit(False))
    to = F.when(copied, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array(F.pmod(spread, F.coalesce(n, F.lit(1).cast("long")))))
    if null_keys == "sql":  # a null meets nothing, wherever it goes
        alone = F.lit(False)
        for k in keys:
            alone = alone | col(f"{prefix}.{k}").isNull()
        to = F.when(alone, F.array(F.pmod(spread, F.lit(HOT_PARTS).cast("long")))).otherwise(to)
    joined = df.join(F.broadcast(named), same, "left")
    return joined.select(*[col(c) for c in df.columns], copied.alias(f"{mark}.copied"), F.lit(True).alias(f"{mark}.here"), F.explode(to).alias(f"{mark}.part"))


def _outer(a: DataFrame, b: DataFrame, keys: Sequence[str], null_keys: str) -> DataFrame:
    """A full outer join in one shuffle a side, whatever share of the rows a key holds.

    Rows of a hot key are dealt to parts on the side that holds more of them and repeated for each
    part on the other. A part may hold none of the split side's rows, where a repeated row then meets
    nothing; as its key is known to be on the split side it meets something in another part, so
    these are left out. The list of hot keys has a bounded length and is broadcast.
    """
    both = _hot(a, "a", keys, True, null_keys).unionByName(_hot(b, "b", keys, False, null_keys))
    hot = both.groupBy(*[col(k) for k in keys]).agg(F.max("__deal").alias("__deal"))
    x, y = _dealt(a, "a", keys, hot, null_keys), _dealt(b, "b", keys, hot, null_keys)
    paired = x.join(y, _matching(x, y, keys, null_keys) & (x["`__a.part`"] == y["`__b.part`"]), "full")
    only_a, only_b = col("__b.here").isNull(), col("__a.here").isNull()
    whole = paired.filter(~((only_a & F.coalesce(col("__a.copied"), F.lit(False))) | (only_b & F.coalesce(col("__b.copied"), F.lit(False)))))
    return whole.withColumns({f"a.{k}": F.when(only_b, col(f"b.{k}")).otherwise(col(f"a.{k}")) for k in keys})


def _content(df: DataFrame) -> Column:
    """A hash of the row, so that a repeated task deals it alike; equal rows stay together. Maps have no hash."""
    hashed = [f.name for f in df.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*[col(n) for n in hashed]) if hashed else F.lit(0).cast("long")


def _broadcast(df: DataFrame) -> bool:
    """Whether Spark takes the frame for small enough to broadcast it."""
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def _salted(kept: DataFrame, other: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    if salt <= 1:
        return kept, other
    tag = F.pmod(_content(kept), F.lit(salt)).cast("int")
    tags = F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))
    return kept.withColumn("__salt", tag), other.withColumn("__salt", tags)


def lookup(
    df: DataFrame, table: DataFrame, on: str | Sequence[str], defaults: dict[str, object], order_by: Sequence[str] = ()
) -> DataFrame:
    """Add columns of a keyed table; a missing key gives the literal default.

    The table is first reduced to one row per key (the last in ``order_by``, or any), so a
    lookup never multiplies rows. Spark broadcasts it only if it is small enough.
    """
    keys = _listed(on)
    require_columns(table.columns, [*keys, *defaults], "table")
    slim = one_per_key(table.select(*[col(n) for n in dict.fromkeys([*keys, *defaults, *order_by])]), keys, order_by)
    slim = slim.select(*[col(k) for k in keys], *[col(n).alias(f"__v_{n}") for n in defaults])
    joined = df.join(slim, keys, "left")
    kept = [n for n in df.columns if n not in defaults]
    found = [F.coalesce(col(f"__v_{n}"), F.lit(v)).alias(n) for n, v in defaults.items()]
    return joined.select(*[col(n) for n in kept], *found)


def one_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), last: bool = True) -> DataFrame:
    if order_by:
        return ordering.keep_first(df, keys, order_by, last=last)
    return df.dropDuplicates(list(keys))


def _stacked(
    left: DataFrame, right: DataFrame, key: str, names: Sequence[Sequence[str]], order_by: Sequence[str]
) -> DataFrame:
    """``key, a, b``: one row per key of either frame with a struct per side, null if absent.

    The frames are stacked and grouped, so each is shuffled once, repeated keys are reduced
    before the shuffle, null is a key like any other, and no join meets a hot key. A repeated
    key keeps its last row in ``order_by``, or any one of them.
    """
    frames = []
    for frame, cells in ((left, names[0]), (right, names[1])):
        require_columns(frame.columns, [key, *cells, *order_by])
        place = F.struct(*[col(o) for o in order_by]) if order_by else F.lit(0)
        frames.append(frame.select(col(key).alias("key"), place.alias("at"), F.struct(*[col(n) for n in cells]).alias("row")))
    a, b = frames
    none = lambda other: F.lit(None).cast(other.schema["row"].dataType)
    both = a.select("key", "at", F.col("row").alias("a"), none(b).alias("b")).unionByName(
        b.select("key", "at", none(a).alias("a"), F.col("row").alias("b"))
    )

    def chosen(side: str) -> Column:
        if order_by:
            return F.max_by(side, F.when(F.col(side).isNotNull(), F.col("at")))
        return F.first(side, ignorenulls=True)

    return both.groupBy("key").agg(chosen("a").alias("a"), chosen("b").alias("b"))


def reconcile(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_value: str,
    right_value: str | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``key, left_value, right_value, origin`` with one row per key seen on either side.

    Origin is left_only, right_only, mismatch or matched. Keys should be unique on each side
    (``check_unique`` refuses repeats); a repeated key keeps its last row in ``order_by``, or
    any. The sides are stacked and grouped: one shuffle of rows already reduced per key.
    """
    right_value = right_value or left_value
    sides = []
    for frame, value, side, other in ((left, left_value, "a", "b"), (right, right_value, "b", "a")):
        require_columns(frame.columns, [key, value, *order_by])
        place = F.struct(*[col(o) for o in order_by]) if order_by else F.lit(0)
        sides.append(
            frame.select(
                col(key).alias("key"), col(value).alias(side), F.lit(True).alias(f"in_{side}"), place.alias("at"),
                F.lit(None).cast("boolean").alias(f"in_{other}"),
            )
        )
    stacked = sides[0].unionByName(sides[1], allowMissingColumns=True)
    kept = lambda side: F.max_by(side, F.when(F.col(f"in_{side}"), F.col("at"))) if order_by else F.first(side, ignorenulls=True)
    both = stacked.groupBy("key").agg(
        kept("a").alias("a"), kept("b").alias("b"), F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")
    )
    origin = (
        F.when(F.col("in_b").isNull(), "left_only")
        .when(F.col("in_a").isNull(), "right_only")
        .when(F.col("a").eqNullSafe(F.col("b")), "matched")
        .otherwise("mismatch")
    )
    return both.select(
        F.col("key").alias(key), F.col("a").alias("left_value"), F.col("b").alias("right_value"), origin.alias("origin")
    )


def compare(
    left: DataFrame, right: DataFrame, key: str, fields: Sequence[str] = (), order_by: Sequence[str] = ()
) -> DataFrame:
    """``key, status, diffs``: added, removed, changed or unchanged, with field changes.

    ``diffs`` is a list of ``field, before, after`` as text. Repeated keys keep one row, the
    last in ``order_by``.
    """
    names = list(fields) or [n for n in dict.fromkeys([*left.columns, *right.columns]) if n != key and n not in order_by]
    held = [[n for n in names if n in frame.columns] for frame in (left, right)]
    both = _stacked(left, right, key, held, order_by)
    cell = lambda side, n: F.col(side)[n] if n in held[side == "b"] else F.lit(None).cast("string")
    change = lambda n: F.when(
        ~cell("a", n).eqNullSafe(cell("b", n)),
        F.struct(F.lit(n).alias("field"), cell("a", n).cast("string").alias("before"), cell("b", n).cast("string").alias("after")),
    )
    changes = F.filter(F.array(*[change(n) for n in names]), lambda d: d.isNotNull())
    common = F.col("a").isNotNull() & F.col("b").isNotNull()
    status = (
        F.when(F.col("a").isNull(), "added")
        .when(F.col("b").isNull(), "removed")
        .when(F.array_size(changes) > 0, "changed")
        .otherwise("unchanged")
    )
    return both.select(F.col("key").alias(key), status.alias("status"), F.when(common, changes).alias("diffs"))


def concat(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Stack frames; the columns of all, repeated rows kept."""
    return align([first, *rest], "union") if rest else first


def dedupe(df: DataFrame, by: str | Sequence[str] | None = None, order_by: Sequence[str] = (), keep: str = "first") -> DataFrame:
    """One row per key, or per whole row without a key; null equals null.

    ``keep`` is first, last, or merge: with merge each column takes its latest non-null value.
    """
    if by is None:
        return df.dropDuplicates()
    keys = _listed(by)
    require_columns(df.columns, keys)
    if keep == "merge":
        place = F.struct(*[col(o) for o in order_by])
        rest = [n for n in df.columns if n not in keys]
        merged = df.groupBy(*[col(k) for k in keys]).agg(
            *[F.max_by(col(n), F.when(col(n).isNotNull(), place)).alias(n) for n in rest]
        )
        return merged.select(*[col(n) for n in df.columns])
    if keep not in ("first", "last"):
        raise RecordError("keep is first, last or merge")
    return one_per_key(df, keys, order_by, last=keep == "last")


def sort_by(df: DataFrame, by: str | Sequence[str], descending: bool = False, nulls: str = "records") -> DataFrame:
    """Order by columns in one direction.

    ``nulls='records'``: null first, and last when descending. ``nulls='last'``: last both ways.
    """
    keys = _listed(by)
    require_columns(df.columns, keys)
    if nulls == "last":
        order = [col(k).desc_nulls_last() if descending else col(k).asc_nulls_last() for k in keys]
    else:
        order = [col(k).desc_nulls_last() if descending else col(k).asc_nulls_first() for k in keys]
    return df.orderBy(*order)


def head(df: DataFrame, n: int = 10, order_by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """The first ``n`` rows; with an order Spark keeps ``n`` per task and merges those."""
    return (sort_by(df, order_by, descending) if order_by else df).limit(n)
