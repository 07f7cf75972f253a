"""Order-dependent operators without a one-task sort.

Rows are range-partitioned by their order and written once to the shared folder with their
chunk (partition) and place in it. Work inside a chunk is a window over that chunk; what
crosses chunks is a table of at most two rows per chunk, so a single hot key is spread over
many tasks and nothing collects a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from recordloom.errors import RecordError, require_columns
from recordloom.operators.schema import col
from recordloom.session import stage

CHUNK, PLACE, ARRIVAL = "__chunk", "__place", "__arrival"
_MARKS = (CHUNK, PLACE, ARRIVAL)
_PLACE_MASK = (1 << 33) - 1
HALO_ROWS = 100_000
#: Parts a key is dealt over before its first rows meet.
TOP_PARTS = 64


def _directed(names: Sequence[str], descending: bool | Sequence[str]) -> list[Column]:
    down = set(names) if descending is True else set(descending or ())
    return [col(n).desc() if n in down else col(n).asc() for n in names]


#: Bytes of one chunk, by the size estimate of the plan.
CHUNK_BYTES = 256 << 20


def _chunks(df: DataFrame) -> int:
    """Chunks for a frame: the session's shuffle partitions, or more where the inputs' sizes ask for them.

    The sizes of the plan's leaves are added up; a leaf of unknown size counts for nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(size for size in sizes if size < 1 << 55)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // CHUNK_BYTES))


def _bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table of a few rows per chunk, if no column of it can be wide.

    With texts or nested values among the keys the choice is left to Spark's size estimates.
    """
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)
    return F.broadcast(df) if all(isinstance(f.dataType, fixed) for f in df.schema.fields) else df


def sequence_rows(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    descending: bool | Sequence[str] = False,
    unique: bool = False,
) -> DataFrame:
    """Rows laid out by (keys, order) with ``__chunk`` and ``__place``.

    With ``unique`` the keys and order identify a row. Otherwise ties keep their arrival
    order: arrival numbers are fixed by a first write, which also lets a third of all rows
    be equal, since the number spreads them over chunks.
    """
    require_columns(df.columns, [*keys, *order_by])
    if not unique:
        df = stage(df.withColumn(ARRIVAL, F.monotonically_increasing_id()), "arrival")
    layout = [col(k).asc() for k in keys] + _directed(order_by, descending)
    if not unique:
        layout.append(F.col(ARRIVAL).asc())
    placed = (
        df.repartitionByRange(_chunks(df), *layout)
        .sortWithinPartitions(*layout)
        .withColumn(CHUNK, F.spark_partition_id())
        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK)))
    )
    return stage(placed, "sequence")


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[f"`{name}`"].eqNullSafe(right[f"`__k_{name}`"])
    return condition


def spanning_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of keys that may span chunks; all rows when there is no key.

    A key that goes on from an earlier chunk is always the first of the next, so reading the rows at
    place 0 is enough; Parquet skips everything else. Of these keys, at most one per chunk, the hashes
    are sent to all tasks: the rows are not shuffled by key, whatever share of them a key holds and
    however wide it is. Another key of the same hash is taken along, which costs its rows and changes nothing.
    """
    if not keys:
        return rows
    hashed = F.xxhash64(*[col(k) for k in keys])
    spanning = rows.filter(F.col(PLACE) == 0).select(hashed.alias("__k_hash")).distinct()
    return rows.join(F.broadcast(spanning), hashed == F.col("__k_hash"), "left_semi")


def carry(
    rows: DataFrame, keys: Sequence[str], parts: dict[str, tuple[Callable[[Column], Column], Column]]
) -> DataFrame:
    """For every key and chunk, each aggregate over the same key in earlier chunks.

    ``parts`` maps a name to an aggregate that can be applied to its own results (sum, max,
    min) and the value it reads. At most two rows per chunk, so it is safe to broadcast.
    """
    partial = spanning_rows(rows, keys).groupBy(*[col(k) for k in keys], CHUNK).agg(
        *[how(value).alias(f"__c_{name}") for name, (how, value) in parts.items()]
    )
    before = W.partitionBy(*[col(k) for k in keys]).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return partial.select(
        *[col(k).alias(f"__k_{k}") for k in keys],
        F.col(CHUNK).alias(f"__k_{CHUNK}"),
        *[how(F.col(f"__c_{name}")).over(before).alias(f"__c_{name}") for name, (how, _) in parts.items()],
    )


def with_carry(
    rows: DataFrame, keys: Sequence[str], parts: dict[str, tuple[Callable[[Column], Column], Column]],
    source: DataFrame | None = None,
) -> DataFrame:
    """``rows`` with columns ``__c_name`` of ``carry``; null where nothing came before.

    ``source`` may give the spanning rows with the same columns, when those are cheaper to make.
    """
    before = carry(rows if source is None else source, keys, parts)
    joined = rows.join(_bounded(before), _same(rows, before, [*keys, CHUNK]), "left")
    return joined.drop(*[f"__k_{k}" for k in [*keys, CHUNK]])


def running(
    rows: DataFrame,
    keys: Sequence[str],
    column: str,
    how: Callable[[Column], Column],
    value: Column,
    combine: Callable[[Column, Column], Column],
    inclusive: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """A running aggregate over sequenced rows: inside the chunk, then what was carried in."""
    frame = W.partitionBy(*[col(k) for k in keys], F.col(CHUNK)).orderBy(PLACE)
    frame = frame.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    carried = with_carry(rows, keys, {column: (how, value)}, source)
    inside, before = how(value).over(frame), F.col(f"__c_{column}")
    return carried.withColumn(column, combine(inside, before)).drop(f"__c_{column}")


def running_sum(rows: DataFrame, keys: Sequence[str], column: str, value: Column, inclusive: bool = True) -> DataFrame:
    both = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return running(rows, keys, column, F.sum, value, both, inclusive)


def running_max(
    rows: DataFrame, keys: Sequence[str], column: str, value: Column, inclusive: bool = True, source: DataFrame | None = None
) -> DataFrame:
    return running(rows, keys, column, F.max, value, F.greatest, inclusive, source)


def plain(df: DataFrame) -> DataFrame:
    """Without the layout columns."""
    return df.drop(*_MARKS)


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    column: str = "row_number",
    start: int = 1,
    descending: bool | Sequence[str] = False,
    unique: bool = False,
) -> DataFrame:
    """A dense row number over the whole frame, in order."""
    rows = sequence_rows(df, [], order_by, descending, unique)
    return plain(_numbered(rows, column, start))


def _numbered(rows: DataFrame, column: str, start: int) -> DataFrame:
    """Place plus the rows in earlier chunks; the offset table has one row per chunk."""
    sizes = rows.groupBy(CHUNK).agg(F.count("*").alias("n"))
    before = W.orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    return (
        rows.join(_bounded(offsets), CHUNK)
        .withColumn(column, F.col("__offset") + F.col(PLACE) + F.lit(start))
        .drop("__offset")
    )


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    column: str = "row_number",
    descending: bool | Sequence[str] = False,
    unique: bool = False,
) -> DataFrame:
    """A dense row number per key; a hot key is numbered by many tasks."""
    rows = sequence_rows(df, keys, order_by, descending, unique)
    return plain(running_sum(rows, keys, column, F.lit(1)))


def drop_rows(df: DataFrame, n: int, order_by: Sequence[str], descending: bool = False, unique: bool = False) -> DataFrame:
    """All rows after the first ``n``, which are found by counting."""
    from recordloom.operators import ranking

    return ranking.behind(df, order_by, n, descending, unique)


def sample(df: DataFrame, n: int, order_by: Sequence[str], unique: bool = False) -> DataFrame:
    """``n`` rows evenly spaced through the order, both ends included; ties by arrival.

    The order columns alone are laid out and numbered. What they hold at the wanted places is joined
    back to the rows, and only rows that tie with a wanted one are numbered again.
    """
    if n <= 0:
        return df.limit(0)
    total = df.count()
    if total <= n:
        return df
    stride = (total - 1) / (n - 1) if n > 1 else 0
    wanted = sorted({round(i * stride) for i in range(n)})
    names = list(dict.fromkeys(order_by))
    rows = _numbered(sequence_rows(df.select(*[col(c) for c in names]), [], names, unique=True), "__n", 0)
    places = rows.sparkSession.createDataFrame([(i,) for i in wanted], "__n long")
    picked = rows.join(places, "__n", "left_semi").select("__n", *[col(c).alias(f"__k_{c}") for c in names])
    if unique:
        return df.join(picked.drop("__n"), _same(df, picked, names), "left_semi")
    held = picked.select(*[F.col(f"`__k_{c}`") for c in names]).distinct()
    firsts = rows.join(held, _same(rows, held, names)).groupBy(*[F.col(f"`__k_{c}`") for c in names]).agg(F.min("__n").alias("__first"))
    marked = [F.col(f"`__k_{c}`").alias(f"__w_{c}") for c in names]
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"`__k_{c}`").eqNullSafe(F.col(f"`__w_{c}`"))
    offsets = picked.select("__n", *marked).join(firsts, same).select(*marked, (F.col("__n") - F.col("__first") + 1).alias("__turn"))
    tied = number_within(df.join(held, _same(df, held, names), "left_semi"), names, names, "__n")
    here = F.col("__n") == F.col("__turn")
    for c in names:
        here = here & col(c).eqNullSafe(F.col(f"`__w_{c}`"))
    return tied.join(offsets, here, "left_semi").drop("__n")


def keep_first(df: DataFrame, by: Sequence[str], order_by: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row per key, reduced on the map side before any shuffle."""
    require_columns(df.columns, [*by, *order_by])
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in by]
    chosen = df.groupBy(*[col(k) for k in by]).agg(
        pick(F.struct(*[col(c) for c in rest] or [F.lit(1)]), F.struct(*[col(o) for o in order_by])).alias("__row")
    )
    return chosen.select(*[col(c) if c in by else F.col("__row")[c].alias(c) for c in df.columns])


def top_k(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str], k: int, descending: bool | Sequence[str] = True
) -> DataFrame:
    """The first ``k`` rows per key in order, with their ``rank``; ties by arrival.

    A key is dealt over ``TOP_PARTS`` parts. Each task cuts a part to ``k`` rows before the shuffle,
    each part is cut again, and at most ``k`` rows of each part meet in the end.
    """
    if k < 1:
        raise RecordError("top_k needs k of at least 1")
    keys, order = [col(b) for b in by], [*_directed(order_by, descending), F.col(ARRIVAL).asc()]
    rows = df.withColumn(ARRIVAL, F.monotonically_increasing_id())
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(ARRIVAL), F.lit(TOP_PARTS)))
    rank = lambda window: F.row_number().over(window.orderBy(*order))
    cut = rows.withColumn("rank", rank(W.partitionBy(*keys, "__part"))).filter(F.col("rank") <= k)
    cut = cut.withColumn("rank", rank(W.partitionBy(*keys))).filter(F.col("rank") <= k)
    return cut.drop(ARRIVAL, "__part").withColumn("rank", F.col("rank").cast("long"))


def trailing(
    df: DataFrame,
    order_by: Sequence[str],
    width: int,
    new: dict[str, Callable[[Callable[[Column], Column]], Column]],
    unique: bool = False,
    index: str = "__n",
    halo_rows: int = HALO_ROWS,
) -> DataFrame:
    """Columns over a trailing window of ``width`` rows of the whole frame.

    The order is cut into blocks of ``halo_rows``; each block also receives the last
    ``width - 1`` rows of the block before, so blocks are windowed independently. ``new``
    maps a name to a function that receives ``over``, which binds an aggregate to the window.
    """
    if halo_rows < width:
        raise RecordError("blocks must be at least as long as the window")
    numbered = number_rows(df, order_by, index, start=0, unique=unique)
    block = F.floor(F.col(index) / halo_rows)
    copies = F.when(
        F.col(index) % halo_rows >= halo_rows - (width - 1), F.array(block, block + 1)
    ).otherwise(F.array(block))
    spread = numbered.withColumn("__home", block).withColumn("__block", F.explode(copies))
    window = W.partitionBy("__block").orderBy(index).rowsBetween(-(width - 1), 0)
    over = lambda aggregate: aggregate.over(window)
    done = spread.withColumns({name: build(over) for name, build in new.items()})
    return done.filter("__block = __home").drop("__block", "__home")
