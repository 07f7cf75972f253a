"""Row maps and bounded loops."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.errors import RecordError
from recordloom.operators import ordering
from recordloom.operators.schema import col
from recordloom.session import stage

MAX_ITERATIONS = 1000


def map_rows(
    df: DataFrame,
    new: dict[str, Column],
    keep: Sequence[str] | None = None,
    index: str | None = None,
    order_by: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """The same expressions for every row: a projection.

    ``index`` adds the zero-based place of the row in ``order_by``, which expressions may use.
    """
    if index is not None:
        if not order_by:
            raise RecordError("an index needs order_by")
        df = ordering.number_rows(df, order_by, index, start=0, unique=unique)
    mapped = df.withColumns(new)
    if keep is None:
        return mapped
    return mapped.select(*[col(n) for n in dict.fromkeys([*keep, *([index] if index else []), *new])])


def entries(df: DataFrame, map_column: str, keep: Sequence[str] = ()) -> DataFrame:
    """An object as rows of ``key, value``."""
    return df.select(*[col(k) for k in keep], F.explode(col(map_column)).alias("key", "value"))


def iterate(
    df: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    until: Callable[[DataFrame], bool],
    max_iterations: int = MAX_ITERATIONS,
    cut_every: int = 1,
    check_first: bool = False,
) -> DataFrame:
    """Apply ``step`` until ``until`` holds for its result; reaching the limit is an error.

    Every ``cut_every`` passes the result is written to the shared folder, so the plan stays
    short and a lost executor does not replay the whole loop. ``check_first`` tests before
    the first pass as well.
    """
    current = df
    if check_first and until(current):
        return current
    for turn in range(1, max_iterations + 1):
        current = step(current)
        if turn % cut_every == 0:
            current = stage(current, "iterate")
        if until(current):
            return current
    raise RecordError(f"the loop did not end within {max_iterations} iterations")
