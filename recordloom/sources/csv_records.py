"""CSV records of files that are read in pieces, where a quoted cell may hold line ends.

A piece of a file begins at a line, but the line may lie inside a quoted cell. Each piece therefore
reports how it ends if it begins outside such a cell and if it begins inside one; a running
composition of these over the pieces of a file settles where each one begins. Then all pieces are read on
their own; only records that cross a border are put together from what the pieces hold of them.
"""

from __future__ import annotations

import csv
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.errors import RecordError
from recordloom.session import stage
from recordloom.sources.pieces import HEAD, MIDDLE, RECORD, TAIL, TOLD, runs_of, together, told

#: From inside a quoted cell up to the quote that ends it; doubled quotes do not.
_CLOSED = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open behind the line. A quote opens a cell only where the cell begins."""
    at = 0
    if inside:
        close = _CLOSED.match(line)
        at = line.find(sep, close.end()) + len(sep) if close else -1
        if close is None:
            return True
        if at < len(sep):
            return False
    while True:
        if not line.startswith('"', at):
            at = line.find(sep + '"', at) + len(sep)
            if at < len(sep):
                return False
        close = _CLOSED.match(line, at + 1)
        if close is None:
            return True
        at = line.find(sep, close.end()) + len(sep)
        if at < len(sep):
            return False


def piece_ends(lines: DataFrame, sep: str) -> DataFrame:
    """``file, start, outside, inside, broken, header, torn`` of every piece that holds a quote or begins a file.

    ``outside`` and ``inside``: whether a cell is open at the end if the piece began so. ``broken``: whether
    some line ends in an open cell if it began outside. ``header``: the first record of a file, ``torn`` if it goes on.
    """
    schema = "file string, start bigint, outside boolean, inside boolean, broken boolean, header string, torn boolean"
    names = [n.split()[0] for n in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, []

        def put() -> None:
            if held is not None:
                piece, states, broken, header, torn = held
                found.append([*piece, *states, broken, "\n".join(header) if header else None, torn])

        def flushed() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
            found.clear()
            return made

        begun, open_cell = False, False  # whether the header of the piece at hand is complete, or ends in an open cell
        for batch in batches:
            for piece, _, values in runs_of(batch):
                if held is None or held[0] != piece:
                    put()
                    held, begun, open_cell = [piece, [False, True], False, [], False], piece[1] != 0, False
                quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
                if not begun:
                    for line in values.to_pylist():
                        if held[3] or line.strip():
                            held[3].append(line)
                            open_cell = ends_inside(line, open_cell, sep)
                            begun = not open_cell
                            if begun:
                                break
                for line in values.take(pa.array(np.flatnonzero(quoted))).to_pylist():
                    held[1] = [ends_inside(line, state, sep) for state in held[1]]
                    held[2] = held[2] or held[1][0]
                held[4] = not begun and bool(held[3])
            if len(found) > 1000:
                yield flushed()
        put()
        if found:
            yield flushed()

    wanted = (F.col("start") == 0) | F.contains("value", F.lit('"'))
    return lines.filter(wanted).mapInArrow(run, schema)


def _turns(ends: DataFrame) -> DataFrame:
    """The pieces behind which a cell is open where none was before, or the other way round; ``now`` tells which.

    A piece keeps the state, sets it or turns it round. The state before a piece is what the last one
    that sets it has set, turned as often as pieces since then turn it.
    """
    order = W.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    sets = F.col("outside") == F.col("inside")
    marked = ends.withColumn("turned", F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = lambda c: F.last(F.when(sets, c), ignorenulls=True).over(earlier)
    before = F.coalesce(last(F.col("outside")), F.lit(False)) != (
        (F.coalesce(F.last("turned").over(earlier), F.lit(0)) - F.coalesce(last(F.col("turned")), F.lit(0))) % 2 == 1
    )
    stated = marked.withColumn("before", before).withColumn("now", F.when(F.col("before"), F.col("inside")).otherwise(F.col("outside")))
    return stated.withColumn("across", F.col("before") | F.col("broken"))


class Layout:
    """What one pass over the lines tells: the headers, whether any cell holds a line end, and where pieces begin inside one."""

    def __init__(self, lines: DataFrame, sep: str):
        ends = stage(piece_ends(lines, sep), "csv-pieces")
        if not ends.filter("torn").isEmpty():
            raise RecordError("a CSV header goes on beyond the first piece of its file")
        self.headers = ends.filter("header is not null").select("file", "header")
        kinds = self.headers.groupBy("header").agg(F.min("file").alias("first")).orderBy("first").collect()
        self.kinds: list[str] = [r.header for r in kinds]
        stated = stage(_turns(ends), "csv-states")
        self.across = not stated.filter("across").isEmpty()
        turns = stated.filter(F.col("now") != F.col("before")).select(F.xxhash64("file").alias("of"), "start", "now").orderBy("of", "start").collect()
        self.turns: dict[int, tuple[list[int], list[bool]]] = {}
        for r in turns:
            starts, states = self.turns.setdefault(r.of, ([], []))
            starts.append(r.start)
            states.append(r.now)


def begins_inside(turns: dict[int, tuple[list[int], list[bool]]], of: int, start: int) -> bool:
    """Whether a piece begins inside a cell: as the last turn before it left things."""
    starts, states = turns.get(of, ((), ()))
    at = bisect_left(starts, start) - 1
    return at >= 0 and states[at]


def records(lines: DataFrame, layout: Layout, sep: str) -> DataFrame:
    """``file, text``: every record but the headers and blank lines; line ends inside cells are kept as they are.

    What the pieces begin with is broadcast: a few bytes for each piece whose border a record crosses.
    """
    known = lines.sparkSession.sparkContext.broadcast(layout.turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, inside, begun, open_lines, seq, kind = None, False, True, [], 0, RECORD
        out: list[tuple] = []

        def put(what: int, text: str) -> None:
            nonlocal begun, seq
            if what in (RECORD, TAIL) and not begun and text.strip():
                begun = True  # the header
                return
            if what != RECORD or text.strip():
                out.append((*piece, seq, what, text.removesuffix("\r") if what in (RECORD, HEAD) else text))
                seq += 1

        def ended() -> None:
            if open_lines:
                put(MIDDLE if kind == HEAD else TAIL, "\n".join(open_lines))
                open_lines.clear()

        for batch in batches:
            marks = batch.column(3).to_pylist()
            for here, at, values in runs_of(batch):
                if here != piece:
                    ended()
                    piece, inside, begun, seq = here, begins_inside(known.value, marks[at], here[1]), here[1] != 0, 0
                    kind = HEAD if inside else RECORD
                quoted = pc.match_substring(values, '"').to_numpy(zero_copy_only=False).tolist()
                for line, marked in zip(values.to_pylist(), quoted, strict=True):
                    if marked:
                        inside = ends_inside(line, inside, sep)
                    if inside or open_lines:
                        open_lines.append(line)
                    if not inside:
                        put(kind, "\n".join(open_lines) if open_lines else line)
                        open_lines.clear()
                        kind = RECORD
            if out:
                yield told(out)
        if piece is not None:
            ended()
            yield told(out)

    found = lines.withColumn("of", F.xxhash64("file")).mapInArrow(run, TOLD)
    whole = found.filter(F.col("kind") == RECORD).select("file", "text")
    return whole.unionByName(together(found, "\n")) if layout.across else whole


def names_of(header: str, sep: str) -> list[str]:
    """The column names of a header: empty ones by place, repeated ones with their place behind."""
    cells = next(csv.reader([header.removesuffix("\r")], delimiter=sep, doublequote=True, strict=False), [])
    if "\n" in header:
        cells = next(csv.reader(header.removesuffix("\r").splitlines(keepends=True), delimiter=sep, doublequote=True))
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def parsed(lines: DataFrame, layout: Layout, sep: str, schema: str | None = None, part: str | None = None) -> DataFrame:
    """The cells of all records as text, by name; with a ``schema`` by place and typed.

    Headers may differ: each file's header is joined to its records, and a name is read from
    its place under that header, null where the header lacks it. ``part`` names a column for the file.
    """
    of = [F.col("file").alias(part)] if part else []
    options = {"sep": sep, "quote": '"', "escape": '"'}
    found = records(lines, layout, sep)
    if schema is not None:
        return found.select("file", F.from_csv("text", schema, options).alias("row")).select("row.*", *of)
    named = [names_of(h, sep) for h in layout.kinds]
    width = max(len(n) for n in named)
    cells = F.from_csv("text", ", ".join(f"_{i} string" for i in range(width)), options)
    if len(named) == 1:
        return found.select("file", cells.alias("row")).select(*[F.col(f"row._{i}").alias(n) for i, n in enumerate(named[0])], *of)
    spark = lines.sparkSession
    kinds = spark.createDataFrame(list(enumerate(layout.kinds)), "kind int, header string")
    by_file = layout.headers.join(kinds, "header").select("file", "kind")
    rows = found.join(by_file, "file").select("file", "kind", cells.alias("row"))
    rows = rows.select("file", "kind", F.array(*[F.col(f"row._{i}") for i in range(width)]).alias("cells"))
    columns = list(dict.fromkeys(n for names in named for n in names))
    places = lambda n: F.array(*[F.lit(names.index(n) if n in names else -1) for names in named])
    cell = lambda n: F.get(F.col("cells"), F.nullif(F.get(places(n), F.col("kind")), F.lit(-1)))
    return rows.select(*[cell(n).alias(n) for n in columns], *of)
