"""The elements of large JSON lists, found by many tasks.

A file is cut behind closing braces, wherever these stand, and read in pieces. Every piece reports whether
it turns the string state round, and by how much it changes the depth if it begins outside a string
and if it begins inside one. Running sums of these over the pieces of a file tell the state each one begins in; a
second reading cuts the list at the commas of its own depth. Elements that cross a border are put
together from what the pieces hold of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.session import stage
from recordloom.sources.pieces import HEAD, MIDDLE, RECORD, TAIL, TOLD, runs_of, together, told

END = "}"
_QUOTE, _ESCAPE, _COMMA, _OPEN, _CLOSE = (ord(c) for c in '"\\,[]')


def structure(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, whether an odd number of quotes stands up to each, and the step of the depth at each.

    Quotes behind an odd run of backslashes do not count; steps count inside strings, too.
    """
    data = np.frombuffer(raw, np.uint8)
    quotes = data == _QUOTE
    back = np.flatnonzero(data == _ESCAPE)
    if len(back):
        first = np.append(True, np.diff(back) > 1)
        place = back - back[first][np.cumsum(first) - 1]
        behind = back[place % 2 == 0] + 1
        quotes[behind[behind < len(data)]] = False
    steps = np.isin(data, (_OPEN, ord("{"))).astype(np.int64) - np.isin(data, (_CLOSE, ord("}")))
    return data, np.cumsum(quotes) % 2 == 1, steps


def _raw(values: pa.Array) -> bytes:
    """The text of some parts, with the braces they were cut at."""
    return (END.join(values.to_pylist()) + END).encode("utf-8")


def piece_states(lines: DataFrame) -> DataFrame:
    """``file, start, inside, depth, opens`` of every piece: what it begins in, and the first sign of the file."""
    schema = "file string, start bigint, turns boolean, outside bigint, within bigint, opens string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, []

        def flushed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*found, strict=True)) or [[]] * 6
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n.split()[0] for n in schema.split(", ")])

        for batch in batches:
            for piece, _, values in runs_of(batch):
                if held is None or tuple(held[:2]) != piece:
                    if held is not None:
                        found.append(tuple(held))
                    held = [*piece, False, 0, 0, None]
                raw = _raw(values)
                _, odd, steps = structure(raw)
                odd = odd ^ held[2]
                held[3] += int(steps[~odd].sum())
                held[4] += int(steps[odd].sum())
                held[2] = bool(odd[-1])
                if piece[1] == 0 and held[5] is None:
                    held[5] = raw.decode("utf-8").lstrip("﻿ \t\r\n")[:1] or None
        if held is not None:
            found.append(tuple(held))
        yield flushed()

    ends = stage(lines.mapInArrow(run, schema), "json-pieces")
    earlier = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    strings = ends.withColumn("inside", before(F.col("turns").cast("int")) % 2 == 1)
    change = F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))
    return stage(strings.withColumn("depth", before(change)).select("file", "start", "inside", "depth", "opens"), "json-states")


def elements(lines: DataFrame, states: DataFrame) -> DataFrame:
    """``text`` of every element of the lists. What the pieces begin in is broadcast: a few bytes for each."""
    begin = states.filter("start > 0").select(F.xxhash64("file").alias("of"), "start", "inside", "depth").collect()
    known = lines.sparkSession.sparkContext.broadcast({(r.of, r.start): (r.inside, r.depth) for r in begin})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, inside, depth, seq = None, False, 0, 0
        whole = False  # whether the element at hand began in this piece
        parts: list[bytes] = []
        out: list[tuple] = []

        def put(kind: int) -> None:
            nonlocal seq
            text = b"".join(parts).decode("utf-8")
            parts.clear()
            if kind != RECORD or text.strip():
                out.append((*piece, seq, kind, text))
                seq += 1

        def ended() -> None:
            if depth > 0:
                put(TAIL if whole else MIDDLE)
            parts.clear()

        for batch in batches:
            marks = batch.column(3)
            for here, row, values in runs_of(batch):
                if here != piece:
                    if piece is not None:
                        ended()
                    inside, depth = known.value.get((marks[row].as_py(), here[1]), (False, 0))
                    piece, whole, seq = here, depth == 0, 0
                raw = _raw(values)
                data, odd, steps = structure(raw)
                odd = odd ^ inside
                depths = depth + np.cumsum(np.where(odd, 0, steps))
                cuts = ~odd & (((data == _COMMA) & (depths == 1)) | ((data == _OPEN) & (depths == 1)) | ((data == _CLOSE) & (depths == 0)))
                at = 0
                for cut in np.flatnonzero(cuts).tolist():
                    if data[cut] != _OPEN:
                        parts.append(raw[at:cut])
                        put(RECORD if whole else HEAD)
                    at, whole = cut + 1, True
                inside, depth = bool(odd[-1]), int(depths[-1])
                if depth > 0:
                    parts.append(raw[at:])
            if out:
                yield told(out)
        if piece is not None:
            ended()
            yield told(out)

    found = lines.withColumn("of", F.xxhash64("file")).mapInArrow(run, TOLD)
    return found.filter(F.col("kind") == RECORD).select("text").unionByName(together(found, "").select("text"))
