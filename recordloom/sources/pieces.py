"""Files read in pieces: the runs of rows that belong to one piece, and what crosses the borders of pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What a piece holds of a record: all of it, its end, its beginning, or a part from its middle.
RECORD, HEAD, TAIL, MIDDLE = range(4)
TOLD = "file string, start bigint, seq bigint, kind int, text string"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())


def lines_of(spark: SparkSession, paths: Sequence[str], end: str = "\n") -> DataFrame:
    """``value, file, start``: the files cut at ``end``, with the piece each part is read in."""
    told = [F.col(f"_metadata.{n}").alias(as_) for n, as_ in (("file_path", "file"), ("file_block_start", "start"))]
    return spark.read.option("lineSep", end).text(list(paths)).select("value", *told)


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, pa.Array]]:
    """Piece, first row and values of every run of rows of one piece; columns value, file, start come first."""
    file, start = batch.column(1), batch.column(2).to_numpy()
    other = np.flatnonzero(start[1:] != start[:-1]) + 1
    if batch.num_rows > 1:
        changed = pc.not_equal(file.slice(1), file.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        other = np.union1d(other, np.flatnonzero(changed) + 1)
    cuts = [0, *other.tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield (file[a].as_py(), int(start[a])), a, batch.column(0).slice(a, b - a)


def told(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of (file, start, seq, kind, text); the list is emptied."""
    columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
    made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[n.split()[0] for n in TOLD.split(", ")])
    rows.clear()
    return made


def together(parts: DataFrame, joint: str) -> DataFrame:
    """``file, text`` of records that cross borders, each put together from its parts in order."""
    of = F.sum((F.col("kind") == TAIL).cast("int")).over(W.partitionBy("file").orderBy("start", "seq"))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("start", "seq", "text")))["text"], joint)
    crossing = parts.filter(F.col("kind") != RECORD).withColumn("of", of)
    return crossing.groupBy("file", "of").agg(joined.alias("text")).select("file", "text")
