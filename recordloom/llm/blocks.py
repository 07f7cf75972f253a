"""Small helpers the Python operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash64(text: str | bytes) -> int:
    """64 bits of a text, as a signed integer."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


class Hashes(dict):
    """Remembers the hash of each word a task meets, up to a bound."""

    BOUND = 300_000

    def __missing__(self, word: str | bytes) -> int:
        found = hash64(word)
        if len(self) < self.BOUND:
            self[word] = found
        return found


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of so many values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    wide = values.astype(np.uint64)
    wide ^= wide >> np.uint64(31)
    total = np.full(n, np.uint64(length))
    for i in range(length):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += wide[i : i + n]
    total ^= total >> np.uint64(32)
    return total.astype(np.int64)


def sliced(texts: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive texts in lists of about so many characters."""
    at = 0
    while at < len(texts):
        size, stop = 0, at
        while stop < len(texts) and (size < chars or stop == at):
            size += len(texts[stop])
            stop += 1
        yield texts[at:stop]
        at = stop


def parts(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch; a part ends with the text that reaches so many bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, stop - start)


#: Address bits of a membership filter. Its size depends on nothing else; the fuller it is, the more it lets through.
FILTER_BITS = 24


def bit_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the leading bits of every hash; OR-ed in Spark, at most 2^``bits`` bits reach the driver."""
    spot = F.shiftrightunsigned(column, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (spot % 32).cast("int"))
    words = hashes.select(F.shiftright(spot, 5).alias("word"), bit.alias("bit"))
    held = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    packed = np.zeros(1 << (bits - 5), dtype="<u4")
    packed[held["word"].to_numpy()] = held["bits"].to_numpy().astype(np.uint32)
    return packed.view(np.uint8)


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter; none of them is missed."""
    spot = hashes.astype(np.uint64) >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def kept_schema(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def map_texts(
    df: DataFrame, keep: list[str], text: str, schema: str, make: Callable[[list[str]], tuple[list[int] | None, dict[str, pa.Array]]],
    size: int | None = None,
) -> DataFrame:
    """Columns ``keep`` and what ``make`` returns for the texts of a batch; null texts are empty.

    ``make`` returns the row each output row belongs to (None: one for each) and the new columns.
    It gets the texts of a whole batch, or of parts of about ``size`` bytes, so that a worker's memory goes by these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in (parts(whole, len(keep), size) if size else [whole])):
            rows, made = make([x or "" for x in batch.column(len(keep)).to_pylist()])
            kept = batch.columns[: len(keep)]
            if rows is not None:
                kept = [column.take(pa.array(rows, pa.int64())) for column in kept]
            yield pa.RecordBatch.from_arrays([*kept, *made.values()], names=[*keep, *made])

    return df.select(*keep, text).mapInArrow(run, f"{kept_schema(df, keep)}, {schema}")


#: Elements of a list that are folded at a time. A fold copies what it has built at every step, so its length is kept short.
FOLD = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """What ``join`` makes of 0 and all values before each one; values are whole numbers, none null.

    Folds short blocks, then the totals of blocks, so a list of 100 000 values costs about 400 folds
    of 256 steps and one of 400.
    """
    zero = F.lit(0).cast("long")

    def fold(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))

        def step(seen: Column, x: Column) -> Column:
            return F.struct(join(seen["at"], x).alias("at"), F.concat(seen["out"], F.array(seen["at"])).alias("out"))

        return F.aggregate(part, start, step, lambda seen: seen["out"])

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda at, x: join(at, x)))
        return F.flatten(F.zip_with(blocks, fold(totals, zero), fold))

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(FOLD))
    return let(F.transform(starts, lambda i: F.slice(values, i, F.lit(FOLD))), over)


#: Four bytes a code point, and the mark that such texts may begin with, which reading takes away once.
WIDE, _MARK = "UTF-32", bytearray(b"\x00\x00\xfe\xff")


def without(text: Column, spans: Column, mask: str = "") -> Column:
    """The text with spans (start, stop; code points, by start) replaced by ``mask``.

    What lies between the spans is joined; overlapping ones are one. The text is cut in its form of
    four bytes a code point, where a place is found without walking there, so the cost is that of
    the text and the spans, not their product; a text with spans may have 500 million code points.
    """

    def piece(wide: Column, at: Column, size: Column) -> Column:
        return F.decode(F.concat(F.lit(_MARK), F.substring(wide, (4 * at + 1).cast("int"), (4 * size).cast("int"))), WIDE)

    def joined(wide: Column, of: Column, stops: Column) -> Column:
        def before(x: Column, at: Column) -> Column:
            return F.when(x["start"] >= at, F.concat(piece(wide, at, x["start"] - at), F.lit(mask))).otherwise(F.lit(""))

        gaps = F.zip_with(of, running(stops, F.greatest), before)
        last = F.array_max(stops)
        return F.concat(F.array_join(gaps, ""), piece(wide, last, F.length(text) - last))

    def cut(of: Column) -> Column:
        stops = F.transform(of, lambda x: x["stop"].cast("long"))
        return let(F.encode(text, WIDE), lambda wide: let(stops, lambda held: joined(wide, of, held)))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(spans, cut))
