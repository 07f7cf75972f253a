"""Vector code compression: product codes trained and assigned on a lexicographic trie of distinct parts.

Vectors become whole numbers and are cut into equal parts. The distinct parts of every position, with
their counts, are laid out in lexicographic order, so parts that begin alike stand side by side. A
task walks its range as a trie, depth first: a node holds the distances that its leading dimensions
have gathered to all entries of the codebook, and hands them to its children, which add one dimension.
A leaf takes the least distance, and adds its part as often as it occurs to the sums of that entry.
Only the sums of entries, whose number the codebook bounds, leave the tasks of a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import stage

#: Parts of a vector, entries of a codebook, rounds of training, and steps of a component's unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Leaves of a subtree that is finished level by level in one table of distances.
LEAVES = 256
#: Bits of a limb of an exact sum, and the greatest whole number of a long.
LIMB, MOST = 32, 2**63 - 1


class Layout:
    """How components are stored and computed: exactly, in the least width that holds them.

    A component is stored as an unsigned number of fixed width, the greater byte first, so that the
    bytes of parts sort like their components.
    """

    def __init__(self, dimension: int, bound: int, rows: int):
        self.dimension = dimension
        self.components = dimension // PARTS
        bits = (bound + 1).bit_length() + 1
        self.width = 4 if bits <= 32 else 8 if bits <= 64 else (bits + 7) // 8
        farthest = (2 * (bound + 1)) ** 2
        self.kind = np.int32 if self.components * farthest < 2**31 else np.int64 if dimension * farthest <= MOST else object
        self.sums = np.int64 if (bound + 1) * (rows + 1) <= MOST else object
        self.limbs = ((bound + 1) * (rows + 1)).bit_length() // LIMB + 1

    def whole(self, values: np.ndarray) -> np.ndarray:
        """Components as whole numbers, rounded down."""
        if self.width <= 8:
            return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
        numbers = [float(x).as_integer_ratio() for x in values]
        return np.array([top * SCALE // below for top, below in numbers], dtype=object)

    def stored(self, numbers: np.ndarray) -> bytes:
        if self.width == 4:
            return (numbers + 2**31).astype(">u4").tobytes()
        if self.width == 8:
            return (numbers.astype(np.uint64) ^ np.uint64(2**63)).astype(">u8").tobytes()
        return b"".join((int(x) + (1 << 8 * self.width - 1)).to_bytes(self.width, "big") for x in numbers.tolist())

    def loaded(self, parts: list[bytes]) -> np.ndarray:
        """One row for each part."""
        shape, raw = (len(parts), self.components), b"".join(parts)
        if self.width == 4:
            numbers = np.frombuffer(raw, ">u4").astype(np.int64) - 2**31
        elif self.width == 8:
            numbers = (np.frombuffer(raw, ">u8").astype(np.uint64) ^ np.uint64(2**63)).astype(np.int64)
        else:
            half = 1 << 8 * self.width - 1
            numbers = np.array([int.from_bytes(raw[i : i + self.width], "big") - half for i in range(0, len(raw), self.width)], dtype=object)
        return numbers.astype(self.kind).reshape(shape)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct parts in lexicographic order: the least of the nearest entries, and the squared distance to it."""
    size, depth = parts.shape
    entry, error = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=parts.dtype)
    waiting = [(0, size, 0, np.zeros(len(book), dtype=parts.dtype))]
    while waiting:
        low, high, at, gathered = waiting.pop()
        if high - low <= LEAVES or at == depth:
            table = _finished(parts[low:high, at:], book[:, at:], gathered)
            entry[low:high] = table.argmin(axis=1)
            error[low:high] = table.min(axis=1)
            continue
        column = parts[low:high, at]
        cuts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        ends = np.append(cuts[1:], high - low)
        for i in range(len(cuts) - 1, -1, -1):  # the least child is taken next
            step = column[cuts[i]] - book[:, at]
            waiting.append((low + int(cuts[i]), low + int(ends[i]), at + 1, gathered + step * step))
    return entry, error


def _finished(parts: np.ndarray, book: np.ndarray, gathered: np.ndarray) -> np.ndarray:
    """Distances of all leaves of a small subtree: one row of the table for each prefix of the level."""
    table, node = gathered[None, :], np.zeros(len(parts), dtype=np.int64)
    opened = np.zeros(len(parts), dtype=bool)
    opened[:1] = True
    for at in range(parts.shape[1]):
        values = parts[:, at]
        opened[1:] |= values[1:] != values[:-1]
        firsts = np.flatnonzero(opened)
        step = values[firsts, None] - book[None, :, at]
        table = table[node[firsts]] + step * step
        node = np.cumsum(opened) - 1
    return table[node]


def _distinct(raw: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct parts in order, and the place of each part among them."""
    order = sorted(range(len(raw)), key=raw.__getitem__)
    kept: list[bytes] = []
    place = np.zeros(len(raw), dtype=np.int64)
    for i in order:
        if not kept or kept[-1] != raw[i]:
            kept.append(raw[i])
        place[i] = len(kept) - 1
    return kept, place


_NAMES = [f"part{i}" for i in range(PARTS)]


def _stored(kept: DataFrame, layout: Layout, kinds: dict[str, str]) -> DataFrame:
    """vec_id, label and the stored parts; null parts where the length is another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut: list[list[bytes | None]] = [[] for _ in _NAMES]
            for vector in batch.column(2):
                values = vector.values.to_numpy(zero_copy_only=False)
                whole = len(values) == layout.dimension and not layout.dimension % PARTS
                numbers = layout.whole(values) if whole else None
                for i, column in enumerate(cut):
                    column.append(layout.stored(numbers[i * layout.components : (i + 1) * layout.components]) if whole else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, pa.binary()) for c in cut]], names=["vec_id", "label", *_NAMES])

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, {', '.join(f'{n} binary' for n in _NAMES)}"
    return kept.select("vec_id", "label", "vector").mapInArrow(run, schema)


def _laid_out(rows: DataFrame) -> DataFrame:
    """Distinct parts of every position with their counts, in order; equal parts are counted before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(_NAMES):
                kept, place = _distinct([x for x in batch.column(name).to_pylist() if x is not None])
                counts = np.bincount(place, minlength=len(kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kept), i, dtype=np.int32)), pa.array(kept, pa.binary()), pa.array(counts, pa.int64())], names=["position", "part", "n"]
                )

    counted = rows.select(*_NAMES).mapInArrow(run, "position int, part binary, n bigint")
    ranged = counted.repartitionByRange("position", "part").groupBy("position", "part").agg(F.sum("n").alias("n"))
    return stage(ranged.sortWithinPartitions("position", "part"), "parts")


def _sums(parts: DataFrame, layout: Layout, books: list[list[list[int]]]) -> DataFrame:
    """Count and sums of the parts of every entry: the limbs of exact sums, by position, entry and component (-1: the count)."""
    limb = (1 << LIMB) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(b, dtype=layout.kind).reshape(len(b), layout.components) for b in books]
        total = [np.zeros((len(b), layout.components + 1), dtype=layout.sums) for b in books]
        for batch in batches:
            position = batch.column(0).to_numpy()
            for i in np.unique(position):
                here = np.flatnonzero(position == i)
                raw, n = batch.column(1).take(pa.array(here)).to_pylist(), batch.column(2).to_numpy()[here]
                order = sorted(range(len(raw)), key=raw.__getitem__)
                own, n = layout.loaded([raw[j] for j in order]), n[order].astype(layout.sums)
                entry, _ = nearest(own, tables[i])
                weighted = np.column_stack([n, own.astype(layout.sums) * n[:, None]])
                by = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(entry[by]) != 0))
                total[i][entry[by][starts]] += np.add.reduceat(weighted[by], starts, axis=0)
        found = []
        for i, table in enumerate(total):
            for entry in np.flatnonzero(table[:, 0] != 0).tolist():
                for at, value in enumerate(table[entry].tolist(), -1):
                    for k in range(layout.limbs):
                        found.append((i, entry, at, k, (value >> LIMB * k) & limb if k < layout.limbs - 1 else value >> LIMB * k))
        if found:
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32()] * 4 + [pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "at", "limb", "value"])

    found = parts.select("position", "part", "n").mapInArrow(run, "position int, entry int, at int, limb int, value bigint")
    return found.groupBy("position", "entry", "at", "limb").agg(F.sum("value").alias("value"))


def trained(rows: DataFrame, layout: Layout) -> list[list[list[int]]]:
    """The codebooks: seeded with the parts of the least keys, moved to the mean of their parts in every round."""
    named = rows.filter(F.col("vec_id").isNotNull() & F.col("part0").isNotNull())
    ids = named.select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES)
    seeds = named.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min(F.struct(*_NAMES)).alias("parts")).orderBy("vec_id").collect()
    books = [[[int(x) for x in row] for row in layout.loaded([bytes(r.parts[i]) for r in seeds])] for i in range(PARTS)]
    if not seeds:
        return books
    parts = _laid_out(rows)
    for _ in range(ROUNDS):
        exact: dict[tuple[int, int], dict[int, int]] = {}
        for r in _sums(parts, layout, books).collect():
            sums = exact.setdefault((r.position, r.entry), {})
            sums[r["at"]] = sums.get(r["at"], 0) + (r.value << LIMB * r.limb)
        for (position, entry), sums in exact.items():
            books[position][entry] = [sums[at] // sums[-1] for at in range(layout.components)]
    return books


def _assigned(rows: DataFrame, layout: Layout, books: list[list[list[int]]], kinds: dict[str, str]) -> DataFrame:
    """vec_id, label, code and error of every row; the parts of a batch are walked as one trie for each position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(b, dtype=layout.kind).reshape(len(b), layout.components) for b in books]
        for batch in batches:
            whole = np.flatnonzero(batch.column("part0").is_valid().to_numpy(zero_copy_only=False)) if books[0] else np.zeros(0, dtype=np.int64)
            codes, errors = np.zeros((len(whole), PARTS), dtype=np.int64), np.zeros(len(whole), dtype=object if layout.kind is object else np.int64)
            for i, name in enumerate(_NAMES):
                kept, place = _distinct(batch.column(name).take(pa.array(whole)).to_pylist())
                entry, error = nearest(layout.loaded(kept), tables[i]) if kept else (place, place)
                codes[:, i] = entry[place]
                errors += error[place]
            code: list[str | None] = [None] * batch.num_rows
            summed: list[int | None] = [None] * batch.num_rows
            for row, entries, error in zip(whole.tolist(), codes.tolist(), errors.tolist(), strict=True):
                code[row], summed[row] = "".join(f"{x:02x}" for x in entries), min(int(error), MOST)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(code, pa.string()), pa.array(summed, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def encoded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The code of every vector, its squared error, that of its label, and the digest of all codebooks.

    Vectors that are null or hold a null or non-finite component are dropped. All others must have the length
    of the one with the least key, a multiple of four; those that do not are given with a null code and error, and count
    nowhere. Rows with a null key are coded, but seed no entry; a key that occurs again seeds its least vector. Null
    labels are one label; a label whose vectors have no error has 0. Numbers are exact at any size; errors beyond a long are
    given as the greatest long. Other columns are not read; empty tables give no rows.
    """
    source = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kept = source.filter(F.col("vector").isNotNull() & F.forall("vector", _finite))
    kinds = dict(source.dtypes)
    greatest = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    least = F.min(F.when(F.col("vec_id").isNotNull(), F.struct("vec_id", F.size("vector").alias("size"))))
    seen = kept.agg(least["size"].alias("size"), F.max(greatest).alias("greatest"), F.count("*").alias("rows")).first()
    top, below = float(seen.greatest or 0.0).as_integer_ratio()
    layout = Layout(seen["size"] or 0, top * SCALE // below + 1, seen.rows)
    rows = stage(_stored(kept, layout, kinds), "vectors")
    books = trained(rows, layout)
    coded = stage(_assigned(rows, layout, books, kinds), "codes")
    said = ",".join(str(x) for book in books for entry in book for x in entry)
    total = F.least(F.sum(F.coalesce("error", F.lit(0)).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256")
    )
