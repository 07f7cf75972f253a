"""Substring dedup by sliding sentence spans.

Texts are cut into sentences, and from every one the shortest run of at least ``RUN`` sentences and
``LEAST_WORDS`` words is hashed. The hashes alone are counted across the corpus. A filter of the repeated ones
picks the places that may be repeated, and only these meet: the first place of a
repeated span stands, and the sentences of all others go.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import Hashes, bit_filter, hash64, kept_schema, map_texts, passing, without
from recordloom.session import stage

#: Least sentences and words of a span; a run of short sentences grows until it has the words.
RUN, LEAST_WORDS = 3, 12
#: Sentences of more words than ``LONG`` are cut behind the least of every ``WINDOW`` consecutive
#: places by the checksum of the ``GRAM`` words that end there, so pieces have at most ``WINDOW``
#: words and the same passage is cut alike in any surroundings. Within a passage of 51 words cuts
#: are the same from its 8th word on, a piece begins by its 14th and three have at most 36 words.
LONG, WINDOW, GRAM = 12, 6, 3

#: Address bits of the filter of repeated spans: 4 MB of bits, whatever their number.
FILTER_BITS = 25

#: Bytes of text that are cut into spans together.
PART_BYTES = 2_000_000

#: An odd factor and its inverse modulo 2^64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)

_BREAK = re.compile(r"[.!?]+\s+|\s*\n\s*")
#: Which code points are white space; the last entry stands for all beyond, of which none is.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


class _Words(dict):
    """Hash of each word a task meets, whatever its case."""

    def __missing__(self, word: str) -> int:
        found = hash64(word.lower())
        if len(self) < Hashes.BOUND:
            self[word] = found
        return found


def _marks(codes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Checksum of the ``GRAM`` words that end at each place, of fewer where the sentence begins later."""
    marks = codes.astype(np.uint64)
    for back in range(1, min(GRAM, len(codes))):
        marks *= np.uint64(_FACTOR)
        marks[back:] += np.where(sentence[back:] == sentence[:-back], codes[:-back], 0).astype(np.uint64)
    return marks ^ (marks >> np.uint64(32))


def _cuts(codes: np.ndarray, sentence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the words behind which long sentences are cut: the last least one of every window."""
    last = WINDOW - 1
    if len(codes) <= last:
        return np.zeros(0, dtype=np.int64)
    marks = _marks(codes, sentence)
    windows = np.flatnonzero((sentence[:-last] == sentence[last:]) & (sizes[:-last] > LONG))
    least, at = marks[windows], windows
    for k in range(1, WINDOW):
        other = marks[windows + k]
        at = np.where(other <= least, windows + k, at)
        least = np.minimum(other, least)
    least = np.unique(at)
    if not ((marks[least[1:]] == marks[least[:-1]]) & (sentence[least[1:]] == sentence[least[:-1]])).any():
        return least
    cuts, seen, alike = [], None, 0  # of equal ones in reach of each other, as in a text of one repeated word, the farthest
    for cut, *mark in zip(least.tolist(), marks[least].tolist(), sentence[least].tolist(), strict=True):
        alike, seen = alike + 1 if mark == seen else 0, mark
        if alike > 1 and cut <= cuts[-2] + WINDOW:
            cuts[-1] = cut
        else:
            cuts.append(cut)
            alike = min(alike, 1)
    return np.array(cuts, dtype=np.int64)


def _cut(text: str, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sentences with a word as rows of start, stop and number of words, and the hashes of all words."""
    said = text.split()
    if not said:
        return np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    solid = np.concatenate(([False], ~_SPACES[np.minimum(points, len(_SPACES) - 1)], [False]))
    words = np.flatnonzero(solid[1:] != solid[:-1]).reshape(-1, 2)  # where words begin and end
    codes = np.fromiter((known[w] for w in said), dtype=np.int64, count=len(said))
    stops = np.array([*(m.end() for m in _BREAK.finditer(text)), len(text)])
    sentence = np.searchsorted(stops, words[:, 0], side="right")
    sizes = np.bincount(sentence, minlength=len(stops))[sentence]
    final = np.append(sentence[1:] != sentence[:-1], True)
    ends = np.union1d(_cuts(codes, sentence, sizes), np.flatnonzero(final))
    stop = np.where(final[ends], stops[sentence[ends]], words[ends, 1])
    first = np.append(0, ends[:-1] + 1)
    begins = np.append(True, final[ends[:-1]])
    start = np.where(begins, np.append(0, stops)[sentence[first]], np.append(0, stop[:-1]))
    return np.stack([start, stop, np.diff(np.append(-1, ends))], axis=1), codes


def sentences(text: str) -> list[tuple[int, int, int]]:
    """Sentences with a word, as start, stop and number of words; together they hold every word."""
    return [tuple(row) for row in _cut(text, _Words())[0].tolist()]


def _runs(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Order-sensitive hashes of the words from start to stop."""
    powers = lambda by: np.cumprod(np.append(np.uint64(1), np.full(len(codes), np.uint64(by))))
    sums = np.append(np.uint64(0), np.cumsum(codes.astype(np.uint64) * powers(_FACTOR)[:-1]))
    total = (sums[stop] - sums[start]) * powers(_INVERSE)[start]
    return (total ^ (total >> np.uint64(32))).astype(np.int64)


def _spans(texts: list[str], known: dict[str, int] | None = None):
    rows, spans, starts, stops = [], [], [], []
    known = _Words() if known is None else known
    for i, text in enumerate(texts):
        places, codes = _cut(text, known)
        if len(places) < RUN:
            continue
        before = np.append(0, np.cumsum(places[:, 2]))
        ends = np.maximum(np.searchsorted(before, before[:-1] + LEAST_WORDS), np.arange(len(places)) + RUN)
        at = np.flatnonzero(ends <= len(places))
        rows.append(np.full(len(at), i))
        spans.append(_runs(codes, before[at], before[ends[at]]))
        starts.append(places[at, 0])
        stops.append(places[ends[at] - 1, 1])
    joined = {n: np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for n, x in (("row", rows), ("span", spans), ("start", starts), ("stop", stops))}
    return joined["row"].tolist(), {
        "span": pa.array(joined["span"].astype(np.int64)),
        "start": pa.array(joined["start"].astype(np.int32)), "stop": pa.array(joined["stop"].astype(np.int32)),
    }


def _listed(texts: list[str], known: dict[str, int]):
    """The spans of each text as lists: one row per text."""
    rows, made = _spans(texts, known)
    offsets = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=len(texts)))), pa.int32())
    lists = {f"{n}s": pa.ListArray.from_arrays(offsets, made[n]) for n in ("span", "start", "stop")}
    return None, {"version": pa.array([zlib.crc32(t.encode("utf-8", "replace")) - 2**31 for t in texts], pa.int32()), **lists}


def _counted(spans: DataFrame) -> DataFrame:
    """Every span that occurs more than once; a batch sends each of its hashes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["span", "n"])

    counts = spans.select("spans").mapInArrow(run, "span bigint, n bigint").groupBy("span").agg(F.sum("n").alias("n"))
    return stage(counts.filter("n > 1").select("span"), "repeated")


def _places(spans: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Key, version, span, start and stop of the places whose span passes a filter of the wanted ones."""
    bits = spans.sparkSession.sparkContext.broadcast(bit_filter(wanted, "span", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            kept = pa.array(np.flatnonzero(passing(bits.value, lists.flatten().to_numpy(zero_copy_only=False))))
            own = [c.take(pa.array(row).take(kept)) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*own, *[c.flatten().take(kept) for c in batch.columns[2:]]], names=[key, "version", "span", "start", "stop"])

    schema = f"{kept_schema(spans, [key])}, version int, span bigint, start int, stop int"
    return spans.select(key, "version", "spans", "starts", "stops").mapInArrow(run, schema)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What later places of repeated spans cover, one row per text that loses something.

    Columns: the key, ``version`` (checksum of the text, to tell texts of one key apart),
    ``removed`` (ranges start, stop in code points, merged, by start), ``n_spans`` and ``first_in``
    (keys that hold the first places, sorted). The first place is the least by key, checksum and
    position, so rows alike in key and text share it and keep it. Rows with a null key come
    first; null and empty texts and texts of fewer than ``RUN`` sentences or ``LEAST_WORDS`` words have no spans.
    """
    schema = "version int, spans array<bigint>, starts array<int>, stops array<int>"
    words = _Words()  # each task gets its own, empty
    spans = stage(map_texts(docs, [key], text, schema, lambda texts: _listed(texts, words), PART_BYTES), "spans")
    wanted = _counted(spans)
    places = stage(_places(spans, key, wanted).join(wanted, "span", "left_semi"), "places")
    place = F.struct(F.col(key).alias("key"), "version", "start")
    known = places.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    known = stage(known.filter(F.col("first") != F.col("last")).select("span", "first"), "firsts")  # as a table, so that Spark splits the hot spans of the join
    later = places.join(known, "span").filter(~place.eqNullSafe(F.col("first")))
    per_text = later.groupBy(key, "version").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("__spans"), F.array_sort(F.collect_set("first.key")).alias("first_in")
    )
    return per_text.select(key, "version", merged(F.col("__spans")).alias("removed"), F.size("__spans").cast("long").alias("n_spans"), "first_in")


def merged(spans: Column) -> Column:
    """Sorted ranges with those that overlap or touch made one."""

    def step(seen: Column, x: Column) -> Column:
        last = F.try_element_at(seen, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        kept = F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))
        return F.when(F.size(seen).eqNullSafe(0) | (x["start"] > last["stop"]), F.concat(seen, F.array(x))).otherwise(F.concat(kept, F.array(joined)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,stop:int>>"), step)


def removed_from(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without what ``repeated`` found; rows with a null key are left as they are."""
    taken = {c.lower() for c in docs.columns}
    mark = next(m for m in ("__", *(f"__{i}_" for i in range(len(taken) + 1))) if not any(c.startswith(m) for c in taken))
    own = F.when(F.col(text).isNotNull(), (F.crc32(text) - F.lit(2**31)).cast("int"))
    cut = found.select(F.col(key).alias(f"{mark}key"), F.col("version").alias(f"{mark}found"), F.col("removed").alias(f"{mark}removed"))
    same = (F.col(key) == F.col(f"{mark}key")) & (F.col(f"{mark}version") == F.col(f"{mark}found"))
    keyed = docs.withColumn(f"{mark}version", own).join(cut, same, "left")
    return keyed.withColumn(text, without(F.col(text), F.col(f"{mark}removed"))).select(*docs.columns)
