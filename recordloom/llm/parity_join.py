"""N-gram Jaccard join on parity sketches.

Every shingle of a text flips one bit of a sketch, so the bits in which two sketches differ are never more
than the shingles in which two sets differ. Sets at the threshold differ in few shingles for their size:
in a band of sizes at most ``slack``. A sketch is cut into ``slack + agree`` words of 64 bits; two sketches
that differ in no more bits agree in ``agree`` words at least, and meet in the bucket of these words. A set
only posts as many of the first words as the sets it can be linked with may differ from it in. Texts
below the first band link only with equal sets. A set meets others of its own band, and the smaller ones of
the band above, where sets just beyond the border belong.

Texts of one set are one class. Members of a bucket first meet its least one; pairs whose sketches
differ in more bits than the pair's sizes allow go, the rest are verified on the full sets. Where a bucket still holds
several components, its members meet in tiles: first one path of possible links between components is
verified, then all possible links between components that are left.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import Hashes, bit_filter, map_texts, passing, rolling, sliced
from recordloom.llm.near_duplicates import _texts_of, components, shingles
from recordloom.session import stage

#: Growth of the sizes of a band.
GROWTH = 1.4
#: Words of a sketch that must agree, by the slack of the band; one beyond these.
AGREE = {1: 3, 2: 3, 3: 2, 4: 2}
#: Members of a tile's side at most, and bytes of their sketches.
TILE, TILE_BYTES = 256, 16_000_000
BLOCK_CHARS = 3_000_000


def difference(sizes: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Shingles in which two sets of so many elements together differ at most, if they are linked."""
    return sizes * (100 - percent) // (100 + percent)


@cache
def band_start(band: int, percent: int) -> int:
    """The least size of a band; sizes below band 0 allow no difference at all."""
    if band == 0:
        return next(n for n in itertools.count(1) if difference(2 * n, percent) > 0)
    return max(band_start(band - 1, percent) + 1, math.ceil(band_start(band - 1, percent) * max(GROWTH, 100 / percent)))


def bands_of(size: int, percent: int) -> list[int]:
    """The bands in which a set of this size is looked for: its own, and the next if a linked set may be there."""
    if percent >= 100:  # only equal sets are linked
        return []
    band = -1
    while band_start(band + 1, percent) <= size:
        band += 1
    own = [band] if band >= 0 else []
    return own + [band + 1] * (100 * size >= percent * band_start(band + 1, percent))


@cache
def shape(band: int, percent: int) -> tuple[int, int]:
    """Words of a sketch in this band, and how many of them agree."""
    slack = difference(2 * (band_start(band + 1, percent) - 1), percent)
    agree = AGREE.get(slack, 1)
    return slack + agree, agree


@cache
def choices(words: int, agree: int) -> np.ndarray:
    """Every choice of the words that agree."""
    return np.array(list(itertools.combinations(range(words), agree)), dtype=np.int64).reshape(-1, agree)


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """One bit flipped for every hash."""
    wide = hashes.astype(np.uint64)
    place = (wide % np.uint64(words)).astype(np.int64) * 64 + ((wide >> np.uint64(40)) & np.uint64(63)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=words * 64) & 1).astype(bool)).view(np.uint64)


def keys(words: np.ndarray, band: int, size: int, percent: int) -> np.ndarray:
    """The buckets of a sketch: hashes of every choice of as many words as a linked set differs in, and some more."""
    agree = shape(band, percent)[1]
    chosen = choices(min(len(words), difference(size + size * 100 // percent, percent) + agree), agree)
    mixed = np.full(len(chosen), np.uint64(band + 1))
    for i in range(agree):
        part = words[chosen[:, i]] ^ (chosen[:, i].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ part) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return mixed.view(np.int64)


def _sketches(width: int, percent: int):
    known = Hashes()

    def one(hashes: np.ndarray):
        if not len(hashes):
            return None, []
        sides = []
        for band in bands_of(len(hashes), percent):
            sides.append({"band": band, "words": sketch(hashes, shape(band, percent)[0]).tobytes()})
        return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), sides

    def make(texts: list[str]):
        sizes, sets, sides = [], [], []
        for part in sliced(texts, BLOCK_CHARS):
            for text in part:
                words = text.encode("utf-8", "replace").lower().split()
                values = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))
                hashes = np.unique(rolling(values, min(width, len(words)))) if words else values
                key, own = one(hashes)
                sizes.append(len(hashes))
                sets.append(key)
                sides.append(own)
        kind = pa.list_(pa.struct([("band", pa.int32()), ("words", pa.binary())]))
        return None, {"n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(sets, pa.binary()), "sides": pa.array(sides, kind)}

    return make


def _postings(sketches: DataFrame, percent: int, wanted: DataFrame | None = None) -> DataFrame:
    """Bucket, band and class of every choice of words; of few buckets but ``wanted`` ones, if these are given.

    A filter of fixed size goes to the tasks, so what meets nothing is not shuffled again.
    """
    bits = None if wanted is None else sketches.sparkSession.sparkContext.broadcast(bit_filter(wanted, "bucket"))

    def put(found: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        many = [len(f) for f, _, _ in found]
        bands, reps = (np.repeat(np.array([x[i] for x in found], dtype=np.int64), many) for i in (1, 2))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([f for f, _, _ in found])), pa.array(bands.astype(np.int32)), pa.array(reps)], names=["bucket", "band", "rep"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, many = [], 0
            for rep, band, size, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = keys(np.frombuffer(words, np.uint64), band, size, percent)
                found.append((own if bits is None else own[passing(bits.value, own)], band, rep))
                many += len(found[-1][0])
                if many > 200_000:
                    yield put(found)
                    found, many = [], 0
            if found:
                yield put(found)

    return sketches.select("rep", "band", "size", "words").mapInArrow(run, "bucket bigint, band int, rep bigint")


def differing(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits in which a sketch differs from each of others."""
    return np.bitwise_count(one ^ others).sum(axis=-1, dtype=np.int64)


def possible(size: np.ndarray, sizes: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes may be linked, if their sketches differ in so many bits."""
    return (bits <= difference(size + sizes, percent)) & (100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes))


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a band whose sketches there do not rule them out."""
    side = lambda of: sketches.select(F.col("rep").alias(of), "band", F.col("size").alias(f"size_{of}"), F.col("words").alias(f"words_{of}"))
    sided = pairs.join(side("b"), ["b", "band"]).join(side("a"), ["a", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("words_a", "words_b", "size_a", "size_b")), strict=True)):
                bits = differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                if possible(np.int64(n), np.int64(m), bits, percent):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return sided.select("a", "b", "words_a", "words_b", "size_a", "size_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _linked(pairs: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked.

    The text of b goes to the pairs, these go to the text of a, which is read once for its run of pairs.
    """
    texts = _texts_of(source, pairs)
    sided = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("of_b")), "b")
    sided = sided.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("of_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, set()
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a, of_a, of_b = (batch.column(c)[i].as_py() for c in ("a", "of_a", "of_b"))
                if (a, of_a) != last:
                    last, known = (a, of_a), shingles(of_a, width)
                other = shingles(of_b, width)
                same = len(known & other)
                if same and 100 * same >= percent * (len(known) + len(other) - same):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    return sided.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _open(members: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the bucket's largest one and its numbers of tiles."""
    inside = members.join(hubs.filter("members > 2").select("bucket", "band", "hub"), ["bucket", "band"]).filter("rep != hub").join(found, "rep", "left")
    inside = stage(inside.select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component")), "parity-inside")
    parts = inside.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("major"), F.count("*").alias("parts"))
    split = split.filter("parts > 1").select("bucket", "n", F.col("major.component").alias("major"), (F.col("n") - F.col("major.n")).alias("others"))
    return stage(inside.join(split, "bucket"), "parity-open")


def _across(opened: DataFrame, sketches: DataFrame, percent: int, every: bool) -> DataFrame:
    """Possible links (bucket, a, b) between members of a bucket in different components.

    Members outside the bucket's largest component meet all others, tile by tile. Unless ``every`` is asked for,
    a tile gives no more links than it takes to join what its possible links join.
    """
    sided = opened.join(sketches, ["rep", "band"])
    side = F.greatest(F.lit(1), F.least(F.lit(TILE), F.lit(TILE_BYTES) / F.greatest(F.octet_length("words"), F.lit(1)))).cast("int")
    sided = sided.withColumns({"rows": F.ceil(F.col("n") / side).cast("int"), "columns": F.ceil(F.col("others") / side).cast("int")})
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, salt: F.pmod(F.xxhash64(F.col("rep"), F.lit(salt)), F.col(n)).cast("int")
    kept = ["bucket", "band", "rep", "size", "words", "component", (F.col("component") != F.col("major")).alias("minor")]
    members = sided.select(*kept, F.lit(False).alias("outer"), place("rows", "m").alias("row"), places("columns").alias("column"))
    outer = sided.filter("component != major").select(*kept, F.lit(True).alias("outer"), places("rows").alias("row"), place("columns", "o").alias("column"))

    def links_in(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        """The links of one tile, from its rows (outer, rep, size, words, component, minor)."""
        o, m = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not o or not m:
            return
        table = np.frombuffer(b"".join(r[3] for r in m), np.uint64).reshape(len(m), -1)
        reps, sizes, comps, minor = (np.array([r[i] for r in m]) for i in (1, 2, 4, 5))
        joined = {r[4]: r[4] for r in rows}

        def root(c: int) -> int:
            while joined[c] != c:
                c = joined[c]
            return c

        for _, rep, size, words, comp, _ in o:
            # two outer members meet from both sides; the smaller one keeps the pair
            at = np.flatnonzero((comps != comp) & ((reps > rep) | ~minor))
            if not len(at):
                continue
            bits = differing(np.frombuffer(words, np.uint64), table[at])
            near = possible(np.int64(size), sizes[at], bits, percent)
            for j in at[near][np.argsort(bits[near], kind="stable")].tolist():
                x, y = root(comp), root(int(comps[j]))
                if every or x != y:
                    joined[max(x, y)] = min(x, y)
                    yield min(rep, int(reps[j])), max(rep, int(reps[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles follow one another in order; one is held at a time."""
        tile, held, found = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for here, row in zip(zip(*columns[:4], strict=True), zip(*columns[4:], strict=True), strict=True):
                if here != tile:
                    found += [(tile[0], *pair) for pair in links_in(held)]
                    tile, held = here, []
                    if len(found) > 100_000:
                        yield put(found)
                held.append(row)
        found += [(tile[0], *pair) for pair in links_in(held)]
        yield put(found)

    def put(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[]] * 3
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["bucket", "a", "b"])

    tile = ["bucket", "band", "row", "column"]
    tiled = members.unionByName(outer).repartition(*tile).sortWithinPartitions(*tile)
    return tiled.select(*tile, "outer", "rep", "size", "words", "component", "minor").mapInArrow(run, "bucket bigint, a bigint, b bigint")


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """Size of the set and component of every document, one row per input row.

    ``n_shingles`` is the size of the text's set, ``component_id`` the least key reachable over links of at
    least ``percent`` hundredths similarity. Texts that are null or without words have no shingles and no
    links, and are components of their own; repeated rows share their verdict; rows of one key with other texts
    are judged each for itself; rows with a null key link nothing and have no component; empty tables give no
    rows; other columns are not read. Keys are whole numbers.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "n_shingles bigint, set_key binary, sides array<struct<band: int, words: binary>>"
    rows = stage(map_texts(source, ["doc_id"], "text", schema, _sketches(width, percent)), "parity-sets")
    held = rows.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = held.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sides").alias("sides"))
    classes = stage(classes, "parity-classes")
    sketches = classes.select("rep", "size", F.explode("sides").alias("side")).select("rep", "size", "side.band", "side.words")

    members = _postings(sketches, percent)
    hubs = members.groupBy("bucket", "band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("members"))
    hubs = stage(hubs.filter("hub != last").select("bucket", "band", "hub", "members"), "parity-hubs")
    members = _postings(sketches, percent, hubs).join(hubs.select("bucket", "band"), ["bucket", "band"], "left_semi")
    members = stage(members, "parity-members")
    stars = members.join(hubs, ["bucket", "band"]).filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"), "band").distinct()
    tried = stage(_near(stars, sketches, percent), "parity-stars")
    links = stage(_linked(tried, source, width, percent), "parity-links")
    found = components(links)
    inside = members
    for every in (False, True):
        opened = _open(inside, hubs, found)
        if opened.isEmpty():
            break
        across = stage(_across(opened, sketches, percent, every), "parity-across")
        more = stage(across.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "parity-more")
        links = stage(_linked(more, source, width, percent), "parity-links").unionByName(links)
        found = components(links)
        # where all links of a bucket were true, its possible links join nothing else
        untrue = across.join(links, ["a", "b"], "left_anti").select("bucket").distinct()
        tried, inside = tried.unionByName(more), members.join(untrue, "bucket", "left_semi")
    groups = classes.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    shown = rows.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return shown.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"))
