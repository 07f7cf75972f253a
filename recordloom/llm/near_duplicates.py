"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

Texts with one set of shingles form a class, and classes meet in the buckets of banded signatures.
A candidate pair compares its signatures batch by batch and is dropped as soon as the posterior
chance that its similarity reaches the threshold falls below the miss probability; what is left is
verified on the full shingle sets. In each bucket the members first meet its least one. Where that
leaves a bucket in several components, members of different components meet in tiles, which
give only the links that join components. Pairs inside a component are never made.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import Hashes, bit_filter, map_texts, passing, rolling, sliced
from recordloom.session import stage

#: Bands, rows of a band, and hashes of a comparison batch. At similarity 0.8 a pair shares no bucket once in 2e7.
BANDS, ROWS, BATCH = 32, 4, 32
HASHES = BANDS * ROWS
#: Probability at which a pair that reaches the threshold may be dropped by its signatures.
MISS = 1e-6
#: Members of a tile's side.
TILE = 256
#: Links in a file of a written round.
LINKS_PER_FILE = 500_000
BLOCK_CHARS = 3_000_000


def _words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def shingles(text: str | None, width: int) -> set:
    """The full set of a text: distinct runs of ``width`` words; one run if there are fewer."""
    words = _words(text or "")
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def _multipliers() -> np.ndarray:
    """Odd multipliers and offsets, one pair per hash, from a fixed rule."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 2**63, size=(2, HASHES), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _signatures(width: int):
    known = Hashes()
    factor, offset = _multipliers()

    def block(texts: list[str]) -> tuple[list[int], list[bytes | None], list[bytes | None]]:
        split = [_words(text) for text in texts]
        values = np.fromiter((known[w] for words in split for w in words), dtype=np.int64, count=sum(map(len, split)))
        sets, at = [], 0
        for words in split:
            own = values[at : at + len(words)]
            at += len(words)
            if len(own):
                sets.append(np.unique(rolling(own, min(width, len(own)))))
            else:
                sets.append(own)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        held = np.flatnonzero(sizes)
        keys: list[bytes | None] = [None] * len(texts)
        marks: list[bytes | None] = [None] * len(texts)
        if len(held):
            flat = np.concatenate([sets[i] for i in held]).astype(np.uint64)
            begin = np.append(0, np.cumsum(sizes[held])[:-1])
            table = np.empty((len(held), HASHES), dtype="<u2")
            for i in range(HASHES):
                mixed = flat * factor[i] + offset[i]
                least = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(29)), begin)
                table[:, i] = ((least ^ (least >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)
            sums = np.add.reduceat(flat, begin)
            crossed = np.add.reduceat(flat * (flat | np.uint64(1)) ^ (flat >> np.uint64(17)), begin)
            for j, i in enumerate(held.tolist()):
                marks[i] = table[j].tobytes()
                keys[i] = struct.pack("<QQI", int(sums[j]), int(crossed[j]), int(sizes[i]))
        return sizes.tolist(), keys, marks

    def make(texts: list[str]):
        sizes, keys, marks = [], [], []
        for part in sliced(texts, BLOCK_CHARS):
            for out, new in zip((sizes, keys, marks), block(part), strict=True):
                out += new
        return None, {"n_shingles": pa.array(sizes, pa.int64()), "set_key": pa.array(keys, pa.binary()), "signature": pa.array(marks, pa.binary())}

    return make


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For 1, 2, ... batches: the fewest equal hashes that leave a pair in.

    Under a uniform prior the similarity of m equal among n hashes is Beta(m + 1, n - m + 1), and
    its chance to reach t is that of at most m successes in n + 1 draws of chance t.
    """
    bounds = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        bounds.append(m)
    return bounds


def _surviving(a: np.ndarray, b: np.ndarray, bounds: list[int], names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (their ``names``, or places) whose signatures stay possible through all batches, and their equal hashes."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), dtype=np.int64)
    for i, bound in enumerate(bounds):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= bound]
        if not len(alive):
            break
    return alive if names is None else names[alive], equal[alive]


def _table(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), dtype="<u2").reshape(-1, HASHES)


def _possible(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that their signatures do not rule out."""
    bounds = least_matches(threshold)
    sided = pairs.join(classes.select(F.col("rep").alias("b"), F.col("signature").alias("of_b")), "b")
    sided = sided.join(classes.select(F.col("rep").alias("a"), F.col("signature").alias("of_a")), "a")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                kept, _ = _surviving(_table(batch.column(2).to_pylist()), _table(batch.column(3).to_pylist()), bounds)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(kept)) for c in batch.columns[:2]], names=["a", "b"])

    return sided.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _texts_of(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """Key and text of the documents in some pairs, and of few others.

    A filter of fixed size goes to the scan, so the texts of documents in no pair are not shuffled.
    """
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    shared = source.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("id").alias("hash")), "hash"))

    def run(batches):
        for batch in batches:
            inside = passing(shared.value, batch.column(2).to_numpy(zero_copy_only=False))
            yield batch.select(["rep", "text"]).filter(pa.array(inside))

    keyed = source.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return keyed.select(F.col("doc_id").alias("rep"), "text", F.xxhash64("doc_id").alias("hash")).mapInArrow(run, "rep bigint, text string")


def _linked(pairs: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap by ``percent`` hundredths of their union.

    The document of b goes to the pairs, these go to the document of a: a document that
    many pairs share is read by as many tasks as its pairs need.
    """
    texts = _texts_of(source, pairs)
    sided = pairs.select("a", "b").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("of_b")), "b")
    sided = sided.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("of_a")), "a")

    def run(batches):
        for batch in batches:
            last, known, kept = None, set(), []
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                for i, (a, of_a, of_b) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    if a != last or last is None:
                        last, known = a, shingles(of_a, width)
                    other = shingles(of_b, width)
                    same = len(known & other)
                    if same and 100 * same >= percent * (len(known) + len(other) - same):
                        kept.append(start + i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    return sided.select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node at most, and none that has others hangs on one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.filter("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Nodes and the least node of their component, from links (a, b); nodes without links are absent.

    Large and small stars in turn: every node hands its larger neighbours to its least one, then its
    smaller ones, until all hang on the least of their component. Each round is a written table of
    at most as many links.
    """
    turned = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    files = 1 + links.count() // LINKS_PER_FILE
    edges = stage(turned.distinct().coalesce(files), "links")
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        moved = large.join(low, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = stage(moved.unionByName(low.select("a", F.col("least").alias("b"))).distinct().coalesce(files), "stars")
    return edges.select(F.col("a").alias("rep"), F.col("b").alias("component"))


def _open_buckets(buckets: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, their least member aside.

    Each comes with its bucket's largest component and with the tiles that the bucket's members,
    and those outside that component, take.
    """
    larger = hubs.filter("members > 2").select("bucket", "hub")
    inside = buckets.join(larger, "bucket").filter("rep != hub").join(found, "rep", "left").select(
        "bucket", "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    inside = stage(inside, "inside")
    parts = inside.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    split = parts.groupBy("bucket").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("major"), F.count("*").alias("parts")
    ).filter("parts > 1").select(
        "bucket", F.col("major.component").alias("major"), F.ceil(F.col("all") / TILE).cast("int").alias("n_members"),
        F.ceil((F.col("all") - F.col("major.n")) / TILE).cast("int").alias("n_outer"),
    )
    return stage(inside.join(split, "bucket"), "open")


def _links_across(opened: DataFrame, classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between members of a bucket in different components, enough to join what is linked.

    The members outside a bucket's largest component meet all others, tile by tile; a pair that
    shares several buckets is compared in the first. Pairs that their signatures leave possible are
    verified on the spot, and a link between components that the tile has joined already is not
    looked for, so a tile gives fewer links than it has components.
    """
    bounds = least_matches(percent / 100)
    places = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, salt: F.pmod(F.xxhash64(F.col("rep"), F.lit(salt)), F.col(n)).cast("int")
    kept = ["bucket", "band", "rep", "component", (F.col("component") != F.col("major")).alias("minor")]
    members = opened.select(*kept, F.lit(False).alias("outer"), place("n_members", "m").alias("tile"), places("n_outer").alias("side"))
    outer = opened.filter("component != major").select(*kept, F.lit(True).alias("outer"), places("n_members").alias("tile"), place("n_outer", "o").alias("side"))
    texts = _texts_of(source, opened.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    bodies = stage(classes.select("rep", "signature").join(texts, "rep"), "bodies")
    tiled = members.unionByName(outer).join(bodies, "rep")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        outside = group["outer"].to_numpy(dtype=bool)
        o, m = group[outside].reset_index(drop=True), group[~outside].reset_index(drop=True)
        mine, theirs = _table(o["signature"]), _table(m["signature"])
        band, links = int(group["band"].iloc[0]), []
        reps, comps, minor = m["rep"].to_numpy(), m["component"].to_numpy(), m["minor"].to_numpy(dtype=bool)
        joined = {c: c for c in {*o["component"], *comps}}
        sets: dict[int, set] = {}

        def root(c: int) -> int:
            while joined[c] != c:
                c = joined[c]
            return c

        def body(table: pd.DataFrame, i: int) -> set:
            key = table["rep"][i]
            if key not in sets:
                sets[key] = shingles(table["text"][i], width)
            return sets[key]

        for i in range(len(o)):
            rep, comp = o["rep"][i], o["component"][i]
            # two outer members meet from both sides; the smaller one keeps the pair
            at = np.flatnonzero((comps != comp) & ((reps > rep) | ~minor))
            if not len(at):
                continue
            at, equal = _surviving(np.broadcast_to(mine[i], (len(at), HASHES)), theirs[at], bounds, at)
            if not len(at):
                continue
            shared = (theirs[at].reshape(len(at), BANDS, ROWS) == mine[i].reshape(BANDS, ROWS)).all(axis=2)
            first = shared.argmax(axis=1) == band
            for j in at[first][np.argsort(-equal[first], kind="stable")].tolist():
                x, y = root(comp), root(comps[j])
                if x == y:
                    continue
                a, b = body(o, i), body(m, j)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    continue
                same = len(a & b)
                if same and 100 * same >= percent * (len(a) + len(b) - same):
                    joined[max(x, y)] = min(x, y)
                    links.append((min(rep, reps[j]), max(rep, reps[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return tiled.groupBy("bucket", "tile", "side").applyInPandas(run, "a bigint, b bigint").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 2, percent: int = 80
) -> DataFrame:
    """The group of every document, one row per input row.

    ``n_shingles`` is the size of the text's set, ``component_id`` the least key reachable over links of
    at least ``percent`` hundredths similarity, ``kept`` whether that is the row's own key. Texts that
    are null or without words have no shingles and no links; repeated rows are one document and
    share its verdict; rows with a null key link nothing, have no component and are kept; empty
    tables give no rows; other columns are not read. Keys are whole numbers.
    """
    threshold = percent / 100
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stage(map_texts(source, ["doc_id"], "text", "n_shingles bigint, set_key binary, signature binary", _signatures(width)), "signatures")
    linked = rows.filter(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = stage(linked.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    buckets = classes.select("rep", bands.alias("band", "bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count("*").alias("members"))
    hubs = stage(hubs.filter("hub != last").select("bucket", "hub", "members"), "hubs")
    stars = buckets.join(hubs, "bucket").filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = stage(_possible(stars, classes, threshold), "stars")
    found = components(stage(_linked(stars, source, width, percent), "links"))

    opened = _open_buckets(buckets, hubs, found)
    if not opened.isEmpty():
        across = stage(_links_across(opened, classes, source, width, percent), "across")
        if not across.isEmpty():
            found = components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionByName(across))
    groups = stage(
        classes.select("set_key", "rep").join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id")), "groups"
    )
    joined = rows.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col(key).isNull() | (F.col(key) == F.col("component_id"))
    )
