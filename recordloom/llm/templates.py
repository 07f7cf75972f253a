"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, other words are
lower-cased. Windows of template tokens meet in a hash join; along each alignment of a document
with an item, the values behind equal slots must map one to one, so a question with other
numbers or names is still found, and a chance meeting of placeholders is not. Beside its template,
every window is hashed word for word, whatever the case: verbatim windows always count.
"""

from __future__ import annotations

import re
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import bit_filter, hash64, map_texts, passing, rolling, sliced
from recordloom.session import stage

#: Tokens in a window, literal tokens it needs (all, if it is shorter), share of an item's windows that convicts.
WINDOW, LITERALS, COVERAGE = 8, 3, 0.5
#: Characters whose windows are hashed together, and bytes of text a task takes at a time.
BLOCK_CHARS, PART_BYTES = 500_000, 2_000_000

NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[%$€£]")
#: An odd factor, so that literals are hashed otherwise in templates than word for word.
_FACTOR = 0x9E3779B97F4A7C15

# Units of measure, and words that are no names although a sentence begins with them.
UNITS = frozenset(
    "% $ € £ mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres "
    "kilometer kilometers mg g kg oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ml l litre litres liter "
    "liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent kmh mph degree degrees".split()
)
NO_NAMES = frozenset(
    "a an the what who whom whose which when where why how if is are was were do does did can could will would should may might "
    "in on at of for from to by with and or but so then there this that these those each every all some find solve compute "
    "calculate let given suppose after before it he she they we you i".split()
)


#: Hashes of the placeholders, none negative.
_SLOTS = {form: hash64(form) & (2**62 - 1) for form in (NUMBER, NAME, UNIT)}


def canonical(token: str) -> str:
    """The template token of a token: a placeholder, or the lower-cased word."""
    if token[0].isdigit():
        return NUMBER
    low = token.lower()
    if low in UNITS:
        return UNIT
    if token[0] != low[0] and token[1:] == low[1:] and low not in NO_NAMES:
        return NAME
    return low


class _Tokens(dict):
    """A number for each token a task meets, under which ``codes`` and ``plain`` hold its hashes.

    ``codes`` has the hash of the template token, negative for literals, so that one look tells both;
    ``plain`` that of the token as it is, whatever its case.
    """

    BOUND = 300_000

    def __init__(self) -> None:
        self.codes, self.plain = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.codes):
            self.codes, self.plain = np.resize(self.codes, 2 * at), np.resize(self.plain, 2 * at)
        form = canonical(token)
        plain = hash64(token.lower())
        self.codes[at] = _SLOTS[form] if form in _SLOTS else (plain * _FACTOR & (2**62 - 1)) - 2**63
        self.plain[at] = plain
        self[token] = at
        return at

    def numbers(self, tokens: list[str]) -> np.ndarray:
        for token in list(islice(self, self.BOUND, None)):  # frequent tokens come early and stay
            del self[token]
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def _windows(lengths: tuple[int, ...], bits: np.ndarray | None, known: _Tokens):
    """Row, position, hash, size, slot values and kind of all windows of a batch that pass the filter.

    A window is hashed as a template, if it has the literal tokens for that, and word for word
    (``plain``, without slot values); ``bound`` tells whether it has both.
    """

    def block(texts: list[str], first: int):
        tokens = [_TOKEN.findall(text) for text in texts]
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = list(chain.from_iterable(tokens))
        numbers = known.numbers(flat)
        codes, plain = known.codes[numbers], known.plain[numbers]
        row = np.repeat(np.arange(len(texts)), sizes)
        begin = np.cumsum(sizes) - sizes
        literal = np.append(0, np.cumsum(codes < 0))
        for length in lengths:
            if len(codes) < length:
                continue
            last = length - 1
            whole = row[: len(codes) - last] == row[last:]
            bound = literal[length:] - literal[:-length] >= min(LITERALS, length)
            for values, fits, word_for_word in ((codes, whole & bound, False), (plain, whole, True)):
                hashed = rolling(values, length)
                at = np.flatnonzero(fits)
                if bits is not None:
                    at = at[passing(bits, hashed[at])]
                for i in at.tolist():
                    slots = [] if word_for_word else [flat[j] for j in range(i, i + length) if codes[j] >= 0]
                    yield first + int(row[i]), i - int(begin[row[i]]), int(hashed[i]), int(sizes[row[i]]), slots, word_for_word, bool(bound[i])

    def make(texts: list[str]):
        rows, at, hashed, size, slots, plain, bound, first = [], [], [], [], [], [], [], 0
        for part in sliced(texts, BLOCK_CHARS):
            for r, p, h, n, s, w, b in block(part, first):
                rows.append(r), at.append(p), hashed.append(h), size.append(n), slots.append(s), plain.append(w), bound.append(b)
            first += len(part)
        return rows, {
            "at": pa.array(at, pa.int32()), "window": pa.array(hashed, pa.int64()), "size": pa.array(size, pa.int32()),
            "slots": pa.array(slots, pa.list_(pa.string())), "plain": pa.array(plain, pa.bool_()), "bound": pa.array(bound, pa.bool_()),
        }

    return make


_SCHEMA = "at int, window bigint, size int, slots array<string>, plain boolean, bound boolean"


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of all items; an item shorter than a window has one of its own length.

    ``n_windows`` counts the places of an item, ``n_bound`` those that have a template.
    """
    found = map_texts(benchmark, [item], text, _SCHEMA + ", length int", _of_items)
    found = found.filter(F.col(item).isNotNull()).dropDuplicates([item, "at", "window", "plain"])
    counts = found.groupBy(item).agg(F.countDistinct("at").alias("n_windows"), F.count_distinct(F.when(F.col("bound"), F.col("at"))).alias("n_bound"))
    return found.join(counts, item)


def _of_items(texts: list[str]):
    rows, made, known = [], {k: [] for k in ("at", "window", "size", "slots", "plain", "bound", "length")}, _Tokens()
    for i, text in enumerate(texts):
        n = min(len(_TOKEN.findall(text)), WINDOW)
        if not n:
            continue
        own, found = _windows((n,), None, known)([text])
        rows += [i] * len(own)
        for k in found:
            made[k] += found[k].to_pylist()
        made["length"] += [n] * len(own)
    kinds = {
        "at": pa.int32(), "window": pa.int64(), "size": pa.int32(), "slots": pa.list_(pa.string()), "plain": pa.bool_(), "bound": pa.bool_(),
        "length": pa.int32(),
    }
    return rows, {k: pa.array(v, kinds[k]) for k, v in made.items()}


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """Pairs of documents and items whose windows meet: one row per pair.

    ``n_windows`` of the item, ``n_covered`` of them met along consistent alignments or word for
    word, their ratio ``coverage`` (at least the parameter), and ``exact``: whether all slots hold
    the item's own values. The share is taken of the windows that have a template and of all
    windows, which differ where numbers, names and units prevail, and the greater one stands.
    Repeated rows count once; rows of one key are one document, also those of a null key; null
    and empty texts meet nothing; an item without ``LITERALS`` literal words is found word for word only; items
    with a null id are left out; empty tables give no rows; other columns are not read.
    """
    wanted = stage(item_windows(benchmark.select(F.col(item).alias("item_id"), F.col(item_text).alias("__text")), "item_id", "__text"), "items")
    lengths = tuple(sorted(r[0] for r in wanted.select("length").distinct().collect()))
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "window"))
    tokens = _Tokens()  # each task gets its own, empty
    hits = map_texts(docs, [key], text, _SCHEMA, lambda texts: _windows(lengths, shared.value, tokens)(texts), PART_BYTES)
    pairs = hits.select(F.col(key), "window", "plain", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots")).join(
        wanted.select("item_id", "window", "plain", "at", "slots", "bound", "n_windows", "n_bound"), ["window", "plain"]
    )
    same = F.transform(F.arrays_zip(F.col("slots").alias("a"), F.col("doc_slots").alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    place = F.struct("at", "bound")
    aligned = pairs.groupBy(key, "item_id", "n_windows", "n_bound", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(same))).alias("held"), F.collect_set(place).alias("met"),
        F.collect_set(F.when(F.col("plain"), place)).alias("verbatim"),
    )
    one_to_one = (F.size("held") == F.size(F.array_distinct("held.a"))) & (F.size("held") == F.size(F.array_distinct("held.b")))
    own = F.size(F.filter("held", lambda x: x["a"] != x["b"])) == 0
    counted = aligned.withColumn("met", F.when(one_to_one, F.col("met")).otherwise(F.col("verbatim"))).filter(F.size("met") > 0)
    found = counted.groupBy(key, "item_id", "n_windows", "n_bound").agg(
        F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"), F.bool_and(~one_to_one | own).alias("exact")
    )
    shares = F.array(*[
        F.struct((n / of).alias("coverage"), of.alias("n_windows"), n.cast("long").alias("n_covered"))
        for n, of in ((F.size("met"), F.col("n_windows")), (F.size(F.filter("met", lambda x: x["bound"])), F.when(F.col("n_bound") > 0, F.col("n_bound"))))
    ])
    found = found.select(key, "item_id", "exact", F.array_max(F.filter(shares, lambda x: x["coverage"].isNotNull())).alias("share"))
    found = found.filter(F.col("share.coverage") >= coverage)
    return found.select(key, "item_id", "share.n_windows", "share.n_covered", "share.coverage", "exact")
