"""Language identification by multilingual mixtures.

Every word gets a likelihood under each language from letter trigrams. Expectation maximisation
over a document's words gives the proportions of the languages in it; sets of one, two, … languages
are compared by their likelihood less a penalty per language, and the best set stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import kept_schema, sliced

#: Trigrams are counted in so many buckets; a model has one row of them per language.
BUCKETS = 1 << 16
#: About so many rows of a language, those with the least hash of the key, fit its trigrams.
TRAINING_ROWS = 5_000
#: Rounds of expectation maximisation, the largest set of languages, characters worked on at once.
ROUNDS, MOST, BLOCK_CHARS = 12, 4, 2_000_000
#: Smoothing count per bucket; a word that fits no language is worth that much to each.
ALPHA, FLOOR = 0.1, 1e-12

UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letters, where words start among them, and the text of each word."""
    lowered = [text.lower() for text in texts]
    sizes = np.fromiter((len(x) + 1 for x in lowered), dtype=np.int64, count=len(lowered))
    codes = np.frombuffer(("\x00" + "\x00".join(lowered) + "\x00").encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = _letters()[codes]
    c = np.where(is_letter, codes, 0).astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    buckets = (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS
    inner = is_letter[1:-1]
    starts = inner & ~is_letter[:-2]
    at = np.flatnonzero(inner)
    first = np.flatnonzero(starts[at])
    owner = np.searchsorted(np.cumsum(sizes), at[first], side="right")
    return buckets[at], first, owner


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, how often each bucket occurs in this task's rows."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        rows = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()})
        for lang, own in rows.groupby("lang"):
            counted = totals.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            counted += np.bincount(_words(own["text"].tolist())[0], minlength=BUCKETS)
    for lang, counted in totals.items():
        held = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(held)), pa.array(held), pa.array(counted[held])], names=["lang", "bucket", "n"]
        )


class Model:
    """Languages and the log probability of each bucket under each of them."""

    def __init__(self, languages: list[str], log: np.ndarray) -> None:
        self.languages, self.log = languages, log

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> Model:
        languages = sorted(set(counts["lang"]))
        place = {lang: i for i, lang in enumerate(languages)}
        table = np.full((len(place), BUCKETS), ALPHA)
        at = (counts["lang"].map(place).to_numpy(dtype=int), counts["bucket"].to_numpy(dtype=int))
        np.add.at(table, at, counts["n"].to_numpy(dtype=float))
        return cls(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: its words that have a letter, and the proportions of the chosen languages."""
        n, k = len(texts), len(self.languages)
        buckets, first, owner = _words(texts)
        words = np.bincount(owner, minlength=n)
        shares = np.zeros((n, k))
        if not k or not len(owner):
            return words, shares
        loglik = np.stack([np.add.reduceat(row[buckets], first) for row in self.log])
        likely = np.exp(loglik - loglik.max(axis=0)) + np.float32(FLOOR)
        held = np.flatnonzero(words)
        shares[held] = _chosen(likely, words[held]).T
        return words, shares


def _expect(likely: np.ndarray, sizes: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions per text after ``ROUNDS`` from ``share``, where 0 stays 0, and their log likelihood."""
    begin = np.append(0, np.cumsum(sizes)[:-1])
    row = np.repeat(np.arange(len(sizes)), sizes)
    for _ in range(ROUNDS if (np.count_nonzero(share, axis=0) > 1).any() else 0):
        part = likely * share[:, row]
        part /= part.sum(axis=0)
        share = (np.add.reduceat(part, begin, axis=1) / sizes).astype(np.float32)
    fit = np.log((likely * share[:, row]).sum(axis=0))
    return share, np.add.reduceat(fit, begin, dtype=np.float64)


def _chosen(likely: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions of the best set of languages per text.

    The sets are the largest one, two, ... languages of the mixture of all; a language that
    accounts for less than half a word there is in none but the first.
    """
    k, n = len(likely), len(sizes)
    full, _ = _expect(likely, sizes, np.full((k, n), 1.0 / k, dtype=np.float32))
    order = np.argsort(-full, axis=0, kind="stable")
    begin = np.append(0, np.cumsum(sizes)[:-1])
    best = np.zeros((k, n), dtype=np.float32)
    np.put_along_axis(best, order[:1], 1.0, axis=0)
    _, score = _expect(likely, sizes, best)
    score -= 0.5 * np.log(sizes + 1)
    open_ = np.arange(n)
    for size in range(2, min(k, MOST) + 1):
        open_ = open_[full[order[size - 1, open_], open_] * sizes[open_] >= 0.5]
        if not len(open_):
            break
        own = sizes[open_]
        at = np.arange(own.sum()) + np.repeat(begin[open_] - np.append(0, np.cumsum(own)[:-1]), own)
        start = np.zeros((k, len(open_)), dtype=np.float32)
        np.put_along_axis(start, order[:size, open_], np.float32(1.0 / size), axis=0)
        share, reached = _expect(likely[:, at], own, start)
        reached -= 0.5 * (2 * size - 1) * np.log(own + 1)
        better = reached > score[open_]
        best[:, open_[better]], score[open_[better]] = share[:, better], reached[better]
    return best


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAINING_ROWS) -> Model:
    """Fit on labelled rows: about ``rows`` of each language, or all where there are fewer.

    A row is taken if the hash of its key is below the share that leaves so many, so the choice
    depends on nothing but keys and counts. What reaches the driver is one count per bucket and
    language. Rows without language or text teach nothing; without any row there is no language.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    share = known.groupBy(lang).agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("__share")).collect()
    if not share:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32))
    part = F.lit(0.0)
    for row in share:
        part = F.when(F.col(lang) == row[0], F.lit(row[1])).otherwise(part)
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counted = known.filter(unit < part).select(lang, text).mapInArrow(_counts, "lang string, bucket bigint, n bigint")
    return Model.fit(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (default ``doc_id``), ``lang_pred``, ``score``, ``mixture``, ``n_letter_words``.

    ``mixture`` maps the chosen languages to their proportions; ``lang_pred`` is the largest (the
    first by name among equals) and ``score`` its proportion. A text that is null or has no letter,
    and every text under a model without languages, is ``und`` with score 0. Repeated rows are
    judged each; other columns are not read.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log))
    columns = [*keep] if text in keep else [*keep, text]
    read = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        names = np.array([*model.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            texts = [x or "" for x in batch.column(read).to_pylist()]
            done: list[tuple[np.ndarray, np.ndarray]] = []
            for part in sliced(texts, BLOCK_CHARS):
                done.append(model.mixtures(part))
            words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, dtype=np.int64)
            shares = np.concatenate([s for _, s in done]) if done else np.zeros((0, len(model.languages)))
            score = shares.max(axis=1, initial=0.0)
            lead = np.where(score > 0, shares.argmax(axis=1) if shares.shape[1] else 0, len(model.languages))
            row, col = np.nonzero(shares > 0)
            offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts)))).astype(np.int32)
            mixture = pa.MapArray.from_arrays(pa.array(offsets), pa.array(names[col], pa.string()), pa.array(shares[row, col]))
            made = [pa.array(names[lead], pa.string()), pa.array(np.minimum(score, 1.0)), mixture, pa.array(words.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *made], names=[*keep, "lang_pred", "score", "mixture", "n_letter_words"]
            )

    return docs.select(*columns).mapInArrow(run, f"{kept_schema(docs, keep)}, lang_pred string, score double, mixture map<string,double>, n_letter_words bigint")


def held_out(key: str = "doc_id") -> Column:
    """Rows no model may learn from: a quarter, by the checksum of the key's text."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
