"""Quality rules as learned decision lists.

Statistics of whole texts are joined with labels. Sequential covering grows one conjunction of
thresholds after the other, prunes each on held-back rows, and keeps it only if it is precise
there. What comes out is an ordered Spark conditional expression.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import map_texts
from recordloom.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Width of the windows whose repetition counts.
WINDOW = 8
#: About so many labelled rows, those with the least hash of the key, fit the list (all, if fewer).
TRAINING_ROWS = 20_000
#: Longest conjunction, longest list, share of right rows a rule needs on held-back rows, and rows it must cover.
CONDITIONS, RULES, PRECISION, SUPPORT = 3, 12, 0.95, 10

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")


def _repeated_words(words: list[bytes]) -> int:
    """Words inside a window that occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), dtype=np.int64, count=len(words))
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    if len(names) == len(words):
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    same &= (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    twice = np.zeros(n + WINDOW, dtype=np.int64)
    marked = np.zeros(n, dtype=bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    at = np.flatnonzero(marked)
    twice[at] += 1
    twice[at + WINDOW] -= 1
    return int((np.cumsum(twice) > 0).sum())


def _statistics(texts: list[str]):
    rows = []
    for text in texts:
        words = text.encode("utf-8", "replace").split()
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        lines = Counter(line for line in text.split("\n") if WORD.search(line)) if "\n" in text else {}
        letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(re.sub(r"[A-Za-z]+", "", text))
        upper = len(re.findall(r"[A-Z]", text)) if text.isascii() else sum(map(str.isupper, text))
        rows.append((
            len(words), chars, len(text) - len(text.translate(_SYMBOLS)), sum(lines.values()) - len(lines), _repeated_words(words),
            letters, upper, len(set(words)), max(map(len, words), default=0), text.count("\n"),
        ))
    table = np.array(rows, dtype=np.int64).reshape(len(texts), 10)
    names = (*BASE, "n_letters", "n_upper", "n_distinct", "longest_word", "n_breaks")
    return None, {name: pa.array(table[:, i]) for i, name in enumerate(names)}


def statistics(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Counts of every whole text, one row per input row; a null text has none."""
    names = (*BASE, "n_letters", "n_upper", "n_distinct", "longest_word", "n_breaks")
    return map_texts(docs, keep or ["doc_id"], text, ", ".join(f"{n} bigint" for n in names), _statistics)


#: What rules may speak of: ratios of the counts, so that a rule means the same for short and long texts.
FEATURES: dict[str, str] = {
    "words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / (n_breaks + 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "letter_share": "n_letters / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "longest_word": "double(longest_word)",
    "words_per_line": "n_words / (n_breaks + 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, table: pd.DataFrame) -> np.ndarray:
        values = table[self.feature].to_numpy()
        return values >= self.threshold if self.at_least else values <= self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold!r}"


@dataclass(frozen=True)
class DecisionList:
    """Conjunctions in order; a row is of the target class if one holds."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        """1-based number of the first rule that holds, 0 if none does."""
        found = F.lit(0)
        for i, rule in reversed(list(enumerate(self.rules))):
            every = rule[0].column()
            for condition in rule[1:]:
                every &= condition.column()
            found = F.when(every, F.lit(i + 1)).otherwise(found)
        return found

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, rule)) for rule in self.rules)


def _covered(rule: list[Condition], table: pd.DataFrame) -> np.ndarray:
    held = np.ones(len(table), dtype=bool)
    for condition in rule:
        held &= condition.holds(table)
    return held


def _grown(table: pd.DataFrame, target: np.ndarray) -> list[Condition]:
    """Add the condition with the most information gain until no other class is left."""
    rule: list[Condition] = []
    held = np.ones(len(table), dtype=bool)
    while len(rule) < CONDITIONS and (~target[held]).any():
        p, n = target[held].sum(), (~target[held]).sum()
        best, gain = None, 0.0
        for name in FEATURES:
            values = table[name].to_numpy()[held]
            order = np.argsort(values, kind="stable")
            ranked, hits = values[order], np.cumsum(target[held][order])
            edges = np.flatnonzero(ranked[1:] > ranked[:-1])
            for at_least in (False, True):
                good = (p - hits[edges]) if at_least else hits[edges]
                size = (len(ranked) - 1 - edges) if at_least else edges + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(good > 0, good * (np.log2(good / size) - np.log2(p / (p + n))), -np.inf)
                if len(gains) and gains.max() > gain + 1e-9:
                    i = int(gains.argmax())
                    low, high = ranked[edges[i]], ranked[edges[i] + 1]
                    middle = (low + high) / 2
                    best, gain = Condition(name, at_least, float(middle if low < middle < high else (high if at_least else low))), gains[i]
        if best is None:
            break
        rule.append(best)
        held &= best.holds(table)
    return rule


def _worth(rule: list[Condition], table: pd.DataFrame, target: np.ndarray) -> float:
    held = _covered(rule, table)
    p, n = target[held].sum(), (~target[held]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(table: pd.DataFrame, target: np.ndarray, fold: np.ndarray) -> DecisionList:
    """Sequential covering of the ``target`` rows; ``fold`` marks the rows held back for pruning."""
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(table), dtype=bool)
    while len(rules) < RULES:
        grow, prune = left & ~fold, left & fold
        if target[grow].sum() < SUPPORT:
            break
        rule = _grown(table[grow], target[grow])
        while len(rule) > 1 and _worth(rule[:-1], table[prune], target[prune]) >= _worth(rule, table[prune], target[prune]):
            rule.pop()
        held = _covered(rule, table[prune])
        if not rule or held.sum() < max(1, SUPPORT // 3) or target[prune][held].mean() < PRECISION:
            break
        rules.append(tuple(rule))
        left &= ~_covered(rule, table)
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRAINING_ROWS) -> DecisionList:
    """Learn which statistics mark rows of label 0, from about ``rows`` labelled rows.

    The rows are those whose key has the least hash, by the share that leaves so many; rows with a
    null key or label teach nothing, no labels give no rules. Rows of one key, label and statistics
    count once; where keys repeat with so many different texts that over twice ``rows`` are left,
    as many are taken by the hash of their statistics, so the driver reads a bounded table.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("__label"))
    share = min(1.0, rows / max(known.count(), 1))
    unit = F.pmod(F.xxhash64(F.col(key), F.lit("rows")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    held_back = F.pmod(F.xxhash64(F.col(key), F.lit("fold")), F.lit(3)) == 0
    met = known.filter(unit < share).join(stats, key).select(
        key, "__label", held_back.alias("__fold"), *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]
    )
    met = stage(met.distinct(), "labelled")
    again = F.pmod(F.xxhash64(key, "__label", *FEATURES), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = met.filter(again < min(1.0, 2 * rows / max(met.count(), 1))).toPandas().sort_values([key, "__label", *FEATURES], kind="stable", ignore_index=True)
    if not len(sample):
        return DecisionList(())
    return learn(sample, (sample["__label"] == 0).to_numpy(), sample["__fold"].to_numpy(dtype=bool))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``base_failed`` by the fixed limits, ``rule`` the learned rule that speaks against a row (0: none), ``kept``."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", rules.column()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )


def judged_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, base verdict and learned verdict of every document, one row each.

    The texts are read once: their statistics are written, then joined with the labels to learn and
    judged. Null and empty texts have no words and fail the base; repeated rows are judged each;
    without labels the base alone decides; other columns are not read.
    """
    stats = stage(statistics(docs, [key], text), "statistics")
    return judge(stats, fit(stats, labels, key))
