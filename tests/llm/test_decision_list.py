import collections
import re

import numpy as np
import pandas as pd
import pytest

from recordloom.llm import decision_list as rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


TEXTS = [None, "", " \n\n", "a b c", "w " * 30, "a b c d e f g h " * 3, "one two three four five six seven eight nine " * 2, "é è   x\u0085y\x1cz", "l\nl\n \nl\nm\n" * 5,
         "#a *b $c %d &e |f <g> " * 9, " ".join(f"u{i}" for i in range(500)), "A\tB\x0bC\x0cD\rE " * 40, "\U0001F600 " * 25]


def test_base_statistics(documents):
    docs = documents(*[(i, t, "en") for i, t in enumerate(TEXTS)])
    labels = docs.selectExpr("doc_id", "1 as quality").limit(0)
    rows = {r.doc_id: r for r in rules.judged_documents(docs, labels).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text), text
        assert r.kept == (not r.base_failed) and r.rule == 0


def _table(n, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({name: rng.random(n) for name in rules.FEATURES})


def test_learned_rules_are_the_ones_planted():
    table = _table(4000)
    target = ((table.symbol_share > 0.8) & (table.words > 0.5) | (table.upper_share < 0.1)).to_numpy()
    found = rules.learn(table, target, np.arange(4000) % 3 == 0)
    held = np.zeros(4000, dtype=bool)
    for rule in found.rules:
        held |= rules._covered(list(rule), table)
    assert (held == target).mean() > 0.99 and len(found.rules) <= 5
    fresh = _table(2000, 1)
    want = ((fresh.symbol_share > 0.8) & (fresh.words > 0.5) | (fresh.upper_share < 0.1)).to_numpy()
    got = np.zeros(2000, dtype=bool)
    for rule in found.rules:
        got |= rules._covered(list(rule), fresh)
    assert (got == want).mean() > 0.98


def test_noise_gives_no_rule():
    table = _table(2000)
    target = np.random.default_rng(7).random(2000) < 0.3
    found = rules.learn(table, target, np.arange(2000) % 3 == 0)
    held = np.zeros(2000, dtype=bool)
    for rule in found.rules:
        held |= rules._covered(list(rule), table)
    assert held.mean() < 0.02


def test_expression_is_the_list(spark):
    table = _table(300)
    parts = rules.DecisionList(((rules.Condition("words", True, 0.5), rules.Condition("upper_share", False, 0.3)), (rules.Condition("symbol_share", True, 0.9),)))
    stats = spark.createDataFrame([(i, 10 * i, 40 * i, i % 7, 0, 0, 30 * i, i, i, 9, 3) for i in range(1, 60)],
                                  "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                                  "n_letters bigint, n_upper bigint, n_distinct bigint, longest_word bigint, n_breaks bigint")
    from pyspark.sql import functions as F

    got = stats.select(parts.column().alias("rule"), *[F.expr(e).cast("double").alias(n) for n, e in rules.FEATURES.items()]).toPandas()
    want = np.where(rules._covered(list(parts.rules[0]), got), 1, np.where(rules._covered(list(parts.rules[1]), got), 2, 0))
    assert (got["rule"].to_numpy() == want).all() and len(table) == 300


def test_labelled_corpus(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = rules.judged_documents(docs, labels).join(labels, "doc_id").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.93
    assert (~rows[rows.quality == 0].kept).mean() > 0.8
    assert not (rows.base_failed & rows.kept).any()


@pytest.mark.parametrize("labelled", [[], [(1, 0), (1, 1), (None, 0), (4, None)]])
def test_odd_rows(odd, empty, clashing, spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id bigint, quality int")
    rows = rules.judged_documents(odd, labels).collect()
    assert len(rows) == 10 and all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 6, 7))
    assert rules.judged_documents(empty, labels).count() == 0
    assert rules.judged_documents(clashing, labels).count() == 10


@pytest.mark.parametrize("texts, most", [(1, 1), (3000, 200)])
def test_rows_of_a_repeated_key_are_bounded(documents, monkeypatch, texts, most):
    docs = documents(*[(1, f"word {'x' * (i % texts)} " * 30, "en") for i in range(3000)], (2, "a clean text", "en"))
    labels = docs.sparkSession.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id bigint, quality int")
    met = []
    monkeypatch.setattr(rules, "learn", lambda table, target, fold: met.append(len(table)) or rules.DecisionList(()))
    stats = rules.statistics(docs, ["doc_id"], "text")
    rules.fit(stats, labels, rows=50)
    assert 1 <= met[0] <= most + 1
