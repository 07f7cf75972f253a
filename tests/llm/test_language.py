import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import language

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return language.train(docs.filter(~language.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language.identify(docs, model, ["doc_id", "lang"]).withColumn("held", language.held_out()).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(found.doc_id, found.held))
    held = found[found.held]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_mixture_finds_both_languages(spark, model):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("n_chars between 1500 and 4000")
    text = {r.lang: r.text for r in docs.orderBy("doc_id").groupBy("lang").agg(F.first("text").alias("text")).collect()}
    words, shares = model.mixtures([text["en"] + " " + text["de"], text["fr"]])
    names = model.languages
    assert abs(shares[0].sum() - 1) < 1e-3 and set(np.flatnonzero(shares[0] > 0.2)) == {names.index("en"), names.index("de")}
    assert shares[1].argmax() == names.index("fr") and shares[1].max() > 0.95 and words[1] > 100


def test_chosen_set_is_the_best_by_brute_force():
    """Against plain expectation maximisation over all nested sets, one text at a time."""
    rng = np.random.default_rng(3)
    sizes = np.array([1, 4, 30, 200])
    likely = rng.random((3, sizes.sum())).astype(np.float32) ** 4 + np.float32(1e-6)
    got, at = language._chosen(likely, sizes), 0
    for i, n in enumerate(sizes):
        own = likely[:, at : at + n].astype(float)
        at += n

        def fit(share, rounds=language.ROUNDS, own=own):
            for _ in range(rounds):
                part = own * share[:, None]
                share = (part / part.sum(axis=0)).mean(axis=1)
            return share, np.log((own * share[:, None]).sum(axis=0)).sum()

        full = fit(np.full(3, 1 / 3))[0]
        order = np.argsort(-full, kind="stable")
        best, score = None, -np.inf
        for size in (1, 2, 3):
            if size > 1 and full[order[size - 1]] * n < 0.5:
                break
            start = np.zeros(3)
            start[order[:size]] = 1 / size
            share, reached = fit(start)
            if reached - 0.5 * (2 * size - 1) * np.log(n + 1) > score:
                best, score = share, reached - 0.5 * (2 * size - 1) * np.log(n + 1)
        assert np.allclose(got[:, i], best, atol=1e-3)


def test_no_labels(documents):
    none = language.train(documents((1, "text", None), (2, None, "en")))
    assert none.languages == []
    row = language.identify(documents((1, "some text", None)), none).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_labels_without_letters_teach_nothing(documents):
    assert language.train(documents((1, "123", "xx"))).languages == []


def test_odd_rows(odd, empty, clashing, model):
    rows = language.identify(odd, model).collect()
    assert len(rows) == 10
    for r in rows:
        if r.doc_id in (1, 2, 3, 7):
            assert (r.lang_pred, r.score, r.n_letter_words) == ("und", 0.0, 0)
    assert language.identify(empty, model).count() == 0
    assert language.identify(clashing, model).count() == 10
    assert language.train(empty).languages == []
