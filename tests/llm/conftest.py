import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text, lang) tuples."""

    def make(*rows):
        full = [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = "Long words of one very long text, repeated and numbered. " * 3000


@pytest.fixture
def odd(documents):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    return documents(
        (1, None, "en"), (None, None, None), (2, "", None), (3, " \n\t ", "en"), (None, "No key but a text with words.", "en"),
        (4, LONG, "en"), (5, LONG, "fr"), (6, "Rows that repeat are rows like others.", "en"), (6, "Rows that repeat are rows like others.", "en"),
        (7, "?!,. 123", "en"),
    )


@pytest.fixture
def empty(documents):
    return documents()


@pytest.fixture
def clashing(odd):
    """The same rows with columns named as operators name theirs."""
    names = ("shard", "slot", "size", "found", "blob", "body", "rep", "component_id", "signature", "window", "at", "span", "start", "kept", "words", "score", "ids", "__removed")
    return odd.selectExpr("*", *[f"cast(null as string) as `{n}`" for n in names])
