import pytest

from recordloom.llm import templates

ITEM = "Alice buys 12 apples for 3 dollars each at the small market near her house. How many dollars does Alice pay in total?"
OTHER = "Bob buys 40 apples for 7 dollars each at the small market near her house. How many dollars does Bob pay in total?"
BROKEN = "Bob buys 40 apples for 7 dollars each at the small market near her house. How many dollars does Carol pay in total?"
FILL = "Some words of no importance stand before it and others that mean as little stand behind. "


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "the quick brown fox"), (3, None), (4, ""), (None, ITEM)], "item_id bigint, text string")


@pytest.fixture
def found(items):
    return lambda docs: {(r.doc_id, r.item_id): r for r in templates.contaminated(docs, items).collect()}


def test_copies_and_new_parameters(documents, found):
    rows = found(documents((1, FILL + ITEM + " " + FILL, "en"), (2, FILL + OTHER, "en"), (3, FILL * 5, "en"), (4, OTHER.upper(), "en")))
    # in capitals no name is told from a word, but more than half of the windows agree word for word
    assert set(rows) == {(1, 1), (2, 1), (4, 1)}
    assert rows[1, 1].exact and rows[1, 1].coverage == 1.0
    assert not rows[2, 1].exact and rows[2, 1].coverage == 1.0


def test_capitals_with_few_words_in_common_are_another_text(documents, found):
    other = "Bob buys 40 pears for 7 dollars each in a big new shop by his old hut. How many dollars does Bob pay in total?"
    assert found(documents((1, FILL + other.upper(), "en"))) == {}


def test_slots_must_map_one_to_one(documents, found):
    assert found(documents((1, FILL + BROKEN, "en"))) == {}


def test_one_edit_does_not_hide_an_item(documents, spark):
    item = "A box on the left side of the desk has 5 pens in it and the clerk of the shop then buys 5 more for the box, so how many are there in all?"
    items = spark.createDataFrame([(1, item), (2, ITEM)], "item_id bigint, text string")
    docs = documents((1, FILL + item.replace("5 more", "6 more"), "en"), (2, FILL + ITEM.replace("does Alice pay in", "does Carol pay in"), "en"))
    got = {(r.doc_id, r.item_id): r.coverage for r in templates.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2)} and all(0.5 <= x < 1 for x in got.values())


@pytest.mark.parametrize("change", [str.lower, str.upper, str.title, str.swapcase])
def test_exact_wording_in_any_case(documents, found, change):
    rows = found(documents((1, FILL + change(ITEM) + " " + FILL, "en")))
    assert rows[1, 1].coverage == 1.0


@pytest.mark.parametrize("item", ["12 + 30 * 4 = 132", "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy", "3 m 12 s 4 km 18 h 5 m 20 s 6 km", "7", "1 2 3 4 5 6 7 8 9 10 11 12"])
def test_items_without_literals_are_found_word_for_word(documents, spark, item):
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = documents((1, FILL + item + " " + FILL, "en"), (2, FILL + "13 + 31 * 5 = 168 Kim Lee Max Ned Ola Pat Quin Ros Sue Tom 9 m 8 s 9 km 8 h 9 m 8 s", "en"))
    assert [(r.doc_id, r.coverage) for r in templates.contaminated(docs, items).collect()] == [(1, 1.0)]


def test_two_variants_in_one_document(documents, found):
    rows = found(documents((1, ITEM + " " + FILL + OTHER, "en")))
    assert rows[1, 1].coverage == 1.0


def test_half_an_item(documents, found):
    assert set(found(documents((1, FILL + ITEM[:80] + " " + FILL, "en")))) == {(1, 1)}
    assert set(found(documents((1, FILL + ITEM[:40] + " " + FILL, "en")))) == set()


def test_short_item(documents, found):
    assert set(found(documents((1, "Look, the quick brown fox jumps.", "en"), (2, "the quick brown cat", "en")))) == {(1, 2)}


@pytest.mark.parametrize(
    "token, form", [("12", "<num>"), ("1,200.5", "<num>"), ("Alice", "<name>"), ("How", "how"), ("km", "<unit>"), ("%", "<unit>"), ("ALICE", "alice"), ("a", "a")]
)
def test_canonical(token, form):
    assert templates.canonical(token) == form


def test_filter_covers_every_window(items):
    wanted = templates.item_windows(items.filter("item_id is not null"))
    bits = templates.bit_filter(wanted, "window")
    import numpy as np

    assert templates.passing(bits, np.array([r.window for r in wanted.collect()], dtype=np.int64)).all()
    assert templates.passing(bits, np.random.default_rng(0).integers(-2**63, 2**63 - 1, 10000)).mean() < 0.01


def test_many_copies(documents, found):
    rows = found(documents(*[(i, FILL + ITEM, "en") for i in range(300)], *[(i, FILL, "en") for i in range(300, 500)]))
    assert set(rows) == {(i, 1) for i in range(300)}


def test_odd_rows(odd, empty, clashing, items, spark):
    assert templates.contaminated(odd, items).count() == 0
    assert templates.contaminated(empty, items).count() == 0
    assert templates.contaminated(odd, items.limit(0)).count() == 0
    assert templates.contaminated(clashing, items).count() == 0
    both = odd.limit(0).unionByName(spark.createDataFrame([(9, ITEM, "en", "s", 1)] * 2, odd.schema))
    assert templates.contaminated(both, items).count() == 1


def test_planted_passages(spark):
    """Every document that holds an item as it is, and none that shares no half of one."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, items).collect()}
    texts = [(r.doc_id, " ".join(r.text.split())) for r in docs.collect()]
    want = {(d, r.item_id) for r in items.collect() for d, t in texts if " ".join(r.text.split()) in t}
    assert want <= got
    by = dict(texts)
    bench = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    assert all(bench[i][20:60].lower() in by[d].lower() for d, i in got)


def test_numbers_of_tokens_stay_bounded_and_hashes_are_those_of_an_unbounded_table(monkeypatch):
    monkeypatch.setattr(templates._Tokens, "BOUND", 3)
    few, blocks = templates._Tokens(), [["a", "Bob", "12"], ["c", "d", "a"], ["e", "Bob", "c"]]
    whole = templates._Tokens()
    for block in blocks:
        n, m = few.numbers(block), whole.numbers(block)
        assert len(few) <= 3 + len(block)
        assert few.codes[n].tolist() == whole.codes[m].tolist() and few.plain[n].tolist() == whole.plain[m].tolist()
