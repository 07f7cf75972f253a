import random
import re
import zlib

import pytest

from recordloom.llm import sentence_spans as spans

SHARED = "One shared sentence of some length stands here. Another shared one follows the first of them. And a third one ends the shared passage. "


def own(i):
    return f"Own words number {i} of a text come {i} first. Then some more {i} of them {i * 7} follow here. Last come these {i * 3} words of it. "


def cut_plainly(text):
    """Sentences with a word, cut at stops and line ends alone: for texts without long sentences."""
    out, at = [], 0
    for m in [*re.finditer(r"[.!?]+\s+|\s*\n\s*", text), None]:
        stop = m.end() if m else len(text)
        if text[at:stop].split():
            out.append((at, stop, text[at:stop].lower().split()))
        at = stop
    return out


def brute(docs):
    """Ranges by key, with plain loops: from every sentence the shortest run with the sentences and words of a span."""
    first, later = {}, {}
    for key, text in sorted(docs, key=lambda x: (x[0], zlib.crc32(x[1].encode()))):
        cut = cut_plainly(text)
        for i in range(len(cut)):
            for j in range(i + spans.RUN, len(cut) + 1):
                words = [w for _, _, said in cut[i:j] for w in said]
                if len(words) >= spans.LEAST_WORDS:
                    where = (key, text, cut[i][0])
                    if first.setdefault(tuple(words), where) != where:
                        later.setdefault(key, set()).add((cut[i][0], cut[j - 1][1]))
                    break
    merged = {}
    for key, ranges in later.items():
        out = []
        for a, b in sorted(ranges):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        merged[key] = out
    return merged


def test_sentences_hold_every_word():
    for text in ("", " \n ", SHARED, "no end", "a " * 400, "A. B! C?\nD\n\nE ", own(1) * 3 + "x | y | " * 50):
        cut = spans.sentences(text)
        assert all(a < b for a, b, _ in cut) and all(x[1] <= y[0] for x, y in zip(cut, cut[1:]))
        assert sum(n for _, _, n in cut) == len(text.split()) == len("".join(text[a:b] for a, b, _ in cut).split())


def test_against_brute_force(documents, rows):
    docs = [(1, own(1) + SHARED + own(2)), (2, SHARED + own(3)), (3, own(4)), (4, own(5) + SHARED.upper() + own(5)), (5, own(1) + SHARED + own(2)), (6, "x y z.\n" * 20 + SHARED * 2)]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in spans.repeated(documents(*[(i, t, "en") for i, t in docs])).collect()}
    assert got == brute(docs) and 1 not in got and 3 not in got
    assert got[2][0] == (0, len(SHARED)) and got[5] == [(0, len(docs[4][1]))]


def test_grown_runs_against_brute_force(documents):
    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    docs = [(i, "".join(rng.choice(lines) + rng.choice(["\n", ". ", "! "]) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    at = rng.randrange(20)
    docs += [(60 + i, docs[i][1][at:] + "a tail of its own") for i in range(20)]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in spans.repeated(documents(*[(i, t, "en") for i, t in docs])).collect()}
    assert got == brute(docs) and len(got) > 20


def test_passage_without_full_stops(documents):
    """Long sentences are cut by their own words, so a passage is found wherever it stands."""
    passage = " ".join(f"w{i * i % 97}x{i}" for i in range(60))
    docs = documents((1, "before it " + passage + " behind", "en"), (2, own(1) + "other lead words " + passage + " and on", "en"))
    row = spans.repeated(docs).first()
    assert row.doc_id == 2 and row.first_in == [1]
    assert sum(b - a for a, b in row.removed) > len(passage) // 2


def hashes(text):
    return set(spans._spans([text])[1]["span"].to_pylist())


@pytest.mark.parametrize("per_line, end", [(1, "\n"), (2, "\n"), (3, "\n"), (1, "!! "), (3, ". ")])
def test_passage_of_short_sentences(per_line, end):
    passage = end.join(" ".join(f"v{i}x{j}" for j in range(per_line)) for i in range(51 // per_line + 1)) + end
    assert hashes("Some head\n" + passage + "a tail") & hashes("Other words\nof another head\n" + passage + "b")


def test_every_passage_of_51_words_has_a_span():
    rng = random.Random(3)
    for vocabulary, ends in ((9, [""]), (400, [""]), (5000, [""] * 9 + [".", "!", ",\n"]), (1, [""]), (2, [""]), (5000, [""] * 12 + ["."]), (3, [""] * 3 + ["."])):
        for _ in range(300):
            words = lambda n: " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(ends)}" for _ in range(n))  # noqa: E731, B023
            passage = words(51)
            one, other = (f"{words(rng.randrange(40))} {passage} {words(rng.randrange(40))}" for _ in range(2))
            assert hashes(one) & hashes(other), passage


def test_case_of_a_character_that_grows(documents):
    docs = documents((1, SHARED + own(1), "en"), (2, "\u0130stanbul is named first. " + own(2) + SHARED, "en"))
    row = spans.repeated(docs).first()
    assert row.doc_id == 2 and [docs.collect()[1].text[a:b] for a, b in row.removed] == [SHARED]


def test_removal(documents):
    docs = documents((1, own(1) + SHARED, "en"), (2, own(2) + SHARED + own(3), "en"), (3, None, "en"), (None, SHARED, "en"))
    got = {r.doc_id: r.text for r in spans.removed_from(docs, spans.repeated(docs)).collect()}
    assert got == {1: own(1), 2: own(2) + own(3), 3: None, None: SHARED}


def test_hot_passage(documents):
    docs = documents(*[(i, own(i) + SHARED + own(i + 1000), "en") for i in range(600)])
    found = spans.repeated(docs).collect()
    assert len(found) == 599 and all(r.first_in[0] == 0 and len(r.removed) == 1 for r in found)


def test_odd_rows(odd, empty, clashing):
    got = {r.doc_id for r in spans.repeated(odd).collect()}
    assert got == {4, 5}  # the long text repeats itself; rows alike in key and text keep it
    assert spans.repeated(empty).count() == 0
    assert {r.doc_id for r in spans.repeated(clashing).collect()} == got
    assert spans.removed_from(clashing, spans.repeated(clashing)).columns == clashing.columns
    assert spans.removed_from(clashing, spans.repeated(clashing)).count() == 10


def test_parts_of_a_batch_and_a_hot_span(spark, documents, monkeypatch):
    text = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen fifteen."
    docs = documents(*[(i, f"{text} Number {i} has its own end here.", "en") for i in range(40)])
    whole = {r.doc_id: r for r in spans.repeated(docs).collect()}
    monkeypatch.setattr(spans, "PART_BYTES", 100)
    found = spans.repeated(docs)
    assert {r.doc_id: r for r in found.collect()} == whole and set(whole) == set(range(1, 40))
    joins = found._jdf.queryExecution().optimizedPlan().toString()
    assert joins.count("Aggregate") == 1  # the first places are a table, so that Spark can split a hot span
