"""Conversation repair against a plain recurrence over states, whole and in blocks."""

import hashlib
import itertools
import random
import zlib

import pytest

from recordloom.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def recurrence(rows):
    """Cost, edits and lines of the best path by the kind of the last row written."""
    best = {"": (0, "", ())}

    def inserted():
        for _ in range(3):
            for kind, (cost, edits, lines) in list(best.items()):
                new = (cost + 3, edits + "I", (*lines, FULL[NEXT[kind]] + ":"))
                best[NEXT[kind]] = min(best.get(NEXT[kind], new), new)

    for code, role, text in rows:
        inserted()
        moved = {}
        for kind, (cost, edits, lines) in best.items():
            options = [(kind, (cost + 4, edits + "D", lines))]
            if code not in "_=":
                late = 3 if code.isupper() else 0
                options.append((NEXT[kind], (cost + 3 + late, edits + "R", (*lines, f"{FULL[NEXT[kind]]}:{text}"))))
                if code.lower() == NEXT[kind] or (code.lower(), kind) == ("s", ""):
                    options.append((code.lower(), (cost + late, edits + "K", (*lines, f"{role}:{text}"))))
            for to, path in options:
                moved[to] = min(moved.get(to, path), path)
        best = moved
    inserted()
    return min(path for kind, path in best.items() if kind in ("", "a"))


def plain(table):
    """The contract, row by row."""
    out = {}
    for conv, turn, role, text in table:
        said = lambda x: " " if x is None else str(x)
        by = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        own = out.setdefault(conv, [])
        if by == 1:
            text = ""
        if by == 2:
            text = "".join(c for c in text if c not in ".!?")
        if by == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    results = set()
    for conv, rows in out.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, coded = set(), []
        for _, role, text in rows:
            full = text.strip(" \t\n\v\f\r")
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            code = "_" if not full else "=" if (role, text) in seen else code if full[-1] in ".!?" else code.upper()
            seen.add((role, text))
            coded.append((code, role, text))
        turns = {r[0] for r in rows} - {None}
        codes = "".join(c[0] for c in coded)
        cost, edits, lines = recurrence(coded)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        results.add((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, codes.count("_"), codes.count("="), sum(map(str.isupper, codes)),
            illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return results


def talk(rng, conv, size):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "é… done.", "more words without an end", "é" * 120 + "a.", "é" * 120 + "b."]
    rows = []
    for i in range(size):
        role = ("user", "assistant")[i % 2] if rng.random() < 0.7 else rng.choice(roles)
        text = f"Sentence {rng.randrange(10**6)} of {conv}." if rng.random() < 0.7 else rng.choice(texts)
        rows.append((conv, None if rng.random() < 0.03 else i + (i > 5 and rng.random() < 0.1), role, text))
    rng.shuffle(rows)
    return rows


def test_search_is_the_cheapest_and_least():
    rng = random.Random(1)
    for n in range(8):
        for _ in range(600):
            codes = "".join(rng.choice("suaxSUAX_=uauaua") for _ in range(n))
            want = recurrence([(c, {"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "") for c in codes])
            assert repair.cheapest(codes) == want[:2]
    for codes in ("ua" * 60, "uuaaUUAAss_=x" * 9, "aU" * 60):
        assert repair.cheapest(codes) == recurrence([(c, c, "") for c in codes])[:2]


def test_floors_never_exceed_the_cost():
    rng = random.Random(3)
    for _ in range(800):
        codes = "".join(rng.choice("suaxSUAX_=uu") for _ in range(rng.randrange(1, 9)))
        for a, b in itertools.product(range(4), range(4)):
            found = repair.cheapest(codes, a, b)
            assert found is None or found[0] >= repair.floors(codes)[0]


def test_blocks_chain_to_the_whole():
    """Cells of blocks, chained, give what one search over all rows gives."""
    import pandas as pd

    rng = random.Random(5)
    for _ in range(120):
        codes = "".join(rng.choice("suaxSUA_=uaua") for _ in range(rng.randrange(2, 14)))
        cuts = sorted({0, len(codes), *[rng.randrange(len(codes)) for _ in range(3)]})
        rows, cells = [], []
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            found = [repair.cheapest(codes[a:b], x, y) or (repair.NEVER, None) for x in range(4) for y in range(4)]
            cells.append([e for _, e in found])
            rows.append(("=1", 0, i, [c for c, _ in found], repair._ranks(found), 0, "u", "a"))
        got = repair._chained(pd.DataFrame(rows, columns=["conv", "part", "block", "costs", "ranks", "illegal", "first", "last"]))
        edits = "".join(cells[r.block][r.cell] + r.tail for r in got.itertuples())
        assert (got.cost[0], edits) == repair.cheapest(codes)


@pytest.mark.parametrize("rows, parts", [(128, 1), (128, 7), (3, 2)])
def test_against_the_recurrence(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(repair, "ROWS", rows)
    rng = random.Random(rows + parts)
    table = [r for conv in [*range(40), None] for r in talk(rng, conv, rng.randrange(1, 14))] + talk(rng, 999, 300)
    frame = spark.createDataFrame(table, SCHEMA).repartition(parts)
    got = [tuple(r) for r in repair.repaired(frame).collect()]
    assert len(got) == 42 and set(got) == plain(table)


def test_long_texts_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHARS", 50)
    table = talk(random.Random(8), 1, 40)
    assert {tuple(r) for r in repair.repaired(spark.createDataFrame(table, SCHEMA)).collect()} == plain(table)


def test_one_conversation_holds_nearly_all_rows(spark):
    rng = random.Random(11)
    table = talk(rng, 7, 3000) + [(7, 5, "user", "The same.")] * 500 + talk(rng, 8, 5)
    assert {tuple(r) for r in repair.repaired(spark.createDataFrame(table, SCHEMA).repartition(8)).collect()} == plain(table)


def test_undamaged_rows_stay(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello.")], SCHEMA)
    r = repair.repaired(rows, damage=False).first()
    assert (r.cost, r.audit, r.illegal) == (0, "KKK", 0)
    assert r.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hi!\nassistant:Hello.").hexdigest()


def test_odd_rows(spark):
    table = [(None, None, None, None), (None, None, None, None), (1, None, "user", None), (2, 0, None, "Long. " * 40000), (3, 1, "", "x"), (3, 1, "", "x")]
    frame = spark.createDataFrame(table, SCHEMA)
    want = plain(table)
    assert {tuple(r) for r in repair.repaired(frame).collect()} == want
    clash = frame.selectExpr("*", *[f"1 as `{n}`" for n in ("there", "code", "part", "at", "block", "audit", "head", "mark", "row", "conv")])
    assert {tuple(r) for r in repair.repaired(clash).collect()} == want
    assert repair.repaired(frame.limit(0)).count() == 0


def test_every_conversation_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert {tuple(r) for r in repair.repaired(rows).collect()} == plain([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
