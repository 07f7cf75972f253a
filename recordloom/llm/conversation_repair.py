"""Conversation structure repair: the cheapest edits, found by iterative-deepening A*.

A conversation is sound if its role initials read ``(s?(ua)+)?``. Every row is kept (0), given the
role of user or assistant (3) or deleted (4), and an empty row of either may be inserted anywhere (3);
blank and duplicate rows must be deleted, a truncated row that stays costs 3. The search goes through
edits depth first in the order of their initials D, I, K, R under a growing bound on the cost, so the
first accepted path under the first bound that has one is the cheapest, and of those the least text.

Rows are laid out by conversation and turn. A conversation that lies inside one partition, with at
most ``ROWS`` rows and ``CHARS`` characters, is searched whole. All others are cut into blocks of that
size; each block is searched from every state to every state, and the blocks are chained by their costs.
No task holds more text than one block. A digest of a whole conversation is sequential by nature:
it is taken from a sorted stream, in one task for a conversation.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import stage

#: Rows and characters of a block.
ROWS, CHARS = 128, 4_000_000
#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing written, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a row that takes the role its place asks for, and behind a row that keeps its own.
FOLLOWING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPING = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
SOUND = {"su", "ua", "au"}
#: Edits that end a conversation, by the state behind its last row.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: Codes of rows that must go; other codes are s, u, a or x (another role), in upper case if truncated.
BLANK, DUPLICATE = "_", "="
SPACES = " \t\n\v\f\r"
NEVER = 1 << 60
EMPTY = hashlib.sha256(b"").hexdigest()


def code_of(role: str, text: str) -> str:
    """One letter for what the search needs of a row, repetition aside."""
    said = text.rstrip(SPACES)
    if not said:
        return BLANK
    kind = role[:1] if role[:1] in KEEPING else "x"
    return kind if said[-1] in ".!?" else kind.upper()


def floors(codes: str) -> list[int]:
    """What the rows from each place on cost at least, whatever the state before them.

    Each row by itself, and besides 3 for each pair of neighbours that may not follow one another
    (1 if one of them is truncated: deleting it costs that much more). No row is in two pairs.
    """
    own = {BLANK: DELETE, DUPLICATE: DELETE, "x": REROLE, "X": DELETE, **dict.fromkeys("sua", 0), **dict.fromkeys("SUA", TRUNCATED)}
    least, pairs, behind = [0] * (len(codes) + 1), [0] * (len(codes) + 2), None
    rows = 0
    for i in range(len(codes) - 1, -1, -1):
        code, rows = codes[i], rows + own[codes[i]]
        pairs[i] = pairs[i + 1]
        if code.isalpha():
            if behind is not None and "x" not in (code.lower(), codes[behind].lower()) and (code + codes[behind]).lower() not in SOUND:
                gain = REROLE if (code + codes[behind]).islower() else DELETE - TRUNCATED
                pairs[i] = max(pairs[i], gain + pairs[behind + 1])
            behind = i
        least[i] = rows + pairs[i]
    return least


def cheapest(codes: str, start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and edits of the cheapest repair; of equal ones the least text.

    With a ``goal`` it ends behind the last row in that state; None where no path does.
    """
    size, least = len(codes), floors(codes)
    if goal in (START, SYSTEM):  # only by deleting all rows but one system row at most
        if start not in (START, goal):
            return None
        spared = [START == start != goal and "s" in codes[i:].lower() for i in range(size + 1)]
        least = [max(floor, DELETE * (size - i - spared[i])) for i, floor in enumerate(least)]
    known: dict[tuple[int, int, int], int] = {}  # what a failed place is proven to cost at least

    def ended(at: int, state: int) -> bool:
        return at == size and (state in (START, ASSISTANT) if goal is None else state == goal)

    def edits(at: int, state: int, inserted: int) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        code = codes[at] if at < size else ""
        if code:
            yield "D", DELETE, (at + 1, state, 0)
        if inserted < 2 and (code or goal is None):  # a third insertion in a row leads back to a state met before
            yield "I", INSERT, (at, FOLLOWING[state], inserted + 1)
        if code.isalpha():
            more = TRUNCATED if code.isupper() else 0
            if state in KEEPING.get(code.lower(), {}):
                yield "K", more, (at + 1, KEEPING[code.lower()][state], 0)
            yield "R", REROLE + more, (at + 1, FOLLOWING[state], 0)

    def within(bound: int) -> str | None:
        root = (0, start, 0)
        path: list[str] = []
        frames = [[root, 0, 0, edits(*root), NEVER]]  # place, its step's cost, cost so far, edits left, least cost onward
        while frames:
            frame = frames[-1]
            for name, cost, place in frame[3]:
                onward = cost + max(least[place[0]], known.get(place, 0))
                if frame[2] + onward > bound:
                    frame[4] = min(frame[4], onward)
                elif ended(place[0], place[1]):
                    return "".join(path) + name
                else:
                    path.append(name)
                    frames.append([place, cost, frame[2] + cost, edits(*place), NEVER])
                    break
            else:
                known[frame[0]] = frame[4]
                frames.pop()
                if frames:
                    path.pop()
                    frames[-1][4] = min(frames[-1][4], frame[1] + frame[4])
        return None

    if ended(0, start):
        return 0, ""
    bound = least[0]
    while bound < NEVER:
        found = within(bound)
        if found is not None:
            return bound, found
        bound = known[0, start, 0]
    return None


class Searched(dict):
    """Remembers the repair of each sequence of codes a task meets, up to a bound."""

    BOUND = 50_000

    def __missing__(self, codes: str) -> tuple[int, str]:
        found = cheapest(codes)
        if len(self) < self.BOUND:
            self[codes] = found
        return found


def written(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str]]:
    """State and ``role:text`` behind every edit that writes a row, in order."""
    for edit in edits:
        if edit == "I":
            state = FOLLOWING[state]
            yield state, f"{NAMES[state]}:"
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEEPING[role[:1]][state]
            yield state, f"{role}:{text}"
        elif edit == "R":
            state = FOLLOWING[state]
            yield state, f"{NAMES[state]}:{text}"


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The damaged rows as conv_id, turn, role, text and ``there``; a dropped row stays as a mark of its conversation."""
    name = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    by = F.crc32(name) % 20
    said, spoke = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv_id"),
        F.when(by != 0, F.col(turn).cast("long")).alias("turn"),
        F.when(by == 4, "user").when(by != 0, spoke).alias("role"),
        F.when(by == 1, "").when(by == 2, F.regexp_replace(said, "[.!?]", "")).when(by != 0, said).alias("text"),
        (by != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(0), F.when(by == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_ROW = "part int, at bigint, block int, turn bigint, role string, text string, there boolean, code string, initial string"
_RESULTS, _ROWS = ([x.split()[0] for x in schema.split(", ")] for schema in (_RESULT, _ROW))


def _whole(rows: list[tuple], searched: Searched) -> list:
    """The result of a conversation from its rows (turn, role, text) in order."""
    turns = {r[0] for r in rows if r[0] is not None}
    seen: set[tuple[str, str]] = set()
    codes = []
    for _, role, text in rows:
        code = code_of(role, text)
        codes.append(DUPLICATE if code != BLANK and (role, text) in seen else code)
        seen.add((role, text))
    codes = "".join(codes)
    illegal = sum(a[1][:1] + b[1][:1] not in SOUND for a, b in itertools.pairwise(rows))
    cost, edits = searched[codes]
    lines = "\n".join(line for _, line in written(edits, START, ((r[1], r[2]) for r in rows)))
    return [
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, codes.count(BLANK), codes.count(DUPLICATE), sum(map(str.isupper, codes)),
        illegal, cost, edits, hashlib.sha256(lines.encode("utf-8", "replace")).hexdigest(),
    ]


def _searched_whole(laid: DataFrame, kind: str) -> DataFrame:
    """Results of conversations that lie inside a partition, and the coded rows of all others.

    The first and the last conversation of a partition may go on in the next one, so they count as others.
    """
    schema = pa.schema([
        ("conv_id", pa.null()), *[(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in _RESULTS],
        ("part", pa.int32()), ("at", pa.int64()), ("block", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
        ("there", pa.bool_()), ("code", pa.string()), ("initial", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, searched = TaskContext.get().partitionId(), Searched()
        out: list[list] = []
        held: list[tuple] = []
        conv, first, large, chars, at, block, in_block, block_chars = None, True, False, 0, 0, 0, 0, 0
        known_type = None

        def opened() -> None:
            nonlocal at, block, in_block, block_chars
            for turn, role, text, there in held:
                if in_block >= ROWS or (in_block and block_chars + len(text or "") > CHARS):
                    block, in_block, block_chars = block + 1, 0, 0
                code, initial = (code_of(role, text), role[:1]) if there else (None, None)
                out.append([conv, *[None] * len(_RESULTS), part, at, block, turn, role, text, there, code, initial])
                at, in_block, block_chars = at + 1, in_block + there, block_chars + len(text or "")
            held.clear()

        def closed(last: bool) -> None:
            nonlocal first
            if first or last or large:
                opened()
            else:
                out.append([conv, *_whole([r[:3] for r in held if r[3]], searched), *[None] * len(_ROWS)])
                held.clear()
            first = False

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            arrays = [pa.array(c, t if t != pa.null() else known_type) for c, t in zip(columns, schema.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        started = False
        for batch in batches:
            known_type = batch.schema.field(0).type
            for here, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or here != conv:
                    if started:
                        closed(last=False)
                    conv, started, large, chars, at, block, in_block, block_chars = here, True, False, 0, 0, 0, 0, 0
                held.append(tuple(row))
                chars += len(row[2] or "")
                if len(held) > ROWS or chars > CHARS:
                    large, chars = True, 0
                    opened()
            if out:
                yield flushed()
        if started:
            closed(last=True)
            yield flushed()

    return laid.select("conv_id", "turn", "role", "text", "there").mapInArrow(run, f"conv_id {kind}, {_RESULT}, {_ROW}")


def _cells(blocks: DataFrame) -> DataFrame:
    """For every block the cost, the rank among equal starts and the edits from each state to each state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list] = {n: [] for n in ("costs", "ranks", "edits", "illegal", "first", "last")}
            for codes, initials in zip(batch.column("codes").to_pylist(), batch.column("initials").to_pylist(), strict=True):
                found = [cheapest(codes, a, b) or (NEVER, None) for a in range(4) for b in range(4)]
                illegal = sum(a + b not in SOUND for a, b in itertools.pairwise(initials))
                for name, x in zip(made, ([c for c, _ in found], _ranks(found), [e for _, e in found], illegal, initials[0], initials[-1]), strict=True):
                    made[name].append(x)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(x, kind) for x, kind in zip(made.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=["conv", "part", "block", *made])

    return blocks.select("conv", "part", "block", "codes", "initials").mapInArrow(
        run, "conv string, part int, block int, costs array<bigint>, ranks array<int>, edits array<string>, illegal bigint, first string, last string"
    )


def _ranks(found: list[tuple[int, str | None]]) -> list[int]:
    """The place of each cell's edits among those from the same state; edits of one start never are prefixes of one another."""
    ranks = []
    for a in range(0, 16, 4):
        order = sorted(range(4), key=lambda b: (found[a + b][1] is None, found[a + b][1] or ""))
        ranks += [order.index(b) for b in range(4)]
    return ranks


def _chained(group: pd.DataFrame) -> pd.DataFrame:
    """The cell every block of a conversation takes, with the cost of all and the faults between rows."""
    blocks = group.sort_values(["part", "block"], ignore_index=True)
    costs = np.array(blocks["costs"].tolist(), dtype=np.int64).reshape(-1, 4, 4)
    onward = [np.array([INSERT * len(TAIL[x]) for x in range(4)], dtype=np.int64)]
    for cost in costs[::-1]:
        onward.append(np.minimum((cost + onward[-1]).min(axis=1), NEVER))
    onward.reverse()
    state, taken = START, []
    for i, (cost, ranks) in enumerate(zip(costs, blocks["ranks"], strict=True)):
        total = cost[state] + onward[i + 1]
        state = min(np.flatnonzero(total == total.min()).tolist(), key=lambda b, a=state, of=ranks: of[4 * a + b])
        taken.append(state)
    starts = [START, *taken[:-1]]
    joins = sum(a + b not in SOUND for a, b in zip(blocks["last"][:-1], blocks["first"][1:], strict=True))
    tails = [""] * (len(taken) - 1) + [TAIL[state]]
    return pd.DataFrame({
        "conv": blocks["conv"], "part": blocks["part"], "block": blocks["block"], "start": starts, "cell": [4 * a + b for a, b in zip(starts, taken, strict=True)],
        "tail": tails, "cost": int(onward[0][START]), "illegal": int(blocks["illegal"].sum()) + joins,
    })


def _digests(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The digest of every conversation's repaired rows, from rows and the edits of their blocks in one order."""
    told = pieces.select("conv", "part", "block", F.lit(-1).cast("long").alias("at"), "start", "piece", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    said = rows.select("conv", "part", "block", "at", F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("piece"), "role", "text")
    both = told.unionByName(said).repartition("conv").sortWithinPartitions("conv", "part", "block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, state, edits, begun = None, None, START, "", False

        def put(line: str) -> None:
            nonlocal begun
            digest.update((("\n" if begun else "") + line).encode("utf-8", "replace"))
            begun = True

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [digest.hexdigest()]}, schema=pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())]))

        for batch in batches:
            for here, _, _, _, start, piece, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != conv:
                    if conv is not None:
                        yield ended()
                    conv, digest, begun = here, hashlib.sha256(), False
                if piece is not None:
                    state, edits = start, piece
                else:
                    now = len(edits) - len(edits.lstrip("I")) + 1
                    for state, line in written(edits[:now], state, iter([(role, text)])):
                        put(line)
                    edits = edits[now:]
                if edits and not edits.strip("I"):  # what is inserted behind the last row
                    for state, line in written(edits, state, iter(())):
                        put(line)
                    edits = ""
        if conv is not None:
            yield ended()

    return both.mapInArrow(run, "conv string, repaired_sha256 string")


def _searched_in_blocks(opened: DataFrame) -> DataFrame:
    """Results of the conversations whose rows are given, through their blocks."""
    rows = opened.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    there = rows.filter("there").withColumn("said", F.md5("text"))
    firsts = there.groupBy("conv", "role", "said").agg(F.min(F.struct("part", "at")).alias("first"))
    again = (F.col("code") != BLANK) & (F.struct("part", "at") != F.col("first"))
    coded = stage(
        there.select("conv", "part", "at", "block", "turn", "role", "said", "code", "initial").join(firsts, ["conv", "role", "said"])
        .select("conv", "part", "at", "block", "turn", F.when(again, DUPLICATE).otherwise(F.col("code")).alias("code"), "initial"), "coded",
    )
    letters = F.sort_array(F.collect_list(F.struct("at", "code", "initial")))
    blocks = coded.groupBy("conv", "part", "block").agg(letters.alias("rows")).select(
        "conv", "part", "block", F.array_join("rows.code", "").alias("codes"), F.col("rows.initial").alias("initials")
    )
    cells = stage(_cells(blocks), "cells")
    chained = stage(
        cells.drop("edits").groupBy("conv").applyInPandas(
            _chained, "conv string, part int, block int, start int, cell int, tail string, cost bigint, illegal bigint"
        ), "chained",
    )
    pieces = stage(
        cells.select("conv", "part", "block", "edits").join(chained, ["conv", "part", "block"])
        .withColumn("piece", F.concat(F.element_at("edits", F.col("cell") + 1), "tail")).drop("edits"), "pieces",
    )
    told = pieces.groupBy("conv").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("part", "block", "piece")))["piece"], "").alias("audit"),
        F.first("cost").alias("cost"), F.first("illegal").alias("illegal"),
    )
    count = lambda at: F.count(F.when(at, 1))
    upper = F.col("code").rlike("[A-Z]")
    faults = coded.groupBy("conv", "turn").agg(
        count(F.col("code") == BLANK).alias("blank"), count(F.col("code") == DUPLICATE).alias("duplicate"), count(upper).alias("truncated")
    ).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
    )
    found = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    for more in (faults, told, _digests(there, pieces)):
        found = found.join(more, "conv", "left")
    zeros = {n: F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns(zeros | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(EMPTY))}).select("conv_id", *_RESULTS)


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = True) -> DataFrame:
    """Faults, cost, edits and digest of every conversation, one row each.

    ``damage`` first damages the rows by a rule of their place (drop, empty, take the full stops, repeat, make
    user). Rows stand by turn, nulls first; rows of one turn by role, the first 100 characters of the
    text and its checksum, so equal rows stand side by side. Null roles and texts are one space: such a
    role can only be replaced, such a text is blank. A null conversation is one of its own. Roles whose initial is not s, u
    or a, and empty ones, can only be replaced or deleted. A conversation without rows after damage has
    zeros, no edits and the digest of the empty text. Other columns are not read; empty tables give no rows.
    """
    source = rows.select(*[F.col(c).alias(n) for c, n in ((conv, "conv_id"), (turn, "turn"), (role, "role"), (text, "text"))])
    if damage:
        hurt = damaged(source, "conv_id", "turn", "role", "text")
    else:
        hurt = source.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(True).alias("there"))
    order: list[Column] = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "mark", "row")]
    marked = hurt.withColumns({"head": F.substring("text", 1, 100), "mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    laid = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(source.dtypes)["conv_id"]
    done = stage(_searched_whole(laid, kind), "conversations")
    whole = done.filter(F.col("part").isNull()).select("conv_id", *_RESULTS)
    return whole.unionByName(_searched_in_blocks(done.filter(F.col("part").isNotNull()).select("conv_id", *_ROWS)))
