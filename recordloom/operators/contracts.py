"""Contracts over JSON values: a subset of JSON Schema, checked as Spark expressions.

A contract is turned into one array-valued expression on the driver, so a check is a
projection over the JSON column plus an explode of the problems found.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.errors import GateFailed, RecordError
from recordloom.operators.publish import observed_or
from recordloom.operators.schema import col, shape_type, variant_type
from recordloom.session import stage

#: Levels that one pass over the rows lists; deeper values go on in a further pass.
LEVELS = 16
#: Bound of a generated contract, which is put together on the driver.
MAX_PATHS = 10_000
_VIOLATION = "array<struct<path:string,rule:string,expected:string,found:string>>"
# Contract type names and the value types that satisfy each.
ACCEPTS = {
    "object": ("object",),
    "array": ("list",),
    "string": ("string",),
    "number": ("integer", "number"),
    "integer": ("integer",),
    "boolean": ("boolean",),
    "null": ("null",),
}


@dataclass(frozen=True)
class _Place:
    """Where a piece of a contract was read: its whole document, its file, the folder it may not leave."""

    document: dict
    file: Path | None
    folder: Path | None

    def at(self, target: str) -> tuple[dict, _Place]:
        """The piece a local ``$ref`` points to, and where that lies."""
        if not isinstance(target, str) or re.match("https?:", target):
            raise RecordError(f"only local $ref texts are followed, not {target!r}")
        name, _, pointer = target.partition("#")
        place = self._open(name) if name else self
        piece: object = place.document
        for step in filter(None, pointer.split("/")):
            piece = piece.get(step) if isinstance(piece, dict) else None
        if not isinstance(piece, dict):
            raise RecordError(f"$ref {target!r} points to no contract")
        return piece, place

    def _open(self, name: str) -> _Place:
        if self.file is None or self.folder is None:
            raise RecordError(f"$ref {name!r} names a file, but this contract was not read from one")
        found = (self.file.parent / name).resolve()
        if self.folder not in found.parents:
            raise RecordError(f"$ref {name!r} lies outside {self.folder}")
        return _Place(_load(found), found, self.folder)


def _load(path: Path) -> dict:
    try:
        loaded = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        raise RecordError(f"no contract can be read from {path}: {error}") from error
    if not isinstance(loaded, dict):
        raise RecordError(f"{path} holds no contract: it is not an object")
    return loaded


def resolve(contract: dict, source: str | Path | None = None) -> dict:
    """The contract with local ``$ref`` targets put in place, however deep it nests.

    A target that is met again on the way down from itself has no end and is refused.
    """
    file = Path(source).resolve() if source else None
    start = _Place(contract if file is None else _load(file), file, file and file.parent)

    def expand(piece: dict, place: _Place, trail: tuple[int, ...]) -> dict:
        if "$ref" in piece:
            target, there = place.at(piece["$ref"])
            if id(target) in trail:
                raise RecordError(f"the contract refers to itself by $ref {piece['$ref']!r}")
            return expand(target, there, (*trail, id(target)))
        out = dict(piece)
        children = piece.get("properties")
        if isinstance(children, dict):
            out["properties"] = {n: expand(c, place, trail) for n, c in children.items() if isinstance(c, dict)}
        if isinstance(piece.get("items"), dict):
            out["items"] = expand(piece["items"], place, trail)
        return out

    return expand(contract, start, ())


def _problem(path: Column, rule: str, expected: object, found: Column) -> Column:
    return F.array(
        F.struct(
            path.alias("path"), F.lit(rule).alias("rule"), F.lit(str(expected)).alias("expected"), found.alias("found")
        )
    )


def _none() -> Column:
    return F.array().cast(_VIOLATION)


def _if(broken: Column, problem: Column) -> Column:
    return F.when(broken, problem).otherwise(_none())


def _step(name: str) -> str | None:
    """A key as a step of a path; None for a name that holds both kinds of quotes."""
    if "'" in name and '"' in name:
        return None
    mark = '"' if "'" in name else "'"
    return f"[{mark}{name}{mark}]"


class _Read:
    """The values a contract looks at, each read once per row.

    Values inside objects are read by their whole path: a contract is compiled to one flat table of
    paths and what is asked of them, and every entry becomes a column. Inside lists there is no row to
    keep a column in, so there the expressions stand where they are used.
    """

    def __init__(self, flat: bool = False) -> None:
        self.flat = flat
        self.values: dict[str, Column] = {}
        self.asked: dict[str, Column] = {}
        self.kinds: dict[str, Column] = {}
        self._names: dict[tuple[str, str], str] = {}

    def _kept(self, held: dict[str, Column], steps: str, what: str, c: Column) -> Column:
        if not self.flat:
            return c
        name = self._names.setdefault((steps, what), f"__{len(self._names)}")
        held.setdefault(name, c)
        return F.col(name)

    def value(self, root: Column, steps: str) -> Column:
        if steps == "$":
            return root
        return self._kept(self.values, steps, "value", F.try_variant_get(root, steps, "variant"))

    def ask(self, steps: str, what: str, c: Column) -> Column:
        return self._kept(self.asked, steps, what, c)

    def kind(self, steps: str, v: Column) -> Column:
        if not self.flat:
            return variant_type(v)
        return self._kept(self.kinds, steps, "kind", shape_type(self.ask(steps, "shape", F.schema_of_variant(v))))


def _violations(root: Column, contract: dict, path: Column) -> Column:
    """Problems of a variant that is present."""
    return _all(_checks(root, "$", contract, path, _Read()))


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _checks(root: Column, steps: str, contract: dict, path: Column, read: _Read) -> list[Column]:
    """Problems of the value at ``steps`` below ``root``, one array per rule.

    Only lists nest. An absent value has no problems: a path through anything but objects finds none.
    """
    v = read.value(root, steps)
    present = F.lit(True) if steps == "$" else v.isNotNull()
    kind, shown = read.kind(steps, v), F.to_json(v)
    parts: list[Column] = []
    wanted = contract.get("type")
    fits = present
    if wanted is not None:
        fits = present & kind.isin(*ACCEPTS.get(wanted, ("",)))
        found = F.when(kind == "list", "array").otherwise(kind)
        parts.append(_if(present & ~kind.isin(*ACCEPTS.get(wanted, ("",))), _problem(path, "type", wanted, found)))
    numeric = kind.isin("integer", "number")
    if contract.keys() & {"minimum", "maximum", "enum"}:
        real = read.ask(steps, "real", F.try_variant_get(v, "$", "double"))
    for rule, beyond in (("minimum", lambda b: real < b), ("maximum", lambda b: real > b)):
        if rule in contract:
            parts.append(_if(fits & (~numeric | beyond(contract[rule])), _problem(path, rule, contract[rule], shown)))
    if "enum" in contract:
        allowed = _listed(read.ask(steps, "shown", shown), real, numeric, contract["enum"])
        parts.append(_if(fits & ~allowed, _problem(path, "enum", json.dumps(contract["enum"]), shown)))
    if contract.keys() & {"minLength", "maxLength", "pattern"}:
        words = read.ask(steps, "words", F.try_variant_get(v, "$", "string"))
        is_text = present & (kind == "string")
        for rule, beyond in (
            ("minLength", lambda b: F.length(words) < b),
            ("maxLength", lambda b: F.length(words) > b),
            ("pattern", lambda b: ~F.rlike(words, F.lit(b))),
        ):
            if rule in contract:
                parts.append(_if(is_text & beyond(contract[rule]), _problem(path, rule, contract[rule], shown)))

    if wanted in (None, "object"):
        parts += _inside_object(root, steps, v, fits & (kind == "object"), contract, path, read)
    inner = contract.get("items") if isinstance(contract.get("items"), dict) else None
    if inner or contract.keys() & {"minItems", "maxItems"}:
        elements = read.ask(steps, "elements", F.try_variant_get(v, "$", "array<variant>"))
        is_list = fits & (kind == "list")
        size = F.array_size(elements)
        for rule, beyond in (("minItems", lambda b: size < b), ("maxItems", lambda b: size > b)):
            if rule in contract:
                parts.append(_if(is_list & beyond(contract[rule]), _problem(path, rule, contract[rule], size.cast("string"))))
        if inner:
            place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            each = F.transform(elements, lambda e, i: _violations(e, inner, place(i)))
            parts.append(_if(is_list, F.flatten(each)))
    return parts


def _inside_object(root: Column, steps: str, v: Column, is_object: Column, contract: dict, path: Column, read: _Read) -> list[Column]:
    parts = []
    member = lambda name: F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))
    for name in contract.get("required", ()):
        held = member(name) if _step(name) is None else read.value(root, steps + _step(name))
        parts.append(_if(is_object & held.isNull(), _problem(path, "required", name, F.lit(None).cast("string"))))
    for name, child in (contract.get("properties") or {}).items():
        below = F.concat(path, F.lit(f".{name}"))
        if _step(name) is not None:
            parts += _checks(root, steps + _step(name), child, below, read)
        else:
            inner = F.filter(F.array(member(name)), lambda x: x.isNotNull())
            parts.append(_if(is_object, F.flatten(F.transform(inner, _checker(child, below)))))
    return parts


def _checker(contract: dict, path: Column) -> Callable[[Column], Column]:
    return lambda v: _violations(v, contract, path)


def _listed(shown: Column, real: Column, numeric: Column, allowed: Sequence[object]) -> Column:
    """Membership: numbers by value, everything else by its JSON text."""
    numbers = [float(a) for a in allowed if isinstance(a, (int, float)) and not isinstance(a, bool)]
    texts = [json.dumps(a, separators=(",", ":"), ensure_ascii=False) for a in allowed if isinstance(a, bool) or not isinstance(a, (int, float))]
    by_number = numeric & real.isin(*numbers) if numbers else F.lit(False)
    by_text = shown.isin(*texts) if texts else F.lit(False)
    return F.coalesce(by_number | by_text, F.lit(False))


def contract_violations(
    df: DataFrame, json_column: str, contract: dict, keep: Sequence[str] = (), source: str | Path | None = None
) -> DataFrame:
    """``keep…, path, rule, expected, found``: one row per broken rule.

    Text that is not JSON breaks the rule ``json``. Unlike a check that stops at its first
    problem, all of them are listed; a value of the wrong type is not looked into further.
    """
    plan = resolve(contract, source)
    v = F.try_parse_json(col(json_column))
    parsed = df.select(*[col(k) for k in keep], col(json_column).alias("__text"), v.alias("__v"))
    unreadable = _problem(F.lit("$"), "json", "valid JSON", F.col("__text"))
    read = _Read(flat=True)
    problems = F.when(F.col("__v").isNull(), unreadable).otherwise(_all(_checks(F.col("__v"), "$", plan, F.lit("$"), read)))
    for columns in (read.values, read.asked, read.kinds):
        parsed = parsed.withColumns(columns)
    # A column first: a projection is compiled in small methods, a long generator is interpreted row by row. The
    # generator must not read the bare column, or Spark tests its size below, which computes it all again.
    found = parsed.select(*[col(k) for k in keep], problems.alias("__problems"))
    return found.select(*[col(k) for k in keep], F.inline(F.coalesce("__problems", _none())))


def check_contract(df: DataFrame, json_column: str, contract: dict, source: str | Path | None = None) -> DataFrame:
    """``path, rule, rows`` of the broken rules, list positions folded into ``[]``."""
    found = contract_violations(df, json_column, contract, source=source)
    place = F.regexp_replace("path", r"\[\d+\]", "[]")
    return found.groupBy(place.alias("path"), "rule").agg(F.count("*").alias("rows"))


def assert_contract(df: DataFrame, json_column: str, contract: dict, source: str | Path | None = None) -> DataFrame:
    first = contract_violations(df, json_column, contract, source=source).limit(1).collect()
    if first:
        p = first[0]
        raise GateFailed(f"{p.path}: {p.rule} expected {p.expected}, found {p.found}")
    return df


def _node(path: Column, parent: Column, key: Column, v: Column) -> Column:
    return F.struct(
        path.alias("path"), parent.cast("string").alias("parent"), key.cast("string").alias("key"), v.alias("v")
    )


def _children(nodes: Column) -> Column:
    """The nodes one level below a list of nodes."""

    def below(n: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>"))
        items = F.try_variant_get(n["v"], "$", "array<variant>")
        return F.coalesce(
            F.transform(fields, lambda e: _node(F.concat(n["path"], F.lit("."), e["key"]), n["path"], e["key"], e["value"])),
            F.transform(items, lambda x: _node(F.concat(n["path"], F.lit("[]")), n["path"], F.lit(None), x)),
            F.filter(F.array(n), lambda _: F.lit(False)),
        )

    return F.flatten(F.transform(nodes, below))


def observed_paths(df: DataFrame, json_column: str, max_depth: int | None = None) -> DataFrame:
    """``path, parent, key, type, n``: how often each type occurs at each path, at every depth.

    A pass lists ``LEVELS`` levels of a row inside its task, and only counts per (path, type) are
    shuffled. What lies deeper is written aside and listed by the next pass, so the frame takes as
    many jobs as the deepest value needs. ``max_depth`` stops at a level on purpose.
    """
    nodes = df.select(F.try_parse_json(col(json_column)).alias("v")).filter(F.col("v").isNotNull()).select(
        _node(F.lit("$"), F.lit(None), F.lit(None), F.col("v")).alias("node")
    )
    found, left = None, max_depth
    while True:
        size = min(LEVELS, left or LEVELS)
        levels = nodes.select(F.array("node").alias("l0"))
        for depth in range(size):
            levels = levels.withColumn(f"l{depth + 1}", _children(F.col(f"l{depth}")))
        seen = Observation()
        listed = levels.observe(seen, F.coalesce(F.sum(F.size(f"l{size}")), F.lit(0)).alias("below"))
        listed = listed.select(F.inline(F.concat(*[F.col(f"l{d}") for d in range(size)])))
        typed = listed.select("path", "parent", "key", variant_type(F.col("v")).alias("type"))
        counts = stage(typed.groupBy("path", "parent", "key", "type").agg(F.count("*").alias("n")), "paths")
        found = counts if found is None else found.unionByName(counts)
        left = None if left is None else left - size
        if left == 0 or not observed_or(seen, {"below": 0})["below"]:
            return found.groupBy("path", "parent", "key", "type").agg(F.sum("n").alias("n"))
        texts = levels.select(F.inline(f"l{size}")).withColumn("v", F.to_json("v"))
        deeper = stage(texts, "deeper")
        nodes = deeper.select(_node(F.col("path"), F.col("parent"), F.col("key"), F.parse_json("v")).alias("node"))


def generate(df: DataFrame, json_column: str, max_paths: int = MAX_PATHS) -> dict:
    """A candidate contract for the values of a JSON column.

    Required are the keys every object at that place has; mixed types are left open. The contract
    is a driver-side object: more than ``max_paths`` paths are refused, never cut.
    """
    rows = observed_paths(df, json_column).limit(max_paths + 1).collect()
    if len(rows) > max_paths:
        raise RecordError(f"more than {max_paths} distinct paths; the objects are maps with open keys")
    kinds: dict[str, dict[str, int]] = {}
    children: dict[str, dict[str | None, str]] = {}
    for r in rows:
        kinds.setdefault(r.path, {})[r.type] = r.n
        if r.parent is not None:
            children.setdefault(r.parent, {})[r.key] = r.path

    def build(path: str) -> dict:
        seen = kinds[path]
        if len(seen) != 1:
            return {}
        kind, n = next(iter(seen.items()))
        if kind == "object":
            below = {k: p for k, p in children.get(path, {}).items() if k is not None}
            return {
                "type": "object",
                "required": sorted(k for k, p in below.items() if sum(kinds[p].values()) == n),
                "properties": {k: build(below[k]) for k in sorted(below)},
            }
        if kind == "list":
            inner = children.get(path, {}).get(None)
            return {"type": "array", "items": build(inner)} if inner else {"type": "array"}
        return {"type": kind}

    return build("$") if "$" in kinds else {}
