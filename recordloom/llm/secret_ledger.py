"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a document is a path to a blob, named by the SHA-256 of its text. The ledger
holds, per blob, which rule versions have read it and what they found. A run scans a blob only
for the rule versions that have not read it yet, however many paths lead there, and joins the
findings back to all paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.blocks import let, running, without
from recordloom.session import stage


@dataclass(frozen=True)
class Rule:
    """A pattern (Java's syntax), the group whose length counts, and that length's least value."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds and patterns in the order in which spans of one start are listed. Runs shorter
# than the least length end where their longer forms would, so the length can stand in the pattern
# of access and hex; of assign it is counted after the match.
BASE = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# A private key runs from its first line to its last, or where that is missing over header fields and
# base64 lines (also indented, quoted or with written-out line ends) to the last of these. Groups that
# repeat give nothing back (the plus behind their star): each text fits them in one way, and Java's
# matcher then walks them in a loop of constant depth, over any number of lines. The first word of a
# header field is shorter than a base64 line, so that neither can be taken for the other.
_LABEL = r"[A-Z ]*PRIVATE KEY-----"
_GAP = r"""[ \t\r\n\\"'+>#*|,]*"""
_TO_END = rf"[^-]*(?:-{{1,4}}[^-]+)*+-----END {_LABEL}"
_FIELDS = rf"(?:{_GAP}n?[A-Z][A-Za-z]{{1,13}}-[A-Z][A-Za-z]+:[ \t]*[^ \t\r\n\\]+[ \t\r\n\\])*+"
_LINES = rf"(?:{_GAP}{'[A-Za-z0-9+/]{4}' * 4}[A-Za-z0-9+/]*={{0,2}})++"
_SHORT = rf"""(?:{_GAP}[A-Za-z0-9+/]+(?:={{1,2}}|[ \t\r"']*(?:\n|$)))?"""
MORE = (
    Rule("pem", rf"-----BEGIN {_LABEL}(?:{_TO_END}|{_FIELDS}{_LINES}{_SHORT})?", version=3),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE
#: Rules of an earlier day: the first version of pem marked the first line of a key, and two kinds were not known.
EARLIER = BASE + (Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),)

FOUND = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


def blob_of(text: Column) -> Column:
    """The address of a text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _none() -> Column:
    return F.from_json(F.lit("[]"), FOUND)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches as (start, rank, kind, stop), in code points.

    What lies between matches is what ``split`` returns, so running lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), held.alias("held"))
    long = lambda x, name: F.coalesce(F.length(x), F.lit(0)).cast("long").alias(name)
    sizes = F.transform(parts, lambda x: F.struct(long(x["gap"], "gap"), long(x["hit"], "size"), long(x["held"], "held"), x["hit"].isNotNull().alias("hit")))

    def span(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        made = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("stop"))
        return F.when(x["hit"] & (x["held"] >= rule.least), made)

    def placed(of: Column) -> Column:
        return F.array_compact(F.zip_with(of, running(F.transform(of, lambda x: x["gap"] + x["size"])), span))

    return F.when(F.regexp_like(text, F.lit(rule.pattern)), let(sizes, placed)).otherwise(_none())


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, body, rules to run)."""
    found = [F.when(F.array_contains("todo", rule.key), _spans(F.col("body"), rule, i)) for i, rule in enumerate(rules)]
    return blobs.select("blob", F.col("todo").alias("rules"), F.flatten(F.array(*[F.coalesce(x, _none()) for x in found])).alias("found"))


def unseen(docs: DataFrame, ledger: DataFrame | None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob that some rule version has not read: blob, body, todo.

    Copies meet before the shuffle: each task sends one body per blob.
    """
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    blobs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).select(blob_of(F.col("body")).alias("blob"), "body")
    blobs = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    todo = F.array_except(wanted, F.coalesce(F.col("known"), F.array().cast("array<string>")))
    return blobs.join(known, "blob", "left").select("blob", "body", todo.alias("todo")).filter(F.size("todo") > 0)


def scan_documents(
    docs: DataFrame, ledger: DataFrame | None = None, keep: list[str] | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the ledger rows this run adds.

    The first frame has one row per input row: ``keep`` columns (default ``doc_id``), ``blob``,
    ``found``, the spans of the given rules by start, then rule order, and ``n_scanned``, how many
    rules this run applied to the blob. Append the second frame to the ledger before the next run;
    it is written once, so the join back reads short rows and can split a blob that many paths
    share. A null text is the empty blob; repeated rows are paths to one blob; rows that the ledger
    repeats count once; empty inputs give empty frames; columns not named are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    new = stage(scan(unseen(docs, ledger, text, rules), rules), "ledger")
    seen = new.select("blob", "found", F.size("rules").alias("n_scanned"))
    if ledger is not None:
        # What an older version of a rule found does not count; the ledger may number its rules in another order.
        rank = F.create_map(*[x for i, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(i))])
        current = F.array_compact(F.array(*[F.when(F.array_contains("rules", rule.key), F.lit(rule.kind)) for rule in rules]))
        valid = F.filter("found", lambda x: F.array_contains(F.col("current"), x["kind"]))
        ranked = F.transform(valid, lambda x: F.struct(x["start"], F.element_at(rank, x["kind"]).alias("rank"), x["kind"], x["stop"]))
        known = ledger.select("blob", "found", current.alias("current")).select("blob", ranked.alias("found"), F.lit(0).alias("n_scanned"))
        hits = F.array_sort(F.flatten(F.collect_list("found")))
        seen = known.unionByName(seen).groupBy("blob").agg(hits.alias("found"), F.sum("n_scanned").cast("int").alias("n_scanned"))
        seen = seen.withColumn("found", let(F.col("found"), lambda of: F.filter(of, lambda x, i: ~x.eqNullSafe(F.get(of, i - 1)))))
    seen = seen.filter((F.size("found") > 0) | (F.col("n_scanned") != len(rules)))
    paths = docs.select(*[F.col(f"`{c}`") for c in keep], blob_of(F.col(text)).alias("blob"))
    joined = paths.join(seen, "blob", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in keep], "blob", F.array_sort(F.coalesce("found", _none())).alias("found"),
        F.coalesce("n_scanned", F.lit(len(rules))).alias("n_scanned"),
    ), new


def listed(found: Column) -> Column:
    """Spans as comma-joined kind:start:stop."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _of(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def summary(findings: DataFrame) -> DataFrame:
    """Counts, digest and list of spans per path, and how many rules were applied to its blob in this run."""
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("found", _of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return findings.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "n_scanned")


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every found span masked; overlapping spans are masked together."""
    return without(text, found, mask)
