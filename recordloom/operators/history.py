"""Questions about a history of runs, their steps, tags and ports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.errors import RecordError
from recordloom.operators import ordering, ranking, trigrams
from recordloom.operators.schema import col

# The fields a difference of two runs is made of, in order of importance.
DIFF_FIELDS = (
    "status", "exit_code", "steps_run", "steps_failed", "steps_skipped", "cache_hits", "retries", "duration_ms",
)
CANDIDATES = 5


def recent(
    runs: DataFrame, limit: int = 20, workflow: str | None = None, time: str = "started_at", tie: str = "id"
) -> DataFrame:
    """The newest runs; Spark keeps ``limit`` per task and merges those."""
    kept = runs if workflow is None else runs.filter(col("workflow") == workflow)
    return kept.orderBy(col(time).desc(), col(tie).desc()).limit(limit)


def find(runs: DataFrame, identifier: str) -> DataFrame:
    """The run with this id or name, or the only one whose id or name starts with it."""
    exact = runs.filter((col("id") == identifier) | (col("name") == identifier)).limit(1)
    if not exact.isEmpty():
        return exact
    start = identifier.replace("\\", "\\\\") + "%"
    matches = runs.filter(F.ilike(col("id"), F.lit(start)) | F.ilike(col("name"), F.lit(start)))
    ids = [r.id for r in matches.select("id").limit(CANDIDATES + 1).collect()]
    if len(ids) == 1:
        return matches
    if ids:
        raise RecordError(f"{identifier!r} could be any of {', '.join(map(str, ids[:CANDIDATES]))}")
    raise RecordError(f"{identifier!r} is neither an id nor a name, nor the start of one")


def search(
    runs: DataFrame, tags: DataFrame, steps: DataFrame, text: str, limit: int | None = 20,
    time: str = "started_at", tie: str = "id", index: str | None = None,
) -> DataFrame:
    """Runs whose name, workflow, mode, a tag or a step error mentions the text, newest first.

    Each table is filtered on its own; only the ids that matched meet the runs, as a
    semi-join, so no run is repeated and nothing is deduplicated afterwards. With the path of an
    ``index`` that ``index_history`` keeps, only rows of the ids that can match are compared; texts
    of fewer than three characters are in no index and read all rows. The answer is the same.
    """
    able = trigrams.candidates(runs.sparkSession, index, text) if index is not None else None
    if able is not None:
        runs, tags, steps = trigrams.among(runs, "id", able), trigrams.among(tags, "run_id", able), trigrams.among(steps, "run_id", able)
    like = F.lit("%" + text.replace("\\", "\\\\") + "%")
    ids = (
        runs.filter(F.ilike("name", like) | F.ilike("workflow", like) | F.ilike("mode", like)).select(F.col("id").alias("__id"))
        .unionByName(tags.filter(F.ilike("tag", like)).select(F.col("run_id").alias("__id")))
        .unionByName(steps.filter(F.ilike("error", like)).select(F.col("run_id").alias("__id")))
        .distinct()
    )
    found = runs.join(ids, runs["id"] == ids["__id"], "left_semi").orderBy(col(time).desc(), col(tie).desc())
    return found.limit(limit) if limit is not None else found


def index_history(runs: DataFrame, tags: DataFrame, steps: DataFrame, path: str) -> None:
    """Add the texts ``search`` compares to the trigram index at ``path``; call it with the new rows of each table."""
    parts = [(runs, "id", c) for c in ("name", "workflow", "mode")] + [(tags, "run_id", "tag"), (steps, "run_id", "error")]
    texts = [df.select(col(key).alias("key"), col(text).alias("text")) for df, key, text in parts]
    trigrams.add(reduce(DataFrame.unionByName, texts), path)


def retention_by_count(
    runs: DataFrame, keep: int, time: str = "started_at", tie: str = "id", pinned: str | None = "pinned",
    scope: Sequence[str] = (),
) -> DataFrame:
    """Runs to drop: all but the newest ``keep``, per scope; pinned ones are exempt and not counted.

    Exactly ``keep`` runs stay, also among ties, which go by arrival; a null time is the oldest. The
    last run that stays is found by counting (per scope: by its times alone) and the others are filtered
    against it, so neither a large ``keep`` nor a scope that holds most of the runs moves the rows.
    """
    free = runs if pinned is None else runs.filter(~F.coalesce(col(pinned).cast("boolean"), F.lit(False)))
    down = [time, tie]
    return ranking.behind_within(free, scope, down, keep, down) if scope else ranking.behind(free, down, keep, down)


def retention_by_size(
    entries: DataFrame, cap: int, now: Column, size: str = "bytes", accessed: str = "accessed",
    expires: str | None = "expires", tie: str = "key",
) -> DataFrame:
    """Entries with ``verdict``: expired, evicted or kept.

    Expired entries go first; then those least recently used, until the rest fits ``cap``.
    That is a running total from the most recent entry, computed over many chunks.
    """
    out = F.lit(False) if expires is None else F.coalesce(col(expires) <= now, F.lit(False))
    marked = entries.withColumn("__expired", out)
    live = marked.filter("not __expired").drop("__expired")
    rows = ordering.sequence_rows(live, [], [accessed, tie], descending=True, unique=True)
    summed = ordering.running_sum(rows, [], "__total", col(size))
    verdict = F.when(F.col("__total") > cap, "evicted").otherwise("kept").alias("verdict")
    kept = summed.select(*[col(c) for c in entries.columns], verdict)
    gone = marked.filter("__expired").select(*[col(c) for c in entries.columns], F.lit("expired").alias("verdict"))
    return kept.unionByName(gone)


def canonical_path(path: Column) -> Column:
    """A path without empty and ``.`` steps, with ``..`` taken back; the scheme, host or root stay."""
    head = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*/?|/?)", 1)
    steps = F.filter(F.split(F.substring(path, F.length(head) + 1, F.length(path)), "/"), lambda x: ~x.isin("", "."))

    def walk(seen: Column, step: Column) -> Column:
        back = (step == "..") & (F.size(seen) > 0) & ~F.coalesce(F.try_element_at(seen, F.lit(-1)) == "..", F.lit(False))
        held = F.when((step == "..") & (F.size(seen) == 0) & F.endswith(head, F.lit("/")), seen).otherwise(F.concat(seen, F.array(step)))
        return F.when(back, F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(held)

    return F.concat(head, F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/"))


def producers_of(
    ports: DataFrame, runs: DataFrame, path: str, digest: str | None = None, time: str = "started_at"
) -> DataFrame:
    """Runs recorded as having written ``path``, newest first; ``changed`` against a digest.

    Paths are compared in canonical form, so ``out/./a`` and ``out/a`` are one.
    """
    written = ports.filter((col("direction") == "out") & (canonical_path(col("path")) == canonical_path(F.lit(path))))
    named = runs.select(F.col("id").alias("run_id"), F.col("name").alias("run_name"), col(time))
    changed = F.lit(None).cast("boolean") if digest is None else ~col("digest").eqNullSafe(F.lit(digest))
    return (
        written.join(named, "run_id").withColumn("changed", changed).orderBy(col(time).desc(), col("run_id").desc())
    )


def run_diff(runs: DataFrame, left_id: object, right_id: object, fields: Sequence[str] = DIFF_FIELDS) -> DataFrame:
    """``field, before, after, comparable`` of what changed between two runs.

    Comparable means the same workflow in the same environment.
    """
    kept = [n for n in dict.fromkeys([*fields, "workflow", "env"]) if n in runs.columns]
    pair = runs.filter(col("id").isin(left_id, right_id)).agg(
        *[F.max_by(F.struct(*[col(n) for n in kept]), F.when(col("id") == wanted, 1)).alias(side) for side, wanted in (("a", left_id), ("b", right_id))]
    )
    cell = lambda side, n: F.col(side)[n].cast("string")
    comparable = F.lit(True)
    for n in ("workflow", "env"):
        if n in runs.columns:
            comparable = comparable & cell("a", n).eqNullSafe(cell("b", n))
    lines = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(n).alias("field"), cell("a", n).alias("before"), cell("b", n).alias("after"))
            for i, n in enumerate(fields)
            if n in runs.columns
        ]
    )
    return (
        pair.select(F.inline(lines), comparable.alias("comparable"))
        .filter(~F.col("before").eqNullSafe(F.col("after")))
        .select("field", "before", "after", "comparable")
    )


def run_report(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Per run: ``steps, failed, attempts, measured, duration_ms``; a zero duration is unknown."""
    known = F.nullif(F.col("duration_ms"), F.lit(0))
    per_run = steps.groupBy("run_id").agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("attempts").alias("attempts"),
        F.count(known).alias("measured"),
        F.sum(known).alias("duration_ms"),
    )
    named = runs.select(F.col("id").alias("run_id"), "name", "workflow", "status")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("steps", "failed", "attempts", "measured")}
    return named.join(per_run, "run_id", "left").withColumns(zero)


def outage_intervals(
    requests: DataFrame, host: str, time: str, ok: str, tie: str, threshold: int = 5,
    reset_after: float | None = None,
) -> DataFrame:
    """``host, failures, first_failure, opened_at, closed_at`` of each run of failures.

    An outage opens at the ``threshold``-th failure in a row and closes at the next success.
    ``reset_after`` seconds add ``probe_at``, when a host still out may be tried again.
    Every row is tied to the last success before it by a running maximum that is carried
    across chunks, so one busy host is worked on by many tasks.
    """
    rows = ordering.sequence_rows(requests.select(host, time, tie, ok), [host], [time, tie], unique=True)
    numbered = ordering.running_sum(rows, [host], "__n", F.lit(1))
    spanning = ordering.running_sum(ordering.spanning_rows(rows, [host]), [host], "__n", F.lit(1))
    good = F.coalesce(col(ok), F.lit(False))
    since = ordering.running_max(numbered, [host], "__since", F.when(good, F.col("__n")), inclusive=False, source=spanning)
    since = since.withColumn("__since", F.coalesce("__since", F.lit(0)))
    streaks = since.groupBy(col(host), F.col("__since")).agg(
        F.count_if(~good).alias("failures"),
        F.min(F.when(~good, col(time))).alias("first_failure"),
        F.max(F.when(~good & (F.col("__n") - F.col("__since") == threshold), col(time))).alias("opened_at"),
        F.max(F.when(good, col(time))).alias("closed_at"),
    )
    found = streaks.filter(F.col("failures") >= threshold).drop("__since")
    if reset_after is None:
        return found
    probe = F.col("opened_at") + F.make_dt_interval(secs=F.lit(reset_after).cast("decimal(18,6)"))
    return found.withColumn("probe_at", F.when(F.col("closed_at").isNull() | (F.col("closed_at") > probe), probe))


def latency_flatness(
    requests: DataFrame, host: str, order_by: Sequence[str], latency: str, window: int = 32, tolerance: float = 1.2
) -> DataFrame:
    """``host, samples, older_p95, newer_p95, flat`` over the last ``window`` requests per host.

    Flat: the newer half's p95 is at most ``tolerance`` times the older half's.
    """
    last = ordering.top_k(requests.select(host, latency, *order_by), [host], order_by, window)
    half = window // 2
    newer = F.sort_array(F.collect_list(F.when(F.col("rank") <= window - half, col(latency).cast("double"))))
    older = F.sort_array(F.collect_list(F.when(F.col("rank") > window - half, col(latency).cast("double"))))
    p95 = lambda a: F.get(a, F.least(F.array_size(a) - 1, F.floor(F.array_size(a) * 0.95).cast("int")))
    grouped = last.groupBy(col(host)).agg(F.count("*").alias("samples"), older.alias("o"), newer.alias("w"))
    flat = (F.col("samples") >= window) & (p95(F.col("w")) <= p95(F.col("o")) * tolerance)
    return grouped.select(
        col(host), "samples", p95(F.col("o")).alias("older_p95"), p95(F.col("w")).alias("newer_p95"),
        F.coalesce(flat, F.lit(False)).alias("flat"),
    )
