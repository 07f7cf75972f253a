"""Run-history questions, with the events as the history."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import control, history
from recordloom.plans import Tables, query
from recordloom.session import scratch


def runs(t: Tables) -> DataFrame:
    """One run per event: its kind is the workflow, its user the environment."""
    failed = F.col("event_type") == "error"
    return t.events.select(
        F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("id"),
        F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("name"),
        F.col("event_type").alias("workflow"),
        F.when(F.col("value") > 50, "full").otherwise("Quick").alias("mode"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("env"),
        F.col("ts").alias("started_at"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(failed, 1).otherwise(0).alias("exit_code"),
        F.get_json_object("props", "$.k").cast("int").alias("steps_run"),
        F.when(failed, 1).otherwise(0).alias("steps_failed"),
        F.floor(F.col("value") / 10).alias("retries"),
        F.floor(F.col("value") * 10).alias("duration_ms"),
        (F.col("value") > 100).alias("pinned"),
    )


_RUNS = """
WITH runs AS (SELECT 'r' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, event_type || '-' || event_id AS name, event_type AS workflow,
  CASE WHEN value > 50 THEN 'full' ELSE 'Quick' END AS mode, 'user' || user_id AS env, ts AS started_at,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, CAST(event_type = 'error' AS INTEGER) AS exit_code,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS steps_run, CAST(event_type = 'error' AS INTEGER) AS steps_failed,
  CAST(floor(value / 10) AS BIGINT) AS retries, CAST(floor(value * 10) AS BIGINT) AS duration_ms, value > 100 AS pinned
  FROM events)
"""


def _entries(t: Tables) -> DataFrame:
    """Stored values: one per event, sized by its value; errors have expired."""
    return t.events.select(
        F.col("event_id").alias("key"), F.floor(F.col("value") * 1000).alias("bytes"), F.col("ts").alias("accessed"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("expires"),
    )


@query(_RUNS + "SELECT id, workflow, started_at FROM runs WHERE workflow = 'purchase' ORDER BY started_at DESC, id DESC LIMIT 20")
def recent_runs(t: Tables) -> DataFrame:
    return history.recent(runs(t), 20, "purchase").select("id", "workflow", "started_at")


@query(_RUNS + "SELECT id, name FROM runs WHERE id IN ('r000000000100', 'r000000000101')")
def find_prefix(t: Tables) -> DataFrame:
    """One run by its exact id, one by a prefix in other letters."""
    made = runs(t)
    return history.find(made, "r000000000100").unionByName(history.find(made, "R000000000101")).select("id", "name")


@query(_RUNS + """
, tags AS (SELECT 'r' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, 'k' || json_extract_string(props, '$.k') AS tag FROM events)
, steps AS (SELECT 'r' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, 'timeout after ' || json_extract_string(props, '$.k') AS error FROM events WHERE event_type = 'error')
SELECT id, workflow FROM runs WHERE name ILIKE '%K9%' OR workflow ILIKE '%K9%' OR mode ILIKE '%K9%'
   OR id IN (SELECT run_id FROM tags WHERE tag ILIKE '%K9%') OR id IN (SELECT run_id FROM steps WHERE error ILIKE '%K9%')
""")
def search_runs(t: Tables) -> DataFrame:
    return history.search(*_history(t), "K9", limit=None).select("id", "workflow")


def _history(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, a tag for each and the error of those that failed."""
    k = F.get_json_object("props", "$.k")
    run_id = F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id")
    tags = t.events.select(run_id, F.concat(F.lit("k"), k).alias("tag"))
    steps = t.events.filter("event_type = 'error'").select(run_id, F.concat(F.lit("timeout after "), k).alias("error"))
    return runs(t), tags, steps


_MENTIONS = """
  SELECT '{0}' AS needle, id FROM runs WHERE name ILIKE '%{0}%' OR workflow ILIKE '%{0}%' OR mode ILIKE '%{0}%'
    OR 'k' || steps_run ILIKE '%{0}%' OR (workflow = 'error' AND 'timeout after ' || steps_run ILIKE '%{0}%')"""


@query(_RUNS + " UNION ALL ".join(_MENTIONS.format(needle) for needle in ("click-1", "TER 1", "ror-%5", "k9")))
def search_indexed(t: Tables) -> DataFrame:
    """Four searches through one trigram index, kept in two loads; the last text is too short for it."""
    made, tags, steps = _history(t)
    path = scratch(t.spark, "trigrams")
    early = F.col("id") < "r000000000500", F.col("run_id") < "r000000000500"
    history.index_history(made.filter(early[0]), tags.filter(early[1]), steps.filter(early[1]), path)
    history.index_history(made.filter(~early[0]), tags.filter(~early[1]), steps.filter(~early[1]), path)
    found = [history.search(made, tags, steps, n, None, index=path).select(F.lit(n).alias("needle"), "id") for n in ("click-1", "TER 1", "ror-%5", "k9")]
    return reduce(DataFrame.unionByName, found)


@query(_RUNS + """
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY started_at DESC, id DESC) AS n FROM runs WHERE NOT pinned) WHERE n > 500
""")
def retention_by_count(t: Tables) -> DataFrame:
    return history.retention_by_count(runs(t), 500).select("id")


@query(_RUNS + """
SELECT id, workflow FROM (SELECT id, workflow, row_number() OVER (PARTITION BY workflow ORDER BY started_at DESC, id DESC) AS n FROM runs WHERE NOT pinned) WHERE n > 50
""")
def retention_by_scope(t: Tables) -> DataFrame:
    return history.retention_by_count(runs(t), 50, scope=["workflow"]).select("id", "workflow")


@query(_RUNS + """
, r AS (SELECT workflow, date_trunc('day', started_at) AS day, count(*) AS n FROM runs WHERE NOT pinned GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER (PARTITION BY workflow ORDER BY day DESC) AS upto FROM r)
SELECT workflow, day, CAST(n - greatest(0, least(n, 50 - (upto - n))) AS BIGINT) AS dropped FROM c WHERE n > greatest(0, least(n, 50 - (upto - n)))
""")
def retention_ties(t: Tables) -> DataFrame:
    """Runs known to the day only: exactly fifty of a workflow stay, however many tie."""
    coarse = runs(t).withColumn("day", F.date_trunc("day", "started_at").cast("timestamp_ntz")).withColumn("one", F.lit(1))
    gone = history.retention_by_count(coarse, 50, time="day", tie="one", scope=["workflow"])
    return gone.groupBy("workflow", "day").agg(F.count("*").alias("dropped"))


@query(_RUNS + """
, r AS (SELECT id, CASE WHEN hash_key % 3 > 0 THEN started_at END AS moment FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS hash_key FROM runs WHERE NOT pinned))
SELECT id FROM (SELECT id, row_number() OVER (ORDER BY moment DESC NULLS LAST, id DESC) AS n FROM r) WHERE n > 700
""")
def retention_null_times(t: Tables) -> DataFrame:
    """A third of the runs have no time: they count as the oldest."""
    number = F.substring("id", 2, 20).cast("bigint")
    holed = runs(t).withColumn("started_at", F.when(number % 3 > 0, F.col("started_at")))
    return history.retention_by_count(holed, 700).select("id")


@query("""
WITH e AS (SELECT event_id AS key, CAST(floor(value * 1000) AS BIGINT) AS bytes, ts AS accessed, event_type = 'error' AND ts <= TIMESTAMP '2024-01-20' AS gone FROM events),
     s AS (SELECT key, sum(bytes) OVER (ORDER BY accessed DESC, key DESC) AS total FROM e WHERE NOT gone)
SELECT key, 'expired' AS verdict FROM e WHERE gone UNION ALL SELECT key, CASE WHEN total > 50000000 THEN 'evicted' ELSE 'kept' END FROM s
""")
def retention_by_size(t: Tables) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return history.retention_by_size(_entries(t), 50_000_000, now).select("key", "verdict")


@query(_RUNS + """
, ports AS (SELECT 'r' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id, 'out/' || user_id || '.csv' AS path, md5(props) AS digest, CASE WHEN event_type = 'view' THEN 'in' ELSE 'out' END AS direction FROM events)
SELECT run_id, runs.name AS run_name, digest <> md5('{"k": 5}') AS changed FROM ports JOIN runs ON runs.id = run_id WHERE direction = 'out' AND path = 'out/7.csv'
""")
def producers_of(t: Tables) -> DataFrame:
    ports = t.events.select(
        F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id"),
        F.concat(F.lit("out/"), F.col("user_id").cast("string"), F.lit(".csv")).alias("path"),
        F.md5("props").alias("digest"),
        F.when(F.col("event_type") == "view", "in").otherwise("out").alias("direction"),
    )
    current = hashlib.md5(b'{"k": 5}').hexdigest()
    made = history.producers_of(ports, runs(t), "out/7.csv", digest=current)
    return made.select("run_id", "run_name", "changed")


@query(_RUNS + """
, a AS (SELECT * FROM runs WHERE id = (SELECT min(id) FROM runs)), b AS (SELECT * FROM runs WHERE id = (SELECT max(id) FROM runs)),
  f AS (SELECT unnest(['status', 'exit_code', 'steps_run', 'steps_failed', 'retries', 'duration_ms']) AS field,
          unnest([a.status, CAST(a.exit_code AS VARCHAR), CAST(a.steps_run AS VARCHAR), CAST(a.steps_failed AS VARCHAR), CAST(a.retries AS VARCHAR), CAST(a.duration_ms AS VARCHAR)]) AS before,
          unnest([b.status, CAST(b.exit_code AS VARCHAR), CAST(b.steps_run AS VARCHAR), CAST(b.steps_failed AS VARCHAR), CAST(b.retries AS VARCHAR), CAST(b.duration_ms AS VARCHAR)]) AS after,
          a.workflow = b.workflow AND a.env = b.env AS comparable FROM a, b)
SELECT field, before, after, comparable FROM f WHERE before IS DISTINCT FROM after
""")
def run_diff(t: Tables) -> DataFrame:
    made = runs(t)
    ends = made.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    return history.run_diff(made, ends["first"], ends["last"])


@query("""
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS name, o_orderstatus AS status FROM orders),
     s AS (SELECT CAST(l_orderkey AS VARCHAR) AS run_id, l_returnflag = 'R' AS bad, l_linenumber AS attempts, CASE WHEN l_tax > 0 THEN CAST(l_quantity AS BIGINT) END AS ms FROM lineitem)
SELECT r.run_id, r.name, r.status, count(s.run_id) AS steps, count(*) FILTER (bad) AS failed, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts,
       count(ms) AS measured, CAST(sum(ms) AS BIGINT) AS duration_ms
FROM r LEFT JOIN s USING (run_id) GROUP BY ALL
""")
def run_report(t: Tables) -> DataFrame:
    """Orders as runs, their lines as steps; a line without tax was never measured."""
    made = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("name"),
        F.lit("order").alias("workflow"), F.col("o_orderstatus").alias("status"),
    )
    steps = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("run_id"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"),
        F.col("l_linenumber").alias("attempts"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity").cast("long")).otherwise(0).alias("duration_ms"),
    )
    return history.run_report(made, steps).drop("workflow")


@query("""
WITH n AS (SELECT user_id, ts, event_id, value > 20 AS ok, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     s AS (SELECT *, coalesce(max(CASE WHEN ok THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM n)
SELECT *, CASE WHEN closed_at IS NULL OR closed_at > opened_at + INTERVAL 30 SECOND THEN opened_at + INTERVAL 30 SECOND END AS probe_at FROM (
  SELECT user_id, count(*) FILTER (NOT ok) AS failures, min(ts) FILTER (NOT ok) AS first_failure,
         max(ts) FILTER (NOT ok AND n - since = 5) AS opened_at, max(ts) FILTER (ok) AS closed_at
  FROM s GROUP BY user_id, since HAVING count(*) FILTER (NOT ok) >= 5)
""")
def outage_intervals(t: Tables) -> DataFrame:
    """Users as hosts; a request fails when its value is at most 20."""
    requests = t.events.select("user_id", "ts", "event_id", (F.col("value") > 20).alias("ok"))
    return history.outage_intervals(requests, "user_id", "ts", "ok", "event_id", reset_after=30)


@query("""
WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events),
     h AS (SELECT user_id, count(*) AS samples, list_sort(list(value) FILTER (n > 16)) AS o, list_sort(list(value) FILTER (n <= 16)) AS w FROM l WHERE n <= 32 GROUP BY 1)
SELECT user_id, samples, o[CAST(least(len(o) - 1, floor(len(o) * 0.95)) AS BIGINT) + 1] AS older_p95, w[CAST(least(len(w) - 1, floor(len(w) * 0.95)) AS BIGINT) + 1] AS newer_p95,
       coalesce(samples >= 32 AND w[CAST(least(len(w) - 1, floor(len(w) * 0.95)) AS BIGINT) + 1] <= o[CAST(least(len(o) - 1, floor(len(o) * 0.95)) AS BIGINT) + 1] * 1.2::DOUBLE, false) AS flat
FROM h
""")
def latency_flatness(t: Tables) -> DataFrame:
    return history.latency_flatness(t.events, "user_id", ["ts", "event_id"], "value")


@query("""
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS index, event_type || '#' || (row_number() OVER (ORDER BY ts, event_id) - 1) AS label FROM events
""")
def map_rows_collect(t: Tables) -> DataFrame:
    label = F.concat(F.col("event_type"), F.lit("#"), F.col("index").cast("string"))
    rows = t.events.select("event_id", "event_type", "ts")
    return control.map_rows(rows, {"label": label}, ["event_id"], "index", ["ts", "event_id"], unique=True)


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def map_entries(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return control.entries(rows, "props", ["event_id"])


@query("""
WITH RECURSIVE r AS (SELECT o_orderkey, o_totalprice AS total, 0 AS turn FROM orders
  UNION ALL SELECT o_orderkey, total * 0.5::DOUBLE, turn + 1 FROM r WHERE total > 50000)
SELECT o_orderkey, arg_max(total, turn) AS total FROM r GROUP BY o_orderkey
""")
def iterate_until(t: Tables) -> DataFrame:
    """Totals above 50 000 are halved, pass by pass, until none is left."""
    step = lambda df: df.withColumn("total", F.when(F.col("total") > 50000, F.col("total") * 0.5).otherwise(F.col("total")))
    done = lambda df: df.filter("total > 50000").isEmpty()
    return control.iterate(t.orders.select("o_orderkey", F.col("o_totalprice").alias("total")), step, done, 50, cut_every=3)
