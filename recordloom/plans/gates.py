"""Data-quality checks as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import contracts, quality, schema
from recordloom.plans import Tables, query
from recordloom.plans.shapes import event_objects

SECRETS = ("example.com", "exam", "http://", "track(0)")


@query("""
WITH kinds AS (
  SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name,
         unnest([any_value(typeof(o_orderkey)), any_value(typeof(o_custkey)), any_value(typeof(o_orderstatus)),
                 any_value(typeof(o_totalprice)), any_value(typeof(o_orderdate)), any_value(typeof(o_orderpriority))]) AS kind
  FROM orders),
held AS (SELECT name, CASE WHEN kind IN ('BIGINT', 'INTEGER') THEN 'integer' WHEN kind = 'DOUBLE' THEN 'number'
                           WHEN kind = 'VARCHAR' THEN 'string' ELSE 'datetime' END AS kind FROM kinds),
wanted(name, kind) AS (VALUES ('o_orderkey', 'integer'), ('o_totalprice', 'number'), ('o_orderpriority', 'string'), ('o_clerk', 'string'), ('o_orderstatus', 'number'))
SELECT coalesce(w.name, h.name) AS "column",
       CASE WHEN h.name IS NULL THEN 'missing' WHEN w.name IS NULL THEN 'extra' ELSE 'type' END AS problem, w.kind AS expected, h.kind AS found
FROM wanted w FULL JOIN held h ON w.name = h.name
WHERE w.kind IS DISTINCT FROM h.kind
""")
def check_schema(t: Tables) -> DataFrame:
    wanted = {
        "o_orderkey": "integer", "o_totalprice": "number", "o_orderpriority": "string", "o_clerk": "string",
        "o_orderstatus": "number",
    }
    return quality.check_schema(t.orders, wanted, strict=True)


@query("""
SELECT 'doc_id' AS "column", 'integer' AS type, 0 AS position UNION ALL SELECT 'lang', 'string', 1
UNION ALL SELECT 'gone', CASE WHEN count(nullif(lang, lang)) > 0 THEN 'string' ELSE 'null' END, 2 FROM documents
""")
def infer_schema_nulls(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.expr("nullif(lang, lang)").alias("gone"))
    return schema.infer_schema(rows)


@query("SELECT count(*) AS rows, count(*) BETWEEN 1000 AND 1000000000 AS ok FROM lineitem")
def check_rowcount(t: Tables) -> DataFrame:
    return quality.check_rowcount(t.lineitem, minimum=1000, maximum=1_000_000_000)


@query("SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(t: Tables) -> DataFrame:
    return quality.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("""
SELECT 's' AS "column", count(*) FILTER (o_orderstatus = 'P') AS nulls FROM orders HAVING count(*) FILTER (o_orderstatus = 'P') > 0
UNION ALL SELECT 'absent', count(*) FROM orders
""")
def check_no_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("s"))
    return quality.check_no_nulls(rows, "o_orderkey", "s", "absent")


@query("""
SELECT 'rowcount' AS "check", count(*) >= 10 AS ok, CAST(count(*) AS VARCHAR) AS found FROM lineitem
UNION ALL SELECT 'no_nulls:flag', count(*) FILTER (l_returnflag = 'A') = 0, CAST(count(*) FILTER (l_returnflag = 'A') AS VARCHAR) FROM lineitem
UNION ALL SELECT 'no_nulls:l_quantity', count(*) FILTER (l_quantity IS NULL) = 0, CAST(count(*) FILTER (l_quantity IS NULL) AS VARCHAR) FROM lineitem
UNION ALL SELECT 'discount below a fifth', max(l_discount) < 0.2, CAST(max(l_discount) < 0.2 AS VARCHAR) FROM lineitem
UNION ALL SELECT 'no tax', max(l_tax) = 0, CAST(max(l_tax) = 0 AS VARCHAR) FROM lineitem
""")
def gate_fused(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("flag", F.expr("nullif(l_returnflag, 'A')"))
    that = {"discount below a fifth": F.max("l_discount") < 0.2, "no tax": F.max("l_tax") == 0}
    return quality.gate(rows, rows=(10, None), no_nulls=["flag", "l_quantity"], that=that)


_EVENT_CONTRACT = {
    "type": "object",
    "required": ["id", "error"],
    "properties": {
        "id": {"type": "integer", "minimum": 100},
        "amount": {"$ref": "#/definitions/amount"},
        "mixed": {"enum": ["new", 1, None]},
        "error": {"type": "object", "required": ["text"], "properties": {"code": {"maximum": 4}}},
        "tags": {"type": "array", "minItems": 2, "items": {"type": "string", "minLength": 2, "pattern": "^b"}},
    },
    "definitions": {"amount": {"type": "number", "maximum": 300}},
}

_BROKEN = """
WITH e AS (SELECT event_id, event_type, value,
                  CASE event_type WHEN 'click' THEN round_even(value, 0) WHEN 'view' THEN NULL ELSE floor(value) + 0.125 END AS amount
           FROM events),
v AS (
  SELECT event_id, '$.id' AS path, 'minimum' AS rule, '100' AS expected, CAST(event_id AS VARCHAR) AS found FROM e WHERE event_id < 100
  UNION ALL SELECT event_id, '$.amount', 'type', 'number', 'null' FROM e WHERE event_type = 'view'
  UNION ALL SELECT event_id, '$.amount', 'maximum', '300', NULL FROM e WHERE amount > 300
  UNION ALL SELECT event_id, '$.mixed', 'enum', '["new", 1, null]', 'true' FROM e WHERE event_type <> 'signup'
  UNION ALL SELECT event_id, '$', 'required', 'error', NULL FROM e WHERE event_type <> 'error'
  UNION ALL SELECT event_id, '$.error', 'required', 'text', NULL FROM e WHERE event_type = 'error'
  UNION ALL SELECT event_id, '$.error.code', 'maximum', '4', '5' FROM e WHERE event_type = 'error'
  UNION ALL SELECT event_id, '$.tags', 'minItems', '2', '1' FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, '$.tags[0]', 'minLength', '2', '"a"' FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, '$.tags[0]', 'pattern', '^b', '"a"' FROM e WHERE event_type = 'purchase'
)
"""


@query(_BROKEN + "SELECT event_id, path, rule, expected, found FROM v")
def contract_violations(t: Tables) -> DataFrame:
    found = contracts.contract_violations(event_objects(t), "body", _EVENT_CONTRACT, keep=["event_id"])
    # The text of a large number is an engine's own; the amount itself is in the rule.
    shown = F.when(F.col("rule") == "maximum", F.when(F.col("path") != "$.amount", F.col("found"))).otherwise(F.col("found"))
    return found.withColumn("found", shown)


@query(_BROKEN + "SELECT regexp_replace(path, '\\[\\d+\\]', '[]') AS path, rule, count(*) AS rows FROM v GROUP BY ALL")
def contract_summary(t: Tables) -> DataFrame:
    return contracts.check_contract(event_objects(t), "body", _EVENT_CONTRACT)


@query("""
WITH k AS (SELECT event_type AS t, CASE event_type WHEN 'click' THEN 'integer' WHEN 'view' THEN 'null' ELSE 'number' END AS amount,
    CASE event_type WHEN 'signup' THEN 'string' ELSE 'boolean' END AS mixed FROM events)
SELECT '$' AS path, 'object' AS type, array_to_string(list_sort(['amount', 'id', 'mixed'] || CASE WHEN bool_and(t = 'error') THEN ['error'] ELSE [] END
    || CASE WHEN bool_and(t = 'purchase') THEN ['none', 'tags'] ELSE [] END), ',') AS required FROM k HAVING count(*) > 0
UNION ALL SELECT '$.id', 'integer', '' FROM k HAVING count(*) > 0
UNION ALL SELECT '$.amount', CASE WHEN count(DISTINCT amount) = 1 THEN min(amount) END, '' FROM k HAVING count(*) > 0
UNION ALL SELECT '$.mixed', CASE WHEN count(DISTINCT mixed) = 1 THEN min(mixed) END, '' FROM k HAVING count(*) > 0
UNION ALL SELECT path, type, required FROM (VALUES ('error', '$.error', 'object', 'code'), ('error', '$.error.code', 'integer', ''),
    ('purchase', '$.none', 'null', ''), ('purchase', '$.tags', 'array', ''), ('purchase', '$.tags[]', 'string', '')) AS v(t, path, type, required)
  WHERE t IN (SELECT t FROM k)
""")
def contract_generate(t: Tables) -> DataFrame:
    """The contract the events would satisfy, one row per place and rule."""
    found = contracts.generate(event_objects(t), "body")
    rows = []

    def walk(node: dict, path: str) -> None:
        rows.append((path, node.get("type"), ",".join(node.get("required", []))))
        for name, child in node.get("properties", {}).items():
            walk(child, f"{path}.{name}")
        if "items" in node:
            walk(node["items"], f"{path}[]")

    walk(found, "$")
    return t.spark.createDataFrame(rows, "path string, type string, required string")


DEEP = 40


@query(
    f"WITH RECURSIVE levels(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM levels WHERE i < {DEEP - 1})"
    """
SELECT '$' || repeat('.a', i) AS path, 'object' AS type, (SELECT count(*) FROM region) AS n FROM levels
UNION ALL SELECT '$' || repeat('.a', max(i)) || '.leaf', 'integer', (SELECT count(*) FROM region) FROM levels
"""
)
def observed_paths_deep(t: Tables) -> DataFrame:
    """Documents of forty levels around a region's key: every level is found."""
    body = F.concat(F.lit('{"a":' * (DEEP - 1) + '{"leaf":'), F.col("r_regionkey").cast("string"), F.lit("}" * DEEP))
    return contracts.observed_paths(t.region.select(body.alias("body")), "body").select("path", "type", "n")


@query("""
SELECT page_id, replace(replace(replace(replace(url, 'example.com', '[redacted]'), 'track(0)', '[redacted]'), 'http://', '[redacted]'), 'exam', '[redacted]') AS url,
       replace(replace(replace(replace(html, 'example.com', '[redacted]'), 'track(0)', '[redacted]'), 'http://', '[redacted]'), 'exam', '[redacted]') AS html
FROM pages
""")
def redact_pages(t: Tables) -> DataFrame:
    nested = t.pages.select("page_id", F.struct("url", F.array("html").alias("html")).alias("page"))
    masked = quality.redact(nested, SECRETS)
    return masked.select("page_id", "page.url", F.get("page.html", F.lit(0)).alias("html"))


@query("""
SELECT doc_id, md5(replace(replace(replace(text, '@example', '[redacted]'), 'the ', '[redacted]'), 'tion', '[redacted]')) AS digest
FROM documents
""")
def redact_documents(t: Tables) -> DataFrame:
    masked = quality.redact(t.documents.select("doc_id", "text"), ["tion", "the ", "@example"])
    return masked.select("doc_id", F.md5("text").alias("digest"))


@query("""
SELECT 'big' AS "column", 'beyond 2^53' AS problem, count(*) AS rows FROM orders WHERE CAST(o_orderkey AS HUGEINT) * 1000000000000 > 9007199254740992 HAVING count(*) > 0
UNION ALL SELECT 'wide', 'beyond 2^53', count(*) FROM orders WHERE round(o_totalprice) * 1e11 > 9007199254740992 HAVING count(*) > 0
""")
def export_safety(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") * 1_000_000_000_000).alias("big"),
        (F.round("o_totalprice") * 1e11).alias("wide"),
        "o_totalprice",
    )
    return quality.export_safety(rows)
