"""Records, flattening, exploding, alignment, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import contracts, reshape, schema
from recordloom.plans import Tables, query

def nested_lines(t: Tables) -> DataFrame:
    """Each line as a nested object: a part, a list of charges, a list of flags.

    The lists are made from the row's own columns, so none of them can grow.
    """
    charge = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.round(F.col(c) * 100).cast("long").alias("amount"))
    code = F.expr("nullif(l_returnflag, 'N')")
    return t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.struct(
            F.col("l_partkey").alias("id"),
            F.struct(code.alias("code"), F.col("l_linestatus").alias("label")).alias("status"),
        ).alias("part"),
        F.filter(F.array(charge("tax", "l_tax"), charge("discount", "l_discount")), lambda x: x["amount"] > 0).alias("charges"),
        F.filter(F.array(code, F.col("l_linestatus")), lambda x: F.col("l_linenumber") > 1).alias("flags"),
    )


_LINES = """
WITH n AS (SELECT l_orderkey AS id, l_partkey AS part_id, nullif(l_returnflag, 'N') AS part_status_code, l_linestatus AS part_status_label,
  list_filter([{'kind': 'tax', 'amount': CAST(round(l_tax * 100) AS BIGINT)}, {'kind': 'discount', 'amount': CAST(round(l_discount * 100) AS BIGINT)}], lambda x: x.amount > 0) AS charges,
  CASE WHEN l_linenumber > 1 THEN [nullif(l_returnflag, 'N'), l_linestatus] ELSE [] END AS flags FROM lineitem)
"""


@query(_LINES + """
SELECT id, part_id, part_status_code, part_status_label, CASE WHEN len(charges) > 0 THEN CAST(to_json(charges) AS VARCHAR) END AS charges,
       CASE WHEN len(flags) > 0 THEN coalesce(part_status_code, '') || ',' || part_status_label END AS flags
FROM n
""")
def flatten_nested(t: Tables) -> DataFrame:
    return reshape.flatten(nested_lines(t))


@query("""
SELECT c_custkey AS a_b, c_mktsegment AS a_b_2, c_name AS a_b_3, c_nationkey AS a_c, c_acctbal AS a_c_2 FROM customer
""")
def flatten_clash_suffix(t: Tables) -> DataFrame:
    rows = t.customer.select(
        F.col("c_custkey").alias("a_b"),
        F.col("c_mktsegment").alias("a_b_2"),
        F.struct(F.col("c_name").alias("b"), F.col("c_nationkey").alias("c")).alias("a"),
        F.col("c_acctbal").alias("a_c"),
    )
    return reshape.flatten(rows)


@query(_LINES + "SELECT id, part_id, to_json({'code': part_status_code, 'label': part_status_label})::VARCHAR AS status FROM n")
def flatten_depth(t: Tables) -> DataFrame:
    """Beyond the depth limit an object stays an object; here it is written as JSON to compare."""
    flat = reshape.flatten(nested_lines(t).select("id", "part"), max_depth=2)
    return flat.select("id", "part_id", F.to_json("part_status", {"ignoreNullFields": "false"}).alias("status"))


@query(_LINES + """
SELECT id, part_id, c.kind AS charges_kind, c.amount AS charges_amount
FROM (SELECT id, part_id, unnest(CASE WHEN len(charges) > 0 THEN charges ELSE [NULL] END) AS c FROM n)
""")
def explode_objects(t: Tables) -> DataFrame:
    rows = nested_lines(t).select("id", F.struct("part.id").alias("part"), "charges")
    return reshape.explode(rows, "charges")


@query(_LINES + """
SELECT id, part_id, unnest(CASE WHEN len(flags) > 0 THEN flags ELSE [NULL] END) AS flags, CAST(NULL AS VARCHAR) AS absent FROM n
""")
def explode_keep_empty(t: Tables) -> DataFrame:
    rows = nested_lines(t).select("id", F.col("part.id").alias("part_id"), "flags")
    both = reshape.explode_rows(reshape.explode_rows(rows, "flags"), "absent")
    return both.withColumn("absent", F.col("absent").cast("string"))


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders UNION ALL SELECT o_custkey, o_totalprice / 2 FROM orders")
def records_envelope(t: Tables) -> DataFrame:
    """Documents that wrap two records each in a list, opened again."""
    item = lambda key, total: F.struct(F.col(key).alias("id"), total.alias("total"))
    items = F.array(item("o_orderkey", F.col("o_totalprice")), item("o_custkey", F.col("o_totalprice") / 2))
    return reshape.records(t.orders.select(items.alias("items"), F.lit(2).alias("total")))


@query("""
SELECT 'intersection' AS policy, c_custkey AS id, c_name AS name, NULL AS segment FROM customer
UNION ALL SELECT 'intersection', s_suppkey, s_name, NULL FROM supplier
UNION ALL SELECT 'first', c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT 'first', s_suppkey, s_name, NULL FROM supplier
UNION ALL SELECT 'union', c_custkey, c_name, c_mktsegment FROM customer
UNION ALL SELECT 'union', s_suppkey, s_name, NULL FROM supplier
""")
def align_policies(t: Tables) -> DataFrame:
    customers = t.customer.selectExpr("c_custkey id", "c_name name", "c_mktsegment segment")
    suppliers = t.supplier.selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    kept = [
        reshape.align([customers, suppliers], policy).withColumn("policy", F.lit(policy))
        for policy in ("intersection", "first", "union")
    ]
    return reshape.align(kept, "union").select("policy", "id", "name", "segment")


def event_objects(t: Tables) -> DataFrame:
    """Events as JSON with fields that come and go and change type by kind of event."""
    kind, value = F.col("event_type"), F.col("value")
    amount = (
        F.when(kind == "click", F.round(value).cast("long").cast("string"))
        .when(kind == "view", F.lit("null"))
        .otherwise(F.format_string("%.3f", F.floor(value) + 0.125))
    )
    mixed = F.when(kind == "signup", F.lit('"new"')).otherwise(F.lit("true"))
    body = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"amount":'), amount, F.lit(',"mixed":'), mixed,
        F.when(kind == "error", F.lit(',"error":{"code":5}')).otherwise(""),
        F.when(kind == "purchase", F.lit(',"none":null,"tags":["a"]')).otherwise(""), F.lit("}"),
    )
    return t.events.select("event_id", body.alias("body"))


@query("""
SELECT 'id' AS field, 'integer' AS type, count(*) AS present, CAST(0 AS BIGINT) AS nulls FROM events
UNION ALL SELECT 'amount', 'number', count(*), count(*) FILTER (event_type = 'view') FROM events
UNION ALL SELECT 'mixed', 'string', count(*), 0 FROM events
UNION ALL SELECT 'error', 'object', count(*), 0 FROM events WHERE event_type = 'error'
UNION ALL SELECT 'none', 'null', count(*), count(*) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'tags', 'list', count(*), 0 FROM events WHERE event_type = 'purchase'
""")
def infer_schema_json(t: Tables) -> DataFrame:
    return schema.infer_json_schema(event_objects(t), "body")


@query("SELECT field, count(*) AS present FROM events, (VALUES ('id'), ('amount'), ('mixed')) v(field) GROUP BY field")
def json_key_presence(t: Tables) -> DataFrame:
    return reshape.json_columns(event_objects(t), "body", "intersection")


@query("""
WITH f AS (SELECT event_type FROM events ORDER BY event_id LIMIT 1),
     k AS (SELECT unnest(CASE event_type WHEN 'error' THEN ['id', 'amount', 'mixed', 'error'] WHEN 'purchase' THEN ['id', 'amount', 'mixed', 'none', 'tags']
                         ELSE ['id', 'amount', 'mixed'] END) AS field FROM f)
SELECT field, CASE field WHEN 'error' THEN (SELECT count(*) FROM events WHERE event_type = 'error')
                         WHEN 'none' THEN (SELECT count(*) FROM events WHERE event_type = 'purchase')
                         WHEN 'tags' THEN (SELECT count(*) FROM events WHERE event_type = 'purchase')
                         ELSE (SELECT count(*) FROM events) END AS present
FROM k
""")
def json_first_columns(t: Tables) -> DataFrame:
    return reshape.json_columns(event_objects(t), "body", "first", ["event_id"])


@query("""
SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'open') AS status, 'none' AS note, CAST(0 AS INTEGER) AS rank FROM orders
""")
def fill_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("status"))
    return reshape.fill_nulls(rows, {"status": "open", "note": "none", "rank": 0})


@query(_LINES + "SELECT id, part_id, part_status_code, part_status_label FROM n")
def unflatten_roundtrip(t: Tables) -> DataFrame:
    flat = reshape.flatten(nested_lines(t).select("id", "part"))
    return reshape.flatten(reshape.unflatten(flat))


@query("""
SELECT o_totalprice AS value FROM orders UNION ALL SELECT 0.0::DOUBLE FROM customer
""")
def pluck_default(t: Tables) -> DataFrame:
    present = reshape.pluck(t.orders, "o_totalprice").withColumnRenamed("o_totalprice", "value")
    absent = reshape.pluck(t.customer, "value", default=0.0)
    return present.unionByName(absent)


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events
""")
def flatten_open_objects(t: Tables) -> DataFrame:
    """Objects with open keys: each key found becomes a column."""
    rows = t.events.select("event_id", F.from_json("props", "map<string,bigint>").alias("props"))
    return reshape.flatten(rows, expand_maps=True)


@query("""
WITH o AS (SELECT 'P' AS skip, count(*) AS n FROM events)
SELECT '$' AS path, 'object' AS type, n FROM o
UNION ALL SELECT '$.id', 'integer', n FROM o
UNION ALL SELECT '$.amount', CASE event_type WHEN 'click' THEN 'integer' WHEN 'view' THEN 'null' ELSE 'number' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT '$.mixed', CASE event_type WHEN 'signup' THEN 'string' ELSE 'boolean' END, count(*) FROM events GROUP BY 2
UNION ALL SELECT '$.error', 'object', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT '$.error.code', 'integer', count(*) FROM events WHERE event_type = 'error'
UNION ALL SELECT '$.none', 'null', count(*) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT '$.tags', 'list', count(*) FROM events WHERE event_type = 'purchase'
UNION ALL SELECT '$.tags[]', 'string', count(*) FROM events WHERE event_type = 'purchase'
""")
def observed_paths(t: Tables) -> DataFrame:
    return contracts.observed_paths(event_objects(t), "body").select("path", "type", "n")
