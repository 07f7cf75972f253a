"""Filters, joins, reconciliation, grouping, deduplication, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import aggregate, filters, ordering, quality, relate, reshape
from recordloom.plans import Tables, query


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice <= 200000")
def filter_rows_range(t: Tables) -> DataFrame:
    kept = filters.filter_rows(t.orders, "o_totalprice", minimum=100000, maximum=200000)
    return reshape.select(kept, "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') AND p_brand = 'Brand#2'")
def filter_rows_contains(t: Tables) -> DataFrame:
    kept = filters.filter_rows(filters.filter_rows(t.part, "p_name", contains="ring"), "p_brand", equals="Brand#2")
    return reshape.select(kept, "p_partkey", "p_name")


@query("""
SELECT p_partkey, p_brand, p_size FROM part
WHERE regexp_matches(p_brand, '#[12]$') AND p_type IN ('ECONOMY', 'SMALL') AND p_size > 10 AND NOT (p_size >= 40)
""")
def filter_operators(t: Tables) -> DataFrame:
    kept = filters.filter_by(t.part, "p_brand", "regex", "#[12]$")
    kept = filters.filter_by(kept, "p_type", "in", "ECONOMY, SMALL")
    kept = filters.filter_by(kept, "p_size", "gt", 10)
    kept = filters.filter_by(kept, "p_size", "gte", 40, mode="exclude")
    return reshape.select(kept, "p_partkey", "p_brand", "p_size")


@query("SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS note FROM part")
def select_rename(t: Tables) -> DataFrame:
    named = reshape.rename(t.part, {"p_partkey": "id", "p_name": "name", "absent": "x"})
    return reshape.select(named, "id", "name", "note", missing="null")


@query("SELECT o_orderkey AS order_id, o_totalprice AS total, o_orderstatus FROM orders")
def field_mapping(t: Tables) -> DataFrame:
    return reshape.map_fields(
        t.orders, {"o_orderkey": "order_id", "o_totalprice": "total"}, exclude=["o_custkey", "o_orderdate", "o_orderpriority"]
    )


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def sort_head_topk(t: Tables) -> DataFrame:
    return relate.head(t.orders, 100, ["o_totalprice", "o_orderkey"], descending=True).select("o_orderkey", "o_totalprice")


@query("""
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier
""")
def concat_union_missing(t: Tables) -> DataFrame:
    customers = t.customer.selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    suppliers = t.supplier.selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    return relate.concat(customers, suppliers)


@query("""
SELECT o_orderkey, c_name, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
""")
def join_inner(t: Tables) -> DataFrame:
    customers = reshape.rename(t.customer, {"c_custkey": "o_custkey"})
    joined = relate.join_records(t.orders, customers, "o_custkey")
    return reshape.select(joined, "o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, p_brand, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def join_salted(t: Tables) -> DataFrame:
    parts = t.part.selectExpr("p_partkey l_partkey", "p_brand")
    joined = relate.join_records(t.lineitem, parts, "l_partkey", salt=4)
    return reshape.select(joined, "l_orderkey", "l_partkey", "l_linenumber", "p_brand", "l_quantity")


@query("SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left(t: Tables) -> DataFrame:
    return relate.join_records(t.documents.select("doc_id", "source"), t.labels, "doc_id", "left")


@query("SELECT d.doc_id, l.quality, d.lang FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def join_right(t: Tables) -> DataFrame:
    return relate.join_records(t.labels.select("doc_id", "quality"), t.documents.select("doc_id", "lang"), "doc_id", "right")


@query("""
SELECT coalesce(c_custkey, s_suppkey) AS key, c_name AS name_x, c_acctbal AS balance_x, c_mktsegment AS segment,
       s_name AS name_y, s_acctbal AS balance_y
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
""")
def join_outer_suffix(t: Tables) -> DataFrame:
    customers = t.customer.selectExpr("c_custkey key", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    suppliers = t.supplier.selectExpr("s_suppkey key", "s_name name", "s_acctbal balance")
    return relate.join_records(customers, suppliers, "key", "outer")


@query("""
WITH c AS (SELECT nullif(c_nationkey, 0) AS k, count(*) AS customers FROM customer GROUP BY 1),
     s AS (SELECT nullif(s_nationkey, 0) AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT c.k, customers, suppliers FROM c JOIN s ON c.k IS NOT DISTINCT FROM s.k
""")
def join_null_keys(t: Tables) -> DataFrame:
    customers = t.customer.groupBy(F.expr("nullif(c_nationkey, 0)").alias("k")).agg(F.count("*").alias("customers"))
    suppliers = t.supplier.groupBy(F.expr("nullif(s_nationkey, 0)").alias("k")).agg(F.count("*").alias("suppliers"))
    return relate.join_records(customers, suppliers, "k", null_keys="match")


@query("""
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def lookup_default(t: Tables) -> DataFrame:
    return relate.lookup(t.documents.select("doc_id"), t.labels, "doc_id", {"quality": -1, "toxic": -1})


@query("""
WITH b AS (SELECT l_orderkey, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS booked FROM lineitem GROUP BY 1),
     j AS (SELECT CASE WHEN l_orderkey IS NULL THEN 'left_only' WHEN o_orderkey IS NULL THEN 'right_only'
                       WHEN CAST(o_totalprice AS DECIMAL(28,2)) = booked THEN 'matched' ELSE 'mismatch' END AS origin,
                  o_totalprice, booked
           FROM orders FULL JOIN b ON o_orderkey = l_orderkey)
SELECT origin, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS declared,
       CAST(sum(booked) AS DOUBLE) AS booked
FROM j GROUP BY origin
""")
def reconcile_totals(t: Tables) -> DataFrame:
    """The flagship: declared order totals against booked line totals, counted by outcome."""
    declared = t.orders.selectExpr("o_orderkey id", "cast(o_totalprice as decimal(28,2)) total")
    lines = t.lineitem.selectExpr("l_orderkey id", "cast(l_extendedprice as decimal(18,2)) total")
    booked = reshape.rename(aggregate.group_agg(lines, "id", {"total": "sum"}), {"total_sum": "total"})
    rows = relate.reconcile(declared, booked, "id", "total")
    return rows.groupBy("origin").agg(
        F.count("*").alias("orders"),
        F.sum("left_value").cast("double").alias("declared"),
        F.sum("right_value").cast("double").alias("booked"),
    )


@query("""
WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
     o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, f.n AS left_value, o.n AS right_value,
       CASE WHEN o.o_custkey IS NULL THEN 'left_only' WHEN f.o_custkey IS NULL THEN 'right_only'
            WHEN f.n = o.n THEN 'matched' ELSE 'mismatch' END AS origin
FROM f FULL JOIN o ON f.o_custkey = o.o_custkey
""")
def reconcile_origin(t: Tables) -> DataFrame:
    count = lambda rows: reshape.rename(aggregate.group_agg(rows, "o_custkey"), {"count": "n"})
    done = filters.filter_rows(t.orders, "o_orderstatus", equals="F")
    return relate.reconcile(count(done), count(t.orders.filter("o_orderstatus <> 'F'")), "o_custkey", "n")


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
     b AS (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS top FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey,
       CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed'
            WHEN a.n <> b.n OR a.top <> b.top THEN 'changed' ELSE 'unchanged' END AS status,
       CASE WHEN a.o_custkey IS NULL OR b.o_custkey IS NULL THEN NULL
            ELSE concat_ws(';', CASE WHEN a.n <> b.n THEN 'n:' || a.n || '>' || b.n END,
                                CASE WHEN a.top <> b.top THEN 'top:' || a.top || '>' || b.top END) END AS diffs
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey
""")
def comparison_report(t: Tables) -> DataFrame:
    side = lambda chosen: t.orders.filter(chosen).groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.max("o_orderpriority").alias("top")
    )
    found = relate.compare(side("o_orderstatus = 'F'"), side("o_orderstatus <> 'F'"), "o_custkey")
    line = lambda d: F.concat(d["field"], F.lit(":"), d["before"], F.lit(">"), d["after"])
    return found.withColumn("diffs", F.array_join(F.transform("diffs", line), ";"))


@query("SELECT user_id, event_type, count(*) AS count FROM events GROUP BY ALL")
def group_count(t: Tables) -> DataFrame:
    return aggregate.group_agg(t.events, ["user_id", "event_type"])


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity_sum,
       round(avg(l_extendedprice), 4) AS l_extendedprice_avg, min(l_discount) AS l_discount_min,
       max(l_tax) AS l_tax_max, count(l_orderkey) AS l_orderkey_count
FROM lineitem GROUP BY ALL
""")
def group_sum_avg_min_max(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)"))
    out = aggregate.group_agg(
        lines,
        ["l_returnflag", "l_linestatus"],
        {"l_quantity": "sum", "l_extendedprice": "avg", "l_discount": "min", "l_tax": "max", "l_orderkey": "count"},
    )
    return out.withColumns(
        {"l_quantity_sum": F.col("l_quantity_sum").cast("double"), "l_extendedprice_avg": F.round("l_extendedprice_avg", 4)}
    )


@query("""
SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS event_type_first,
       arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS event_type_last
FROM events GROUP BY user_id
""")
def group_first_last(t: Tables) -> DataFrame:
    kinds = t.events.withColumn("event_type", F.expr("nullif(event_type, 'error')"))
    return aggregate.group_agg(kinds, "user_id", {"event_type": ["first", "last"]}, order_by=["ts", "event_id"])


@query("""
SELECT CAST(p_size AS VARCHAR) AS "group", round(max(p_retailprice), 4) AS value, count(*) AS count FROM part GROUP BY 1
""")
def aggregate_path(t: Tables) -> DataFrame:
    nested = t.part.select(F.struct("p_size", F.struct("p_retailprice").alias("price")).alias("item"))
    out = aggregate.aggregate_path(nested, "max", "item.price.p_retailprice", "item.p_size")
    return out.withColumn("value", F.round("value", 4))


@query("""
SELECT count(l_extendedprice) AS count, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum,
       round(avg(l_extendedprice), 4) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max
FROM lineitem
""")
def global_aggregates(t: Tables) -> DataFrame:
    out = aggregate.totals(t.lineitem.select(F.col("l_extendedprice").cast("decimal(18,2)")), "l_extendedprice")
    double = {n: F.col(n).cast("double") for n in ("sum", "min", "max")}
    return out.withColumns(double).withColumn("avg", F.round(F.col("avg").cast("double"), 4))


@query("SELECT round(median(l_extendedprice), 4) AS median FROM lineitem")
def median_exact(t: Tables) -> DataFrame:
    return aggregate.median(t.lineitem, "l_extendedprice").select(F.round("median", 4).alias("median"))


@query("""
SELECT event_type, bool_or(value > 0) AS value_any, bool_and(value > 0) AS value_all,
       bool_or(coalesce(length(nullif(props, '{"k": 0}')) > 0, false)) AS props_any,
       bool_and(coalesce(length(nullif(props, '{"k": 0}')) > 0, false)) AS props_all
FROM events GROUP BY event_type
""")
def any_all(t: Tables) -> DataFrame:
    rows = t.events.withColumn("props", F.expr("""nullif(props, '{"k": 0}')"""))
    return aggregate.any_all(rows, ["value", "props"], by=["event_type"])


@query("""
WITH n AS (SELECT conv_id, turn, role, length(text) AS size,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations)
SELECT conv_id, CAST((n - 1) // 4 AS BIGINT) AS part, string_agg(role || ':' || size, ',' ORDER BY n) AS items
FROM n GROUP BY 1, 2
""")
def group_by_collect(t: Tables) -> DataFrame:
    grouped = aggregate.group_records(t.conversations, "conv_id", ["turn", "role", "text"], rows_per_part=4)
    line = lambda x: F.concat(x["role"], F.lit(":"), F.length(x["text"]).cast("string"))
    return grouped.withColumn("items", F.array_join(F.transform("items", line), ","))


@query("""
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value
FROM events GROUP BY user_id, event_type
""")
def dedupe_keep_first(t: Tables) -> DataFrame:
    rows = relate.dedupe(t.events, ["user_id", "event_type"], ["ts", "event_id"])
    return rows.select("user_id", "event_type", "event_id", "value")


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def dedupe_all(t: Tables) -> DataFrame:
    return relate.dedupe(t.part.select("p_brand", "p_type", "p_size"))


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'error') AS event_type,
       arg_max(value, (ts, event_id)) FILTER (value <= 100) AS value
FROM events GROUP BY user_id
""")
def dedupe_merge(t: Tables) -> DataFrame:
    rows = t.events.select(
        "user_id", "ts", "event_id", F.expr("nullif(event_type, 'error')").alias("event_type"),
        F.when(F.col("value") <= 100, F.col("value")).alias("value"),
    )
    merged = relate.dedupe(rows, "user_id", ["ts", "event_id"], keep="merge")
    return merged.select("user_id", "event_type", "value")


@query("""
SELECT user_id,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'click') AS click,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'error') AS error,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS purchase,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'signup') AS signup,
       arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS view
FROM events GROUP BY user_id
""")
def pivot_last_wins(t: Tables) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return reshape.pivot(t.events, "user_id", "event_type", "value", ["ts", "event_id"], kinds)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders")
def row_number_dense(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return ordering.number_rows(rows, ["o_totalprice", "o_orderkey"], unique=True).select("o_orderkey", "row_number")


@query("""
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events
""")
def row_number_within(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", "ts")
    numbered = ordering.number_within(rows, ["event_type"], ["ts", "event_id"], "n", descending=True, unique=True)
    return numbered.select("event_id", "event_type", "n")


@query("""
SELECT l_quantity, min(n) AS low, max(n) AS high, count(*) AS size
FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS n FROM lineitem) GROUP BY l_quantity
""")
def row_number_ties(t: Tables) -> DataFrame:
    """Numbers over an order full of ties: each tie group owns a gapless range of numbers."""
    numbered = ordering.number_rows(t.lineitem.select("l_quantity"), ["l_quantity"], "n")
    return numbered.groupBy("l_quantity").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"))


@query("""
WITH n AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders),
     s AS (SELECT CAST(round_even(k * ((SELECT count(*) FROM orders) - 1) / 49.0, 0) AS BIGINT) AS i FROM range(50) r(k))
SELECT o_orderkey FROM n WHERE i IN (SELECT i FROM s)
""")
def sample_even(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderdate")
    return ordering.sample(rows, 50, ["o_orderdate", "o_orderkey"], unique=True).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey OFFSET 1000")
def drop_first(t: Tables) -> DataFrame:
    return ordering.drop_rows(t.customer.select("c_custkey", "c_acctbal"), 1000, ["c_acctbal", "c_custkey"])


@query("""
SELECT * FROM (SELECT l_returnflag, l_orderkey, l_partkey, l_extendedprice,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey DESC, l_partkey DESC,
                     l_suppkey DESC, l_linenumber DESC) AS rank FROM lineitem) WHERE rank <= 5
""")
def topk_per_group(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return ordering.top_k(rows, ["l_returnflag"], order, 5).drop("l_suppkey", "l_linenumber")


@query("""
SELECT 'o_orderkey' AS "column", count(o_orderkey) AS count, count(*) - count(o_orderkey) AS nulls, count(DISTINCT o_orderkey) AS "distinct",
  CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max, round(avg(o_orderkey), 4) AS mean FROM orders
UNION ALL SELECT 'o_custkey', count(o_custkey), 0, count(DISTINCT o_custkey), min(o_custkey), max(o_custkey), round(avg(o_custkey), 4) FROM orders
UNION ALL SELECT 'o_orderstatus', count(s), count(*) - count(s), count(DISTINCT s), NULL, NULL, NULL FROM (SELECT nullif(o_orderstatus, 'P') AS s FROM orders)
UNION ALL SELECT 'o_totalprice', count(o_totalprice), 0, count(DISTINCT o_totalprice), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 4) FROM orders
UNION ALL SELECT 'o_orderdate', count(o_orderdate), 0, count(DISTINCT o_orderdate), NULL, NULL, NULL FROM orders
UNION ALL SELECT 'o_orderpriority', count(o_orderpriority), 0, count(DISTINCT o_orderpriority), NULL, NULL, NULL FROM orders
""")
def describe_columns(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return quality.describe(rows).withColumn("mean", F.round("mean", 4))


@query("""
WITH j AS (SELECT d.doc_id, nullif(d.lang, 'en') AS lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS "column", 'integer' AS type, count(*) AS rows, count(*) - count(doc_id) AS nulls FROM j
UNION ALL SELECT 'lang', 'string', count(*), count(*) - count(lang) FROM j
UNION ALL SELECT 'quality', 'integer', count(*), count(*) - count(quality) FROM j
UNION ALL SELECT 'gone', 'null', count(*), count(*) FROM j
""")
def profile_nulls(t: Tables) -> DataFrame:
    rows = relate.join_records(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id", "left")
    rows = rows.withColumns({"lang": F.expr("nullif(lang, 'en')"), "gone": F.lit(None).cast("int")})
    return quality.profile(rows)


_ORDERED = "(SELECT '{0}' AS kind, c_custkey FROM c ORDER BY held {1}, c_custkey {2} LIMIT 40)"


@query(
    "WITH c AS (SELECT c_custkey, nullif(c_nationkey, 3) AS held FROM customer) "
    + " UNION ALL ".join(
        "SELECT * FROM " + _ORDERED.format(kind, held, key)
        for kind, held, key in (
            ("records up", "ASC NULLS FIRST", "ASC"), ("records down", "DESC NULLS LAST", "DESC"),
            ("last up", "ASC NULLS LAST", "ASC"), ("last down", "DESC NULLS LAST", "DESC"),
        )
    )
)
def sort_by_nulls(t: Tables) -> DataFrame:
    """The first forty customers by a column with nulls, in both directions and under both rules for nulls."""
    rows = t.customer.select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("held"))
    out = None
    for nulls in ("records", "last"):
        for down in (False, True):
            ordered = relate.sort_by(rows, ["held", "c_custkey"], descending=down, nulls=nulls).limit(40)
            part = ordered.select(F.lit(f"{nulls} {'down' if down else 'up'}").alias("kind"), "c_custkey")
            out = part if out is None else out.unionByName(part)
    return out
