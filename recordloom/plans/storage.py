"""Files, tables, digests and publication."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom import registry
from recordloom.operators import digests, publish, quality
from recordloom.plans import Tables, query
from recordloom.plans.shapes import nested_lines
from recordloom.session import scratch, stage
from recordloom.sources import files, tables


def _scratch(t: Tables, name: str) -> str:
    return scratch(t.spark, name)


@query("""
SELECT c_custkey, '00' || CAST(c_nationkey AS VARCHAR) AS code, c_name, c_nationkey > 12 AS far,
       CAST(CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS BIGINT) AS gaps, c_acctbal
FROM customer
""")
def csv_leading_zero(t: Tables) -> DataFrame:
    """Written as CSV and read back: codes keep their zeros, other types are found again."""
    rows = t.customer.select(
        "c_custkey",
        F.concat(F.lit("00"), F.col("c_nationkey").cast("string")).alias("code"),
        "c_name",
        (F.col("c_nationkey") > 12).alias("far"),
        F.expr("nullif(c_nationkey, 3)").alias("gaps"),
        "c_acctbal",
    )
    return files.read_csv(t.spark, files.save_csv(rows, _scratch(t, "customers") + "/all.csv"))


@query("""
SELECT l_orderkey AS id, l_partkey AS part_id, nullif(l_returnflag, 'N') AS part_status_code, l_linestatus AS part_status_label FROM lineitem
""")
def json_round_trip(t: Tables) -> DataFrame:
    """Nested records written as lines of JSON, read back, flattened, written as Parquet, read back."""
    lines = files.save(nested_lines(t).select("id", "part"), _scratch(t, "lines") + "/all.ndjson")
    flat = files.save(files.read(t.spark, lines), _scratch(t, "lines") + "/all.parquet")
    return files.read(t.spark, flat)


@query("""
SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
""")
def glob_read_stacked(t: Tables) -> DataFrame:
    """Two Parquet files with different columns, matched by one pattern."""
    base = _scratch(t, "glob")
    t.customer.selectExpr("c_custkey id", "c_name name", "c_mktsegment segment").write.parquet(f"{base}/a.parquet")
    t.supplier.selectExpr("s_suppkey id", "s_name name", "s_acctbal balance").write.parquet(f"{base}/b.parquet")
    return files.glob_read(t.spark, f"{base}/*.parquet").select("id", "name", "segment", "balance")


@query("""
SELECT 'a' AS part, c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS phone, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'b', s_suppkey, s_name, 'p' || s_nationkey, NULL FROM supplier
""")
def csv_list_headers(t: Tables) -> DataFrame:
    """Two folders of CSV with other columns in another order, read as one frame by name."""
    base = _scratch(t, "lists")
    files.save_csv(t.customer.selectExpr("'a' part", "c_custkey id", "c_name name", "c_mktsegment segment"), f"{base}/a.csv")
    files.save_csv(t.supplier.selectExpr("concat('p', s_nationkey) phone", "s_name name", "s_suppkey id", "'b' part"), f"{base}/b.csv")
    return files.read(t.spark, [f"{base}/a.csv", f"{base}/b.csv"]).select("part", "id", "name", "phone", "segment")


@query("""
SELECT c_custkey AS id, c_name || chr(10) || 'said "' || c_mktsegment || '",' || chr(10) AS note, c_acctbal AS balance FROM customer
""")
def csv_line_ends_in_cells(t: Tables) -> DataFrame:
    """Cells that hold line ends, quotes and commas come back as they were."""
    note = F.concat("c_name", F.lit('\nsaid "'), "c_mktsegment", F.lit('",\n'))
    rows = t.customer.select(F.col("c_custkey").alias("id"), note.alias("note"), F.col("c_acctbal").alias("balance"))
    return files.read(t.spark, files.save_csv(rows, _scratch(t, "notes") + "/all.csv"))


def _listed(batches):
    """The JSON texts of a task as the lines of one list, which begins with an empty object."""
    yield pa.RecordBatch.from_pydict({"value": ["[{}"]})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(",", batch.column(0).cast(pa.string()), "")], names=["value"])
    yield pa.RecordBatch.from_pydict({"value": ["]"]})


@query("""
SELECT o_orderkey AS id, o_orderstatus || '}],[{"' AS note, o_custkey AS customer_key FROM orders
""")
def json_list_document(t: Tables) -> DataFrame:
    """Orders as JSON lists, one per file, cut into elements by the tasks that read them."""
    customer = F.struct(F.col("o_custkey").alias("key"))
    order = F.struct(F.col("o_orderkey").alias("id"), F.concat("o_orderstatus", F.lit('}],[{"')).alias("note"), customer.alias("customer"))

    path = _scratch(t, "list") + "/all.json"
    t.orders.select(F.to_json(order).alias("value")).mapInArrow(_listed, "value string").write.text(path)
    read = files.read_json(t.spark, path, split=True).filter("id is not null")
    return read.select("id", "note", F.col("customer.key").alias("customer_key"))


@query("SELECT c_custkey AS id, c_name AS who_name, CAST(c_nationkey AS BIGINT) AS who_nation FROM customer")
def convert_documents(t: Tables) -> DataFrame:
    """JSON lists of nested customers, converted to Parquet and from there to CSV, and read back."""
    base = _scratch(t, "converted")
    who = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    t.customer.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), who.alias("who")))).mapInArrow(_listed, "value string").write.text(f"{base}/a.json")
    files.convert(t.spark, f"{base}/a.json", f"{base}/b.parquet")
    files.convert(t.spark, f"{base}/b.parquet", f"{base}/c.csv")
    return files.read(t.spark, f"{base}/c.csv").filter("id is not null").select("id", "who_name", "who_nation")


@query("""
SELECT o_orderkey AS id, o_custkey AS customer, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS items
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
""")
def save_keeps_records(t: Tables) -> DataFrame:
    """Orders that hold a list called items are saved as they are, not as their items."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    orders = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("l.l_partkey").alias("items")
    )
    return files.read(t.spark, files.save(orders, _scratch(t, "orders") + "/all.parquet"))


@query("""
SELECT o_orderstatus AS status, o_orderkey AS id, o_totalprice > 100000 AS large FROM orders
""")
def json_table_convert(t: Tables) -> DataFrame:
    """Documents with records inside, saved as JSON, converted to Parquet as a table of the records."""
    base = _scratch(t, "documents")
    records = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") > 100000).alias("large"))
    documents = t.orders.groupBy((F.col("o_orderkey") % 64).alias("batch")).agg(F.collect_list(records).alias("records"))
    files.save_json(documents, f"{base}/a.ndjson")
    table = files.to_table(t.spark, f"{base}/a.ndjson")
    return files.read(t.spark, files.save(table, f"{base}/b.parquet")).select("status", "id", "large")


@query("""
WITH b AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN b.o_custkey IS NULL THEN c_name END AS c_name, last_order
FROM customer LEFT JOIN b ON c_custkey = b.o_custkey
""")
def table_upsert(t: Tables) -> DataFrame:
    """Customers replaced by their last order; columns the batch lacks become null."""
    target = t.customer.select("c_custkey", "c_name")
    batch = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("last_order"), "o_orderdate"
    )
    merged = tables.upserted(target, batch, "c_custkey", ["o_orderdate", "last_order"])
    return merged.select("c_custkey", "c_name", "last_order")


@query("""
SELECT c_custkey AS id, c_name AS name, NULL AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier
""")
def table_append_widen(t: Tables) -> DataFrame:
    target = t.customer.selectExpr("c_custkey id", "c_name name")
    return tables.appended(target, t.supplier.selectExpr("s_suppkey id", "s_acctbal balance"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_totalprice > 300000 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 50000)
""")
def delete_update_where(t: Tables) -> DataFrame:
    kept = tables.deleted(t.orders, (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") < 50000))
    changed = tables.updated(
        kept, F.col("o_totalprice") > 300000, {"o_orderstatus": F.lit("large"), "o_totalprice": F.col("o_totalprice") / 2}
    )
    return changed.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' GROUP BY o_custkey")
def sql_with_parameters(t: Tables) -> DataFrame:
    text = "SELECT o_custkey, count(*) AS orders FROM o WHERE o_totalprice > ? AND o_orderstatus = ? GROUP BY o_custkey"
    return tables.sql(t.spark, text, 100000.0, "F", o=t.orders)


_MODES = """
WITH first AS (SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS tag FROM customer WHERE c_custkey % 2 = 0),
second AS (SELECT c_custkey AS id, c_name AS name, 'odd' AS tag FROM customer WHERE c_custkey % 2 = 1),
third AS (SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS name, 'third' AS tag FROM customer WHERE c_custkey % 3 = 0),
merged AS (SELECT * FROM (SELECT * FROM first UNION ALL SELECT * FROM second) WHERE id NOT IN (SELECT id FROM third) UNION ALL SELECT * FROM third)
"""


@query(_MODES + """
SELECT 'rows' AS what, count(*) AS n FROM merged WHERE id % 5 <> 0
UNION ALL SELECT 'deleted', count(*) FROM merged WHERE id % 5 = 0
UNION ALL SELECT 'updated', count(*) FROM merged WHERE id % 5 <> 0 AND tag = 'third'
UNION ALL SELECT coalesce(tag, 'none'), count(*) FROM (SELECT CASE WHEN tag = 'third' THEN 'seen' ELSE tag END AS tag FROM merged WHERE id % 5 <> 0) GROUP BY 1
""")
def table_write_modes(t: Tables) -> DataFrame:
    """A catalog table replaced, replaced from itself, appended with a new column, upserted, deleted from and updated."""
    name = f"written_{uuid.uuid4().hex[:8]}"
    rows = t.customer.selectExpr("c_custkey id", "c_name name")
    tables.table_write(rows.filter("id % 2 = 0").withColumn("gone", F.lit(1)), name)
    tables.table_write(t.spark.table(name).drop("gone"), name)
    tables.table_write(rows.filter("id % 2 = 1").withColumn("tag", F.lit("odd")), name, "append")
    tables.table_write(rows.filter("id % 3 = 0").select("id", F.lit("third").alias("tag")), name, "upsert", "id")
    deleted = tables.table_delete_where(t.spark, name, F.col("id") % 5 == 0)
    updated = tables.table_update_where(t.spark, name, F.col("tag") == "third", {"tag": F.lit("seen")})
    held = stage(t.spark.table(name), "written")
    t.spark.sql(f"DROP TABLE {name}")
    tags = held.groupBy(F.coalesce("tag", F.lit("none")).alias("what")).agg(F.count("*").alias("n"))
    counts = t.spark.createDataFrame([("deleted", deleted), ("updated", updated)], "what string, n long")
    return tags.unionByName(counts).unionByName(held.agg(F.lit("rows").alias("what"), F.count("*").alias("n")))


@query("SELECT l_orderkey AS id, l_quantity * 2 AS twice FROM lineitem")
def script_over_batches(t: Tables) -> DataFrame:
    """A user's Python function over Arrow batches of the lines."""
    def double(frame):
        return frame.assign(twice=frame["l_quantity"] * 2).rename(columns={"l_orderkey": "id"})[["id", "twice"]]

    return registry.run_script(t.lineitem.select("l_orderkey", "l_quantity"), double, "id long, twice double")


_DIGEST = """
WITH cells AS (SELECT md5(concat_ws(chr(31), 'v' || CAST(l_extendedprice * 100 AS BIGINT), coalesce('v' || l_linenumber, 'n'), 'v' || l_linestatus, 'v' || l_orderkey, 'v' || l_partkey,
    coalesce('v' || nullif(l_returnflag, 'N'), 'n'), 'v' || l_suppkey)) AS h FROM lineitem),
sums AS (SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b FROM cells)
SELECT rows, md5('cents:bigint,l_linenumber:bigint,l_linestatus:string,l_orderkey:bigint,l_partkey:bigint,l_returnflag:string,l_suppkey:bigint'
  || '|' || rows || '|' || a || '|' || b) AS digest FROM sums
"""


@query(_DIGEST)
def table_digest(t: Tables) -> DataFrame:
    return publish.table_digest(t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint"), "l_linestatus",
        F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"), F.expr("cast(round(l_extendedprice * 100) as bigint)").alias("cents"),
    ))


@query("SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY l_returnflag")
def publish_validated(t: Tables) -> DataFrame:
    """Line totals published behind a gate, then read from where the pointer leads."""
    base = _scratch(t, "published")
    flags = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("rows"))
    gate = lambda df: quality.gate(df, rows=(1, 100), no_nulls=["l_returnflag"])
    publish.publish_validated({"flags": flags}, {"flags": gate}, base, "run1")
    return publish.published(t.spark, base, "flags")


@query("""
SELECT 'published' AS what, count(*) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem)
UNION ALL SELECT 'ready', 1 UNION ALL SELECT 'sound', 1 UNION ALL SELECT 'torn', 0
""")
def recover_publication(t: Tables) -> DataFrame:
    """A publication stops before its pointer moves: the one before stays, the new one waits."""
    base = _scratch(t, "recovered")
    flags = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("rows"))
    publish.publish_validated({"flags": flags}, {}, base, "run1")
    publish.prepare({"flags": flags.limit(1)}, {}, base, "run2")
    publish.recover_publication(t.spark, base)
    found = publish.standing(t.spark, base, verify=True)
    counts = [("ready", len(found.ready)), ("torn", len(found.torn)), ("sound", int(found.sound))]
    rows = publish.published(t.spark, base, "flags").agg(F.lit("published").alias("what"), F.count("*").alias("n"))
    return rows.unionByName(t.spark.createDataFrame(counts, "what string, n long"))


@query("SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY o_orderstatus")
def materialize_or_reuse(t: Tables) -> DataFrame:
    """Built once, then found again by its inputs' digests."""
    folder = _scratch(t, "stored")
    build = lambda: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("orders"))
    inputs = {"orders": publish.digest_of(t.orders)}
    publish.materialize_or_reuse(t.spark, folder, "by_status", 1, inputs, build)
    return publish.materialize_or_reuse(t.spark, folder, "by_status", 1, inputs, build)[0]


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'left_only' ELSE 'changed' END AS change,
       CASE WHEN o_orderkey % 101 = 0 THEN 'status,money' ELSE 'money' END AS groups
FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 97 = 0
""")
def digest_tree_changes(t: Tables) -> DataFrame:
    """Two versions of the orders, compared by the digests of their parts; only parts that differ are read."""
    base, groups = _scratch(t, "versions"), {"status": ["o_orderstatus"], "money": ["o_totalprice", "o_custkey"]}
    left = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    dearer = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    right = left.filter("o_orderkey % 101 <> 0").withColumn("o_totalprice", dearer)
    paths = [digests.write_parts(df, f"{base}/{n}", ["o_orderkey"], groups, parts=64) for n, df in (("left", left), ("right", right))]
    return digests.changed_rows(t.spark, *paths, ["o_orderkey"], groups)
