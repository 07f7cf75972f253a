"""Column functions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import arith, cast, dates, lists, logic, text
from recordloom.operators import reshape, schema
from recordloom.plans import Tables, query

_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()


@query("""
SELECT vec_id, len(embedding) AS size, embedding[1] AS first, embedding[-1] AS last, embedding[3] AS third,
       array_to_string(list_transform(embedding[2:4], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',') AS cut,
       CAST(ceil(len(embedding) / 10.0) AS BIGINT) AS chunks,
       len(embedding) - 10 * ((len(embedding) - 1) // 10) AS last_chunk,
       len(list_distinct(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10) AS INTEGER)))) AS distinct_tenths,
       list_max(embedding) AS top, list_min(embedding) AS bottom,
       list_sort(embedding)[1] AS sorted_first, list_reverse_sort(embedding)[1] AS sorted_down_first,
       len(list_filter(embedding, lambda x: x > 0)) AS positive,
       list_reverse(embedding)[1] AS reversed_first
FROM embeddings
""")
def list_ops_chunk_zip_unique(t: Tables) -> DataFrame:
    e = F.col("embedding")
    kind = t.embeddings.schema["embedding"].dataType
    milli = lambda x: F.round(x.cast("double") * 1000).cast("long")
    tenths = F.transform(e, lambda x: F.round(x.cast("double") * 10).cast("int"))
    return t.embeddings.select(
        "vec_id",
        lists.count(e, kind).alias("size"),
        lists.first(e).alias("first"),
        lists.last(e).alias("last"),
        lists.item(e, 2).alias("third"),
        text.join(F.transform(lists.slice_list(e, 1, 4), milli), T.ArrayType(_LONG)).alias("cut"),
        F.size(lists.chunk(e, 10)).cast("long").alias("chunks"),
        F.size(lists.last(lists.chunk(e, 10))).cast("long").alias("last_chunk"),
        F.size(lists.unique(tenths)).cast("long").alias("distinct_tenths"),
        lists.maximum(e).alias("top"),
        lists.minimum(e).alias("bottom"),
        lists.first(lists.sort(e)).alias("sorted_first"),
        lists.first(lists.sort(e, descending=True)).alias("sorted_down_first"),
        F.size(lists.keep(e, lambda x: x > 0)).cast("long").alias("positive"),
        lists.first(lists.reverse(e)).alias("reversed_first"),
    )


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, [l_linenumber, CAST(l_quantity AS INTEGER), l_linenumber, 1] AS n,
                  [CAST(l_quantity AS BIGINT), l_suppkey, NULL] AS q FROM lineitem)
SELECT l_orderkey, l_partkey, CAST(3 AS BIGINT) AS pairs, n[1] || '*' || q[1] || ' ' || n[2] || '*' || q[2] || ' ' || n[3] || '*' AS zipped,
       CAST(q[1] + q[2] AS DOUBLE) AS total, (q[1] + q[2]) / 2 AS average, (q[1] + q[2]) / 2 AS middle,
       coalesce(array_to_string(list_filter(n, lambda x: x <> 1), ','), '') AS without_one,
       len(list_filter(q, lambda x: x > 45)) > 0 AS any_large, false AS all_large
FROM a
""")
def list_aggregates_zip(t: Tables) -> DataFrame:
    small, quantity = F.col("l_linenumber"), F.col("l_quantity")
    rows = t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        F.array(small, quantity.cast("int"), small, F.lit(1)).alias("n"),
        F.array(quantity.cast("long"), F.col("l_suppkey"), F.lit(None)).alias("q"),
    )
    n, q = F.col("n"), F.col("q")
    pair = lambda p: F.concat(p["left"].cast("string"), F.lit("*"), F.coalesce(p["right"].cast("string"), F.lit("")))
    flags = T.ArrayType(T.BooleanType())
    return rows.select(
        "l_orderkey",
        "l_partkey",
        F.size(lists.zip_lists(n, q)).cast("long").alias("pairs"),
        F.array_join(F.transform(lists.zip_lists(n, q), pair), " ").alias("zipped"),
        lists.total(q).alias("total"),
        lists.average(q).alias("average"),
        lists.median(q).alias("middle"),
        text.join(lists.difference(n, F.array(F.lit(1))), T.ArrayType(T.IntegerType())).alias("without_one"),
        lists.any_of(F.transform(q, lambda x: x > 45), flags).alias("any_large"),
        lists.all_of(F.transform(q, lambda x: x > 5), flags).alias("all_large"),
    )


@query("""
SELECT event_id, 'event_type,k,value' AS names, event_type || ',' || json_extract_string(props, '$.k') || ',' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS held,
       CAST(2 AS BIGINT) AS picked, 'event_type,value' AS omitted, true AS has_k,
       json_extract_string(props, '$.k') AS merged_k, CAST(3 AS BIGINT) AS size
FROM events
""")
def object_ops_pick_omit_entries(t: Tables) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    own = F.create_map(
        F.lit("event_type"), F.col("event_type"), F.lit("value"), F.round(F.col("value") * 100).cast("long").cast("string"),
        F.lit("k"), F.lit("old"),
    )
    merged = lists.merge(own, props)
    rows = t.events.select("event_id", merged.alias("o"))
    o, kind = F.col("o"), T.MapType(_STRING, _STRING)
    ordered = F.sort_array(lists.entries(o))
    return rows.select(
        "event_id",
        F.array_join(F.sort_array(lists.keys(o)), ",").alias("names"),
        F.array_join(F.transform(ordered, lambda e: e["value"]), ",").alias("held"),
        lists.count(lists.pick(o, "k", "value", "absent"), kind).alias("picked"),
        F.array_join(F.sort_array(lists.keys(lists.omit(o, "k", "absent"))), ",").alias("omitted"),
        logic.contains(o, kind, "k").alias("has_k"),
        F.try_element_at(o, F.lit("k")).alias("merged_k"),
        lists.count(o, kind).alias("size"),
    )


@query("""
WITH n AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, nullif(o_orderpriority, '5-LOW') AS p FROM orders)
SELECT o_orderkey, s IS NOT DISTINCT FROM 'F' AS eq, s IS DISTINCT FROM 'F' AS ne, s IS NULL AS is_null,
       s IS NULL AS is_empty, coalesce(s, p, '?') AS first_known, coalesce(s, 'none') AS with_default,
       s < 'O' AS lt, s >= 'O' AS ge, coalesce(contains(p, 'URG'), false) AS holds,
       coalesce(p, 'none') AS or_value, CASE WHEN s IS NULL THEN NULL ELSE p END AS and_value,
       CASE WHEN s IS NULL THEN 'no' ELSE 'yes' END AS ternary
FROM n
""")
def compare_null_safe(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey", F.expr("nullif(o_orderstatus, 'P')").alias("s"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("p")
    )
    s, p = F.col("s"), F.col("p")
    return rows.select(
        "o_orderkey",
        logic.eq(s, F.lit("F")).alias("eq"),
        logic.ne(s, F.lit("F")).alias("ne"),
        logic.is_null(s).alias("is_null"),
        logic.is_empty(s, _STRING).alias("is_empty"),
        logic.coalesce(s, p, F.lit("?")).alias("first_known"),
        logic.default(s, _STRING, F.lit("none")).alias("with_default"),
        logic.lt(s, F.lit("O")).alias("lt"),
        logic.ge(s, F.lit("O")).alias("ge"),
        logic.contains(p, _STRING, "URG").alias("holds"),
        logic.or_value(p, _STRING, F.lit("none")).alias("or_value"),
        logic.and_value(s, _STRING, p).alias("and_value"),
        logic.ternary(s, _STRING, F.lit("yes"), F.lit("no")).alias("ternary"),
    )


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       CAST(floor((l_partkey - 1000) / 7.0) AS BIGINT) AS floordiv,
       (((l_partkey - 1000) % 7) + 7) % 7 AS mod,
       CAST(round_even(l_extendedprice / 8, 0) AS BIGINT) AS rounded,
       CAST(floor(l_extendedprice) AS BIGINT) AS low, CAST(ceil(l_extendedprice) AS BIGINT) AS high,
       abs(l_partkey - 1000) AS magnitude, -l_partkey AS negated,
       CAST(l_linenumber AS BIGINT) * l_linenumber * l_linenumber AS cubed,
       l_quantity + l_tax AS added, l_quantity - l_tax AS less, l_quantity * l_tax AS times, l_quantity / 4 AS quarter
FROM lineitem
""")
def arith_floor_mod_round(t: Tables) -> DataFrame:
    shifted, price, quantity, tax = F.col("l_partkey") - 1000, F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        arith.floordiv(shifted, F.lit(7)).alias("floordiv"),
        arith.mod(shifted, F.lit(7)).alias("mod"),
        arith.round_to(price / 8).alias("rounded"),
        arith.floor(price).alias("low"),
        arith.ceil(price).alias("high"),
        arith.absolute(shifted).alias("magnitude"),
        arith.neg(F.col("l_partkey")).alias("negated"),
        arith.power_whole(F.col("l_linenumber"), 3).alias("cubed"),
        arith.add(quantity, tax).alias("added"),
        arith.sub(quantity, tax).alias("less"),
        arith.mul(quantity, tax).alias("times"),
        arith.div(quantity, F.lit(4)).alias("quarter"),
    )


@query("""
SELECT c_custkey, greatest(0.0, least(5000.0, c_acctbal)) AS clamped,
       coalesce(c_acctbal / nullif(CAST(c_nationkey AS DOUBLE), 0), -1.0) AS per_nation,
       repeat('*', c_nationkey) AS stars
FROM customer
""")
def clamp_divsafe(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey",
        arith.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("clamped"),
        arith.div_safe(F.col("c_acctbal"), F.col("c_nationkey"), -1.0).alias("per_nation"),
        arith.repeat_text(F.col("c_nationkey"), F.lit("*")).alias("stars"),
    )


@query(r"""
SELECT p_partkey, upper(p_name) AS upper, lower(p_brand) AS lower, p_name AS trimmed, trim(p_name, 'slg') AS trimmed_chars,
       array_to_string(string_split(p_name, ' '), '|') AS parts, replace(p_name, 'e', '3') AS replaced,
       starts_with(p_name, 'red') AS starts, ends_with(p_name, 'bolt') AS ends_bolt, regexp_matches(p_brand, '#1\d') AS matched,
       CASE WHEN length(p_name) >= 12 THEN p_name ELSE lpad(p_name, 12, '.') END AS padded_left,
       CASE WHEN length(p_name) >= 12 THEN p_name ELSE rpad(p_name, 12, '.') END AS padded_right,
       CASE WHEN length(p_name) > 9 THEN left(p_name, 6) || '...' ELSE p_name END AS short,
       array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
       'part ' || p_partkey || ' is ' || p_name || ' {}' AS formatted
FROM part
""")
def text_ops(t: Tables) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    return t.part.select(
        "p_partkey",
        text.upper(name).alias("upper"),
        text.lower(brand).alias("lower"),
        text.trim(F.concat(F.lit(" \t"), name, F.lit("\n "))).alias("trimmed"),
        text.trim(name, "slg").alias("trimmed_chars"),
        text.join(text.split(name, " "), T.ArrayType(_STRING), "|").alias("parts"),
        text.replace(name, "e", "3").alias("replaced"),
        text.starts_with(name, "red").alias("starts"),
        text.ends_with(name, "bolt").alias("ends_bolt"),
        text.matches(brand, r"#1\d").alias("matched"),
        text.pad_left(name, 12, ".").alias("padded_left"),
        text.pad_right(name, 12, ".").alias("padded_right"),
        text.truncate(name, 9).alias("short"),
        text.title(F.col("p_type")).alias("title"),
        text.format_text("part {} is {} {}", (F.col("p_partkey"), _LONG), (name, _STRING)).alias("formatted"),
    )


@query(r"""
SELECT p_partkey, CAST(regexp_extract(p_brand, '(\d+)', 1) AS VARCHAR) AS number,
       nullif(regexp_extract(p_brand, '1(\d)', 1), '') AS after_one,
       trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
       p_brand || ': ' || p_name || ' (' || p_size || ')' AS label,
       array_to_string(regexp_extract_all(p_name, '[aeiou]'), '') AS vowels
FROM part
""")
def text_extract_template_slug(t: Tables) -> DataFrame:
    columns = {n: schema.field(t.part, n) for n in ("p_brand", "p_name", "p_size")}
    return t.part.select(
        "p_partkey",
        text.extract(F.col("p_brand"), r"(\d+)", 1).alias("number"),
        text.extract(F.col("p_brand"), r"1(\d)", 1).alias("after_one"),
        text.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"),
        text.template("{p_brand}: {p_name} ({p_size})", columns).alias("label"),
        F.array_join(text.extract_all(F.col("p_name"), "[aeiou]"), "").alias("vowels"),
    )


@query(r"""
SELECT page_id, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang, 'page ' || page_id || ' {at} ' || url AS line FROM pages
""")
def extract_interpolate(t: Tables) -> DataFrame:
    rows = reshape.extract_column(t.pages.select("page_id", "url"), "url", "/([a-z]{2})/", into="lang")
    columns = {n: schema.field(rows, n) for n in ("page_id", "url")}
    return rows.withColumn("line", text.interpolate("page {{page_id}} {at} {{ url }}", columns)).drop("url")


@query(r"""
SELECT page_id, url_encode(url) AS encoded, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
       nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS paragraphs
FROM pages
""")
def url_codec(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id",
        text.url_encode(url).alias("encoded"),
        text.extract(url, r"^https?://([^/]+)", 1).alias("host"),
        text.extract(url, r"[?&]page=(\d+)", 1).alias("page"),
        F.size(text.extract_all(F.col("html"), "<p>")).cast("long").alias("paragraphs"),
    )


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'object' AS kind, 'number' AS k_kind,
       '{"id":' || event_id || ',"type":' || coalesce('"' || nullif(event_type, 'error') || '"', 'null') || ',"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS encoded
FROM events
""")
def json_codec(t: Tables) -> DataFrame:
    v = text.json_parse(F.col("props"))
    rows = t.events.withColumn("v", v).withColumn("k", F.variant_get("v", "$.k", "long"))
    record = F.struct(F.col("event_id").alias("id"), F.expr("nullif(event_type, 'error')").alias("type"), "k")
    return rows.select(
        "event_id",
        "k",
        cast.type_of(F.col("v"), T.VariantType()).alias("kind"),
        cast.type_of(F.variant_get("v", "$.k", "variant"), T.VariantType()).alias("k_kind"),
        text.json_encode(record).alias("encoded"),
    )


@query("""
SELECT c_custkey, CAST(format('{:.2f}', c_acctbal) AS DOUBLE) AS money, c_nationkey / 100.0::DOUBLE AS percent,
       CAST(c_custkey * 1000 AS DOUBLE) AS grouped, CAST(trunc(c_acctbal) AS BIGINT) AS whole,
       c_custkey * 1000 AS exact, CAST(NULL AS DOUBLE) AS unreadable, -1.0::DOUBLE AS fallback,
       c_nationkey > 12 AS flag, 'string' AS kind
FROM customer
""")
def cast_number_text(t: Tables) -> DataFrame:
    """Money, percent and grouped digits are first written as text, then read back."""
    money = F.concat(F.lit(" $"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit(" "))
    negative = F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    money = F.when(F.col("c_acctbal") < 0, negative).otherwise(money)
    rows = t.customer.select(
        "c_custkey",
        money.alias("money"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit("%")).alias("percent"),
        F.concat(F.lit("1_"), F.format_number(F.col("c_custkey") * 1000, 0)).alias("grouped"),
        F.when(F.col("c_nationkey") > 12, " Yes ").otherwise("OFF").alias("flag"),
        "c_mktsegment",
    )
    grouped = F.regexp_replace("grouped", "^1_", "")
    text_of = lambda c: cast.number(c, _STRING)
    return rows.select(
        "c_custkey",
        text_of(F.col("money")).alias("money"),
        text_of(F.col("percent")).alias("percent"),
        text_of(grouped).alias("grouped"),
        cast.integer(F.col("money"), _STRING).alias("whole"),
        cast.integer(F.concat(F.lit("€"), grouped), _STRING).alias("exact"),
        text_of(F.col("c_mktsegment")).alias("unreadable"),
        cast.number(F.col("c_mktsegment"), _STRING, fallback=-1.0).alias("fallback"),
        cast.boolean(F.col("flag"), _STRING).alias("flag"),
        cast.type_of(F.col("flag"), _STRING).alias("kind"),
    )


@query("""
SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS total, CAST(o_custkey AS VARCHAR) AS customer,
       o_orderpriority NOT LIKE '5%' AND o_orderpriority NOT LIKE '4%' AS urgent, CAST(NULL AS DOUBLE) AS status
FROM orders
""")
def cast_schema(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("total"),
        F.col("o_custkey").alias("customer"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("4", "5"), "no").otherwise("y").alias("urgent"),
        F.col("o_orderstatus").alias("status"),
    )
    wanted = {"total": "integer", "customer": "string", "urgent": "boolean", "status": "number", "absent": "number"}
    return schema.cast_schema(rows, wanted)


@query("""
SELECT o_orderkey, o_orderdate AS iso, o_orderdate AS slashed, o_orderdate AS named, o_orderdate AS digits,
       o_orderdate AS stamped, o_orderdate AS epoch, o_orderdate AS millis, o_orderdate - INTERVAL 2 HOUR AS zoned, o_orderdate AS given,
       strftime(o_orderdate, '%d.%m.%Y') AS shown, o_orderdate + INTERVAL 36 HOUR - INTERVAL 90 SECOND AS later
FROM orders
""")
def date_ops(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    read = lambda c: dates.to_date(c, _STRING)
    day = F.date_format(d, "yyyy-MM-dd")
    # A day above 12 first reads as day/month; below, the same text is read that way too.
    slashed = F.date_format(d, "dd/MM/yyyy")
    return t.orders.select(
        "o_orderkey",
        read(day).alias("iso"),
        read(slashed).alias("slashed"),
        read(F.date_format(d, "dd-MMM-yyyy")).alias("named"),
        read(F.date_format(d, "yyyyMMdd")).alias("digits"),
        read(F.concat(day, F.lit(" 00:00:00"))).alias("stamped"),
        dates.to_date(dates.timestamp(d).cast("long"), _LONG).alias("epoch"),
        dates.to_date((dates.timestamp(d) * 1000).cast("long"), _LONG).alias("millis"),
        read(F.concat(day, F.lit("T00:00:00+02:00"))).alias("zoned"),
        dates.to_date(F.date_format(d, "MM/dd/yyyy"), _STRING, "%m/%d/%Y").alias("given"),
        dates.date_format(d, "%d.%m.%Y").alias("shown"),
        dates.date_add(d, days=1.5, minutes=-1.5).alias("later"),
    )


@query("""
WITH g AS (SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 06:30:00', ts) AS us, epoch_us(ts) AS since FROM events)
SELECT event_id, us / 1e6 AS seconds, us / 1e6 / 60 AS minutes, us / 1e6 / 3600 AS hours, us / 1e6 / 86400 AS days,
       us / 1e6 / 604800 AS weeks, since / 1e6 AS epoch
FROM g
""")
def date_diff_units(t: Tables) -> DataFrame:
    start = F.lit("2024-01-01 06:30:00").cast("timestamp_ntz")
    units = [dates.date_diff(F.col("ts"), start, u).alias(u) for u in dates.UNIT_SECONDS]
    return t.events.select("event_id", *units, dates.timestamp(F.col("ts")).alias("epoch"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice * l_suppkey * 1000 AS VARCHAR) AS large,
       CAST(l_tax / 1e5 AS VARCHAR) AS small, CAST(l_discount AS VARCHAR) AS plain, CAST(l_quantity > 25 AS VARCHAR) AS flag
FROM lineitem
""")
def number_text(t: Tables) -> DataFrame:
    line = t.lineitem
    shown = lambda c: text.stringify(c, _DOUBLE)
    return line.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        shown(F.col("l_extendedprice") * F.col("l_suppkey") * 1000).alias("large"),
        shown(F.col("l_tax") / 1e5).alias("small"),
        shown(F.col("l_discount")).alias("plain"),
        text.stringify(F.col("l_quantity") > 25, T.BooleanType()).alias("flag"),
    )


@query("""
SELECT o_orderkey, o_shippriority = 0 AS not_truthy, o_orderstatus <> 'P' AS not_kept,
  CASE WHEN o_orderstatus = 'F' THEN o_clerk ELSE '' END AS and_text, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE o_clerk END AS or_text,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS listed,
  o_orderkey || ',' || o_custkey || ',' || o_orderkey AS flat, o_custkey || ',' || o_custkey AS inner_firsts,
  array_to_string(list_transform(string_split(o_orderpriority, '-'), lambda x: trim(x)), '|') AS parts,
  regexp_replace(o_clerk, '[^a-zA-Z0-9]+', '-', 'g') AS slugged, upper(o_orderpriority) || '!' AS piped
FROM (SELECT *, 0 AS o_shippriority, 'Clerk#' || o_custkey || ' x' AS o_clerk FROM orders)
""")
def small_forms(t: Tables) -> DataFrame:
    """Not, and, or, as a list, flat lists, trimmed parts, slugs that keep case, and values handed through functions."""
    rows = t.orders.withColumn("clerk", F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string"), F.lit(" x")))
    status = F.col("o_orderstatus")
    some = F.when(status == "F", "F").otherwise("")
    nested = F.array(F.array("o_orderkey", "o_custkey"), F.array("o_orderkey"))
    pairs = F.create_map(F.lit("a"), F.col("o_custkey"), F.lit("b"), F.col("o_custkey"))
    longs = T.ArrayType(_LONG)
    piped = lambda c, *steps: c if not steps else piped(steps[0](c), *steps[1:])
    return rows.select(
        "o_orderkey",
        logic.negate(F.lit(0), T.IntegerType()).alias("not_truthy"),
        logic.negate(F.when(status == "P", "x").otherwise(""), _STRING).alias("not_kept"),
        logic.and_value(some, _STRING, F.col("clerk")).alias("and_text"),
        logic.or_value(some, _STRING, F.col("clerk")).alias("or_text"),
        F.size(cast.as_list(F.when(status != "P", status), _STRING)).alias("listed"),
        text.join(lists.flatten_lists(nested), longs).alias("flat"),
        text.join(lists.project(pairs, T.MapType(_STRING, _LONG)), longs).alias("inner_firsts"),
        text.join(text.split_trimmed(F.col("o_orderpriority"), "-"), T.ArrayType(_STRING), "|").alias("parts"),
        text.slug(F.col("clerk"), lower_case=False).alias("slugged"),
        piped(F.col("o_orderpriority"), text.upper, lambda c: F.concat(c, F.lit("!"))).alias("piped"),
    )
