"""Landed pages of extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import aggregate, chains, extracts
from recordloom.plans import Tables, query
from recordloom.session import stage

PAGE_ROWS = 100


def landed_pages(t: Tables) -> DataFrame:
    """Orders as paged extracts, one source per status: a page is a JSON object of 100 orders.

    The cursor of a page names the next one; a source's last page has none. Pages come from
    bounded parts, so a source of any size is spread over many tasks. They are landed as a
    table, as an extract would be.
    """
    rows = t.orders.select("o_orderstatus", F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    parts = aggregate.group_records(rows, "o_orderstatus", ["id"], rows_per_part=PAGE_ROWS, unique=True)
    pages = parts.select(
        F.col("o_orderstatus").alias("source"),
        F.col("part").alias("page_no"),
        F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["customer"].alias("customer"))).alias("items"),
    )
    top = t.orders.groupBy(F.col("o_orderstatus").alias("source")).agg(F.floor((F.count("*") - 1) / PAGE_ROWS).alias("top"))
    following = F.when(F.col("page_no") < F.col("top"), (F.col("page_no") + 1).cast("string"))
    body = F.struct("items", F.struct(following.alias("next")).alias("meta"))
    link = F.concat(
        F.lit('<https://api.test/orders?page=0>; rel="first"'),
        F.coalesce(F.concat(F.lit(', <https://api.test/orders?page='), following, F.lit('>; rel="next"')), F.lit("")),
    )
    landed = pages.join(top, "source").select(
        "source",
        "page_no",
        F.concat(F.lit("https://api.test/orders?page="), F.col("page_no").cast("string")).alias("url"),
        F.create_map(F.lit("link"), link).alias("headers"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("body"),
    )
    return stage(landed, "pages")


def _id(item: str = "item") -> Column:
    return F.get_json_object(item, "$.id").cast("long")


@query("""
SELECT o_orderstatus AS source, 'items' AS how, CAST((n - 1) // 100 AS BIGINT) AS page_no, (n - 1) % 100 AS pos, o_orderkey AS id
FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
""")
def page_merge(t: Tables) -> DataFrame:
    merged = extracts.merge_pages(landed_pages(t))
    return merged.select("source", "how", "page_no", "pos", _id().alias("id"))


@query("SELECT o_orderstatus AS source, 'into' AS how, count(*) AS items, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1")
def page_merge_into(t: Tables) -> DataFrame:
    merged = extracts.merge_pages(landed_pages(t), into="items")
    return merged.groupBy("source", "how").agg(F.count("*").alias("items"), F.sum(_id()).alias("ids"))


_PAGES = """
WITH o AS (SELECT o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders),
     p AS (SELECT o_orderstatus AS source, CAST((n - 1) // 100 AS BIGINT) AS page_no, count(*) AS items FROM o GROUP BY 1, 2),
     q AS (SELECT *, max(page_no) OVER (PARTITION BY source) AS top FROM p)
"""


@query(_PAGES + """
SELECT 'cursor' AS strategy, source, page_no, items, page_no < top AS has_next,
       CASE WHEN page_no < top THEN NULL ELSE 'no cursor' END AS reason,
       CASE WHEN page_no < top THEN CAST(page_no + 1 AS VARCHAR) END AS next_token FROM q
UNION ALL SELECT 'link_header', source, page_no, items, page_no < top, CASE WHEN page_no < top THEN NULL ELSE 'no next link' END,
       CASE WHEN page_no < top THEN 'https://api.test/orders?page=' || (page_no + 1) END FROM q
UNION ALL SELECT 'offset', source, page_no, items, items >= 100, CASE WHEN items < 100 THEN 'short page' END, NULL FROM q
UNION ALL SELECT 'page', source, page_no, items, true, NULL, NULL FROM q
""")
def page_signals(t: Tables) -> DataFrame:
    pages = landed_pages(t)
    kept = ["strategy", "source", "page_no", "items", "has_next", "reason", "next_token"]
    made = [
        extracts.page_signals(pages, "cursor", cursor_path="meta.next").withColumn("strategy", F.lit("cursor")),
        extracts.page_signals(pages, "link_header").withColumn("strategy", F.lit("link_header")),
        extracts.page_signals(pages, "offset", size=PAGE_ROWS).withColumn("strategy", F.lit("offset")),
        extracts.page_signals(pages, "page").withColumn("strategy", F.lit("page")),
    ]
    out = made[0].select(*kept)
    for frame in made[1:]:
        out = out.unionByName(frame.select(*kept))
    return out


@query(_PAGES + """
, r AS (SELECT source, page_no, items, top FROM q UNION ALL SELECT source, page_no, items, top FROM q WHERE source = 'F' AND page_no = 0),
  s AS (SELECT * FROM r WHERE NOT (source = 'O' AND page_no = top))
SELECT source, count(*) AS pages, CAST(sum(items) AS BIGINT) AS items, source = 'F' AS repeated,
       source = 'O' AS truncated,
       CASE source WHEN 'F' THEN 'unknown' WHEN 'O' THEN 'partial' ELSE 'complete' END AS verdict
FROM s GROUP BY source
""")
def extract_completeness(t: Tables) -> DataFrame:
    """Source F repeats a request, source O stops before its last page, source P is whole."""
    pages = landed_pages(t)
    last = F.get_json_object("body", "$.meta.next").isNull()
    pages = pages.filter(~((F.col("source") == "O") & last))
    twice = pages.filter("source = 'F' and page_no = 0")
    signals = extracts.page_signals(pages.unionByName(twice), "cursor", cursor_path="meta.next")
    return extracts.extract_completeness(signals)


@query(_PAGES + """
SELECT source, count(*) AS pages, CAST(sum(items) AS BIGINT) AS items, source = 'O' AND max(top) > 1 AS repeated, false AS truncated,
       CASE WHEN source = 'O' AND max(top) > 1 THEN 'unknown' ELSE 'complete' END AS verdict
FROM q GROUP BY source
""")
def extract_completeness_token(t: Tables) -> DataFrame:
    """The token travels in a header, so all pages of a source share a url; source O sends one token twice."""
    pages = landed_pages(t)
    following = F.get_json_object("body", "$.meta.next")
    sent = F.when((F.col("source") == "O") & following.isNotNull(), F.lit("again")).otherwise(following)
    body = F.to_json(F.struct(F.from_json(F.get_json_object("body", "$.items"), "array<struct<id:bigint>>").alias("items"), sent.alias("next")))
    shared = pages.withColumn("body", body).withColumn("url", F.lit("https://api.test/orders"))
    signals = extracts.page_signals(shared, "token", cursor_path="next")
    return extracts.extract_completeness(signals, token_in_header=True)


@query(_PAGES + """
, s AS (SELECT source, max(page_no) = max(top) AND count(*) = count(DISTINCT page_no) AS whole FROM q GROUP BY source)
SELECT CASE WHEN bool_and(whole) THEN 'complete' ELSE 'partial' END AS verdict FROM s
""")
def extract_verdict(t: Tables) -> DataFrame:
    signals = extracts.page_signals(landed_pages(t), "cursor", cursor_path="meta.next")
    return extracts.overall_completeness(extracts.extract_completeness(signals))


@query(_PAGES + """
SELECT source, '{"meta":{"next":' || CASE WHEN first < top THEN '"' || (first + 1) || '"' ELSE 'null' END || '}}' AS fields
FROM (SELECT source, min(page_no) AS first, any_value(top) AS top FROM q GROUP BY source)
""")
def first_page_fields(t: Tables) -> DataFrame:
    return extracts.first_page_fields(landed_pages(t), "items")


def _asked(url: str = "url") -> Column:
    """The token in a page's address; the first page was asked for without one."""
    token = F.regexp_extract(url, "page=(.*)", 1)
    return F.when(token != "0", token)


def _shuffled(t: Tables) -> DataFrame:
    """The landed pages in another order and without their numbers."""
    signals = extracts.page_signals(landed_pages(t), "cursor", cursor_path="meta.next")
    return signals.drop("page_no").repartition(7, F.md5("body"))


@query("""
SELECT o_orderstatus AS source, CAST((n - 1) // 100 AS BIGINT) AS page_no, (n - 1) % 100 AS pos, o_orderkey AS id
FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
""")
def chained_merge(t: Tables) -> DataFrame:
    """Pages without numbers, ordered by their cursors, merge like numbered ones."""
    merged = extracts.merge_pages(chains.chain_pages(_shuffled(t), _asked()))
    return merged.select("source", "page_no", "pos", _id().alias("id"))


@query(_PAGES + """
, s AS (SELECT source, max(top) AS top FROM q GROUP BY 1)
SELECT source, top + 1 - CAST(source = 'F' AND top >= 3 AS INT) + CAST(source = 'P' AS INT) AS pages,
  CASE WHEN source = 'O' AND top >= 1 THEN 0 WHEN source = 'F' AND top >= 3 THEN 2 ELSE top + 1 END AS chained,
  CAST(source = 'P' AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS forks,
  CASE WHEN source = 'F' AND top >= 3 THEN top - 2 ELSE 0 END AS behind,
  CASE WHEN source = 'O' AND top >= 1 THEN top + 1 ELSE 0 END AS loops,
  CASE WHEN source = 'P' OR (source = 'O' AND top >= 1) THEN 'unknown' WHEN source = 'F' AND top >= 3 THEN 'partial' ELSE 'complete' END AS verdict
FROM s
""")
def chained_completeness(t: Tables) -> DataFrame:
    """Source F lacks its third page, the last page of O leads back to the second one, and P repeats its first."""
    pages = _shuffled(t)
    top = F.max(F.coalesce(_asked(), F.lit("0")).cast("int"))
    tops = pages.groupBy(F.col("source").alias("of")).agg(top.alias("top"))
    pages = pages.join(tops, F.col("source") == F.col("of")).drop("of")
    pages = pages.filter(~((F.col("source") == "F") & (F.col("top") >= 3) & _asked().eqNullSafe(F.lit("2"))))
    back = F.when((F.col("source") == "O") & (F.col("top") >= 1) & F.col("next_token").isNull(), "1").otherwise(F.col("next_token"))
    pages = pages.withColumn("next_token", back).drop("top")
    twice = pages.filter((F.col("source") == "P") & _asked().isNull())
    return chains.chain_completeness(chains.chain_pages(pages.unionByName(twice), _asked()))
