"""Trends, frequencies, sentiment and common layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators import recipes
from recordloom.plans import Tables, query


@query("""
SELECT event_id, CASE WHEN count(*) OVER w = 7 THEN round(avg(value) OVER w, 2) END AS moving_average FROM events
WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
""")
def moving_average_7(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", F.col("value").cast("decimal(18,2)").alias("value"))
    out = recipes.moving_average(rows, "value", ["ts", "event_id"], unique=True)
    return out.select("event_id", F.col("moving_average").cast("double").alias("moving_average"))


_TREND = """
WITH n AS (SELECT value AS v, row_number() OVER (ORDER BY ts, event_id) - 1 AS x, lag(value) OVER (ORDER BY ts, event_id) AS b FROM events),
     s AS (SELECT avg(v) AS mean, stddev_pop(v) AS std FROM n)
"""


@query(_TREND + """
SELECT CASE WHEN regr_slope(v, x) > 0.01 THEN 'upward' WHEN regr_slope(v, x) < -0.01 THEN 'downward' ELSE 'flat' END AS direction,
       round(regr_slope(v, x), 4) AS slope, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std_dev, min(v) AS min, max(v) AS max,
       count(*) AS data_points, round(avg(v - b), 4) AS avg_change,
       round(avg(CASE WHEN b <> 0 THEN round((v - b) / abs(b) * 100, 2) END), 2) AS avg_pct_change
FROM n
""")
def trend_analysis(t: Tables) -> DataFrame:
    return recipes.trend_analysis(t.events.select("value", "ts", "event_id"), "value", ["ts", "event_id"], unique=True)


@query(_TREND + """
SELECT x AS index, v AS value, round(abs(v - mean) / std, 2) AS z_score FROM n, s WHERE abs(v - mean) / std > 2
""")
def trend_anomalies(t: Tables) -> DataFrame:
    return recipes.anomalies(t.events.select("value", "ts", "event_id"), "value", ["ts", "event_id"], unique=True)


_POSITIVE = ", ".join(f"'{w}'" for w in recipes.POSITIVE_WORDS)
_NEGATIVE = ", ".join(f"'{w}'" for w in recipes.NEGATIVE_WORDS)


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents),
     s AS (SELECT doc_id, len(list_intersect(words, [{_POSITIVE}])) AS p, len(list_intersect(words, [{_NEGATIVE}])) AS n FROM w)
SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment, CAST(abs(p - n) AS BIGINT) AS margin FROM s
""")
def lexicon_sentiment(t: Tables) -> DataFrame:
    return recipes.lexicon_sentiment(t.documents.select("doc_id", "text"), "text").drop("text")


@query("""
SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word
""")
def word_frequency(t: Tables) -> DataFrame:
    return recipes.word_frequency(t.documents, "text")


@query("""
SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM conversations) WHERE word <> '' GROUP BY word
ORDER BY count DESC, word LIMIT 10
""")
def word_frequency_top(t: Tables) -> DataFrame:
    return recipes.word_frequency(t.conversations, "text", top=10)


@query("SELECT lang, count(*) AS count, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM documents) * 100, 1) AS share FROM documents GROUP BY lang")
def value_shares(t: Tables) -> DataFrame:
    return recipes.shares(t.documents, "lang")


@query("""
SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS completed, count(*) - count(*) FILTER (quality = 1) AS pending,
       round(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*) * 100, 1) AS completion_rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def completion_rate(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return recipes.completion_rate(rows, "source", F.col("quality") == 1)


@query("""
SELECT 'customers' AS source, c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer
UNION ALL SELECT 'suppliers', s_suppkey, s_name, s_acctbal FROM supplier
UNION ALL SELECT 'parts', p_partkey, p_name, 0.0 FROM part
""")
def provider_normalise(t: Tables) -> DataFrame:
    layout = {
        "id": (["id", "c_custkey", "s_suppkey", "p_partkey"], 0),
        "name": (["name", "c_name", "s_name", "p_name"], ""),
        "value": (["amount", "c_acctbal", "s_acctbal"], 0.0),
    }
    out = recipes.provider_normalise(t.customer, "customers", layout)
    out = out.unionByName(recipes.provider_normalise(t.supplier, "suppliers", layout))
    return out.unionByName(recipes.provider_normalise(t.part, "parts", layout))


@query("""
WITH a AS (SELECT vec_id, label, unnest(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN x END)) AS close,
                  unnest(range(len(embedding) + 1)[1:len(embedding)]) AS place FROM embeddings)
SELECT vec_id, place, close FROM a WHERE close IS NOT NULL
""")
def parallel_arrays(t: Tables) -> DataFrame:
    """Places and values side by side; there is one more place than there are values."""
    rows = t.embeddings.select(
        "vec_id",
        F.sequence(F.lit(0).cast("long"), F.array_size("embedding").cast("long")).alias("place"),
        F.transform("embedding", lambda x: F.when(x > 0, x)).alias("close"),
    )
    return recipes.parallel_arrays(rows, ["place", "close"], "close", ["vec_id"])


@query("""
SELECT c_custkey, c_name, coalesce(n, 0) AS orders, coalesce(total, 0.0) AS total, coalesce(top, 'none') AS top
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, max(o_orderpriority) AS top FROM orders GROUP BY 1) ON c_custkey = o_custkey
""")
def profile_join(t: Tables) -> DataFrame:
    owned = {
        "orders": F.count("*"),
        "total": F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double"), 2),
        "top": F.max("o_orderpriority"),
    }
    owners = t.customer.select("c_custkey", "c_name")
    return recipes.profile_join(owners, t.orders, "c_custkey", "o_custkey", owned, {"orders": 0, "total": 0.0, "top": "none"})


@query("""
SELECT 'l_quantity' AS "column", count(*) AS rows, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 2) AS avg FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), 0.0, 0.0, 0.0 FROM lineitem
""")
def numeric_summary(t: Tables) -> DataFrame:
    return recipes.summary(t.lineitem, ["l_quantity", "l_returnflag"])
