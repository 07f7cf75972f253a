"""Search for a part of a text through an index of its trigrams.

The index is two tables. ``postings`` has a row for each trigram of a key's texts, laid out by
trigram and key, so a look-up reads few row groups and a trigram that a third of all keys hold is
spread over many files. ``counts`` tells how common each trigram is. Texts are compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.schema import col

LENGTH = 3
#: A look-up joins the postings of so many of the needle's trigrams, the least common ones.
JOINED = 4
#: Up to so many candidate keys are named in the filter that the scan of a table receives.
NAMED = 1000
#: Postings that a task sorts, and that it reduces to keys in a look-up, whatever the size of the tables.
SORTED, REDUCED = 2_000_000, 1_000_000
#: What stands for other characters in a pattern of LIKE.
WILD = ("%", "_")


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of the text in lower case; a null has none.

    The text is cut into characters once, so long texts cost their length.
    """
    runs = lambda c: F.transform(
        F.sequence(F.lit(1), F.size(c) - (LENGTH - 1)), lambda i: F.array_join(F.slice(c, i, F.lit(LENGTH)), "")
    )
    chars = F.transform(F.array(F.split(F.lower(text), "")), lambda c: F.array_distinct(runs(c)))
    return F.when(F.length(F.lower(text)) >= LENGTH, F.element_at(chars, 1)).otherwise(F.array().cast("array<string>"))


def add(texts: DataFrame, path: str, key: str = "key", text: str = "text") -> None:
    """Add texts (any number of rows per key) to the index at ``path``, which may be new.

    Postings are written before their counts, and look-ups take a trigram without a count for a rare
    one, so a run that ends between the two leaves an index that answers rightly. Texts added twice
    are found once. Null keys cannot be found and are left out.
    """
    found = texts.filter(col(key).isNotNull()).select(F.explode(trigrams(col(text))).alias("trigram"), col(key).alias("key"))
    upto = texts.agg(F.sum(F.length(col(text)))).first()[0] or 0  # a text has fewer trigrams than characters
    found.repartitionByRange(max(1, -(-upto // SORTED)), "trigram", "key").sortWithinPartitions("trigram", "key").write.mode("append").parquet(f"{path}/postings")
    added = found.groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))
    added.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("append").parquet(f"{path}/counts")


def needles(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams every text that contains the pattern must have; none with a wild card, none of short patterns."""
    found = spark.range(1).select(trigrams(F.lit(pattern)).alias("all")).first()["all"]
    return sorted(t for t in found if not any(w in t for w in WILD))


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """Keys whose texts hold the pattern's rarest trigrams; None where it has none and all rows must be read.

    A key is a candidate if its texts together hold them; the caller tests the rows themselves.
    """
    wanted = needles(spark, pattern)
    if not wanted:
        return None
    common = spark.read.parquet(f"{path}/counts").filter(F.col("trigram").isin(wanted)).groupBy("trigram").agg(F.sum("n").alias("n"))
    order = {r["trigram"]: r["n"] for r in common.collect()}
    rare = sorted(wanted, key=lambda t: (order.get(t, 0), t))[:JOINED]
    held = spark.read.parquet(f"{path}/postings").filter(F.col("trigram").isin(rare))
    which = sum((F.when(F.col("trigram") == t, 1 << i).otherwise(0) for i, t in enumerate(rare)), F.lit(0))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(order.get(t, 0) for t in rare) // REDUCED))
    dealt = held.select("key", which.alias("which")).repartition(parts, "key")  # a table that is joined to the keys is dealt alike
    return dealt.groupBy("key").agg(F.bit_or("which").alias("held")).filter(F.col("held") == (1 << len(rare)) - 1).select("key")


def among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``: by name in the scan's filter where they are few, else by a join."""
    few = [r["key"] for r in keys.limit(NAMED + 1).collect()]
    if len(few) <= NAMED:
        return df.filter(col(key).isin(few))
    return df.join(keys.select(F.col("key").alias("__key")), col(key) == F.col("__key"), "left_semi")
