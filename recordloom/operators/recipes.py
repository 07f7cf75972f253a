"""Ready-made table work: trends, frequencies, sentiment, provider layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import cast
from recordloom.operators import ordering
from recordloom.operators.relate import lookup
from recordloom.operators.schema import col, field

# The words a text is scored by.
POSITIVE_WORDS = (
    "good", "great", "awesome", "excellent", "love", "amazing", "wonderful",
    "fantastic", "happy", "best", "brilliant", "perfect", "beautiful", "enjoy",
    "excited", "thanks", "thank", "nice", "cool", "superb", "outstanding",
)
NEGATIVE_WORDS = (
    "bad", "terrible", "hate", "awful", "worst", "horrible", "ugly", "boring",
    "disappointed", "angry", "sad", "poor", "annoying", "stupid", "fail",
    "broken", "sucks", "waste", "ridiculous", "pathetic",
)
FLAT_SLOPE = 0.01


def moving_average(
    df: DataFrame, value: str, order_by: Sequence[str], width: int = 7, places: int = 2,
    column: str = "moving_average", unique: bool = False,
) -> DataFrame:
    """Mean of the last ``width`` rows, null until that many were seen."""
    mean = lambda over: F.when(over(F.count("*")) == width, F.round(over(F.avg(col(value))), places))
    return ordering.plain(ordering.trailing(df, order_by, width, {column: mean}, unique=unique)).drop("__n")


def _indexed(df: DataFrame, value: str, order_by: Sequence[str], unique: bool) -> DataFrame:
    """``x, v, before``: place, value (0 when not a number) and the value before it."""
    c, dtype = field(df, value)
    rows = df.withColumn("__v", F.coalesce(cast.number(c, dtype), F.lit(0.0)))
    back = {"__before": lambda over: over(F.first("__v"))}
    paired = ordering.trailing(rows, order_by, 2, back, unique=unique, index="__x")
    return paired.withColumn("__before", F.when(F.col("__x") > 0, F.col("__before")))


def trend_analysis(df: DataFrame, value: str, order_by: Sequence[str], unique: bool = False) -> DataFrame:
    """One row: direction, slope, mean, std_dev, min, max, data_points, avg_change, avg_pct_change.

    Slope per row of the order; flat within 0.01 of zero. Change is the mean step from one
    row to the next, in value and in percent of the earlier value.
    """
    rows = _indexed(df, value, order_by, unique)
    step = F.col("__v") - F.col("__before")
    percent = F.when(F.col("__before") != 0, F.round(step / F.abs("__before") * 100, 2))
    found = rows.agg(
        F.regr_slope("__v", F.col("__x").cast("double")).alias("slope"),
        F.avg("__v").alias("mean"),
        F.stddev_pop("__v").alias("std_dev"),
        F.min("__v").alias("min"),
        F.max("__v").alias("max"),
        F.count("*").alias("data_points"),
        F.avg(step).alias("avg_change"),
        F.avg(percent).alias("avg_pct_change"),
    )
    slope = F.coalesce("slope", F.lit(0.0))
    direction = F.when(slope > FLAT_SLOPE, "upward").when(slope < -FLAT_SLOPE, "downward").otherwise("flat")
    return found.select(
        direction.alias("direction"),
        F.round(slope, 4).alias("slope"),
        F.round("mean", 4).alias("mean"),
        F.round("std_dev", 4).alias("std_dev"),
        "min",
        "max",
        "data_points",
        F.round(F.coalesce("avg_change", F.lit(0.0)), 4).alias("avg_change"),
        F.round(F.coalesce("avg_pct_change", F.lit(0.0)), 2).alias("avg_pct_change"),
    )


def anomalies(
    df: DataFrame, value: str, order_by: Sequence[str], threshold: float = 2.0, unique: bool = False
) -> DataFrame:
    """``index, value, z_score`` of values further than ``threshold`` deviations from the mean."""
    c, dtype = field(df, value)
    rows = df.withColumn("__v", F.coalesce(cast.number(c, dtype), F.lit(0.0)))
    stats = rows.agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std")).first()
    if not stats["std"]:
        score = F.lit(0.0)
    else:
        score = F.abs(F.col("__v") - F.lit(stats["mean"])) / F.lit(stats["std"])
    numbered = ordering.number_rows(rows, order_by, "index", start=0, unique=unique)
    return numbered.withColumn("__z", score).filter(F.col("__z") > threshold).select(
        "index", F.col("__v").alias("value"), F.round("__z", 2).alias("z_score")
    )


def summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, rows, min, max, avg`` of numeric readings, anything else counted as 0."""
    values = [F.coalesce(cast.number(col(n), df.schema[n].dataType), F.lit(0.0)) for n in names]
    parts = [F.count("*").alias("rows")]
    for i, v in enumerate(values):
        parts += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}"), F.round(F.avg(v), 2).alias(f"m{i}")]
    lines = [
        F.struct(F.lit(n).alias("column"), F.col("rows"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"), F.col(f"m{i}").alias("avg"))
        for i, n in enumerate(names)
    ]
    return df.agg(*parts).select(F.inline(F.array(*lines)))


def sentiment(c: Column) -> Column:
    """``struct<sentiment, margin>`` by distinct words found in two lists."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    hits = lambda lexicon: F.array_size(F.array_intersect(words, F.array(*[F.lit(w) for w in lexicon])))
    good, bad = hits(POSITIVE_WORDS), hits(NEGATIVE_WORDS)
    label = F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")
    return F.struct(label.alias("sentiment"), F.abs(good - bad).cast("long").alias("margin"))


def lexicon_sentiment(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__s", sentiment(col(text))).select(*[col(n) for n in df.columns], "__s.sentiment", "__s.margin")


def word_frequency(df: DataFrame, text: str, top: int | None = None) -> DataFrame:
    """``word, count`` of lower-case words cut at white space; the most frequent ``top``."""
    words = df.select(F.explode(F.split(F.lower(col(text)), r"(?U)\s+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "word").limit(top) if top is not None else counts


def shares(df: DataFrame, by: str) -> DataFrame:
    """``by, count, share``: each value's part of all rows, in percent to one place."""
    counts = df.groupBy(col(by)).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("__total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.round(F.col("count") / F.col("__total") * 100, 1)).drop("__total")


def completion_rate(df: DataFrame, by: str, done: Column) -> DataFrame:
    """``by, total, completed, pending, completion_rate``."""
    held = F.coalesce(done, F.lit(False))
    counts = df.groupBy(col(by)).agg(F.count("*").alias("total"), F.count_if(held).alias("completed"))
    return counts.withColumns(
        {
            "pending": F.col("total") - F.col("completed"),
            "completion_rate": F.round(F.col("completed") / F.col("total") * 100, 1),
        }
    )


def parallel_arrays(df: DataFrame, arrays: Sequence[str], required: str, keep: Sequence[str] = ()) -> DataFrame:
    """Lists side by side as rows, as long as the shortest; rows whose ``required`` is null go."""
    shortest = F.least(*[F.array_size(col(a)) for a in arrays]) if len(arrays) > 1 else F.array_size(col(arrays[0]))
    zipped = F.slice(F.arrays_zip(*[col(a) for a in arrays]), F.lit(1), F.greatest(shortest, F.lit(0)))
    rows = df.select(*[col(k) for k in keep], F.explode(zipped).alias("z"))
    return rows.select(*[col(k) for k in keep], *[F.col("z")[a].alias(a) for a in arrays]).filter(col(required).isNotNull())


def provider_normalise(df: DataFrame, provider: str, layout: dict[str, tuple[Sequence[str], object]]) -> DataFrame:
    """One provider's columns in the common layout, tagged with ``source``.

    ``layout`` maps a common name to the names tried in order and the default of the field.
    """
    out = [F.lit(provider).alias("source")]
    for name, (candidates, default) in layout.items():
        first = next((c for c in candidates if c in df.columns), None)
        out.append((col(first) if first else F.lit(default)).alias(name))
    return df.select(*out)


def profile_join(
    owners: DataFrame, records: DataFrame, owner_key: str, record_key: str, aggregates: dict[str, Column],
    defaults: dict[str, object],
) -> DataFrame:
    """Owners with aggregates over their records; owners without any get the defaults."""
    per_owner = records.groupBy(col(record_key).alias(owner_key)).agg(*[a.alias(n) for n, a in aggregates.items()])
    return lookup(owners, per_owner, owner_key, defaults)
