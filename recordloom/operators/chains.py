"""Pages of an extract put in order by the tokens that lead from one to the next.

Where no page number was landed, a page is known by the token that asked for it and the token it
hands on. That is a list scattered over a table; its places are found by pointer doubling: every page
knows a page further on and how many steps away that is, and in each round takes over what that page
knows, so a chain of n pages takes log2 n rounds, each a join of narrow rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from recordloom.session import stage

# How a page stands to the chain of its source.
CHAINED, REPEATED, FORK, BEHIND_GAP, LOOP = "chained", "repeated", "fork", "behind a gap", "loop"


def _doubled(state: DataFrame, pages: int) -> DataFrame:
    """``id, ptr, hops, tail``: the last page each page leads to, and the steps to it.

    Pages that still point on after as many steps as there are pages lead into a loop.
    """
    reach = 1
    while reach <= pages and not state.filter("ptr is not null").isEmpty():
        further = state.select(F.col("id").alias("at"), F.col("ptr").alias("on"), F.col("hops").alias("more"), F.col("tail").alias("end"))
        waiting = state.filter("ptr is not null").join(further, F.col("ptr") == F.col("at"))
        moved = waiting.select("id", F.col("on").alias("ptr"), (F.col("hops") + F.col("more")).alias("hops"), F.col("end").alias("tail"))
        state = stage(state.filter("ptr is null").unionByName(moved), "chain")
        reach *= 2
    return state


def chain_pages(signals: DataFrame, asked: Column) -> DataFrame:
    """The pages with ``page_no`` and ``standing``, from their tokens alone.

    ``signals`` has ``source`` and ``next_token`` (see ``extracts.page_signals``); ``asked`` is the token a page
    was asked for with, null for a source's first page. Pages of one request are ``repeated`` but one, and have
    no number; nor have pages ``behind a gap``, which the first page does not lead to, and pages that lead into
    a ``loop``. Where several pages stand at one place of the chain, because two lead to the same page, all are a
    ``fork``. A column ``page_no`` of the input is replaced. Each round is a written table.
    """
    rows = signals.drop("page_no").withColumns({"__id": F.monotonically_increasing_id(), "__asked": asked.cast("string")})
    rows = stage(rows, "chained-pages")
    firsts = rows.groupBy("source", "__asked").agg(F.min("__id").alias("id"))
    nodes = rows.join(firsts.select("id"), F.col("__id") == F.col("id"), "left_semi").select("source", "__id", "__asked", "next_token")
    following = firsts.select(F.col("source").alias("of"), F.col("__asked").alias("token"), F.col("id").alias("ptr"))
    led = nodes.join(following, F.col("source").eqNullSafe(F.col("of")) & (F.col("next_token") == F.col("token")), "left")
    start = stage(
        led.select(
            F.col("__id").alias("id"), "ptr", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("hops"),
            F.when(F.col("ptr").isNull(), F.col("__id")).alias("tail"), "source", F.col("__asked").isNull().alias("first"),
        ), "chain",
    )
    ends = _doubled(start.select("id", "ptr", "hops", "tail"), start.count())
    placed = start.select("id", "source", "first").join(ends, "id")
    heads = placed.filter("first").select(F.col("source").alias("of"), F.col("tail").alias("head_tail"), F.col("hops").alias("length"))
    level = F.count("*").over(W.partitionBy("tail", "hops"))
    known = placed.withColumn("level", level).join(heads, F.col("source").eqNullSafe(F.col("of")), "left")
    reached = F.coalesce((F.col("tail") == F.col("head_tail")) & (F.col("hops") <= F.col("length")), F.lit(False))
    standing = F.when(F.col("tail").isNull(), LOOP).when(~reached, BEHIND_GAP).when(F.col("level") > 1, FORK).otherwise(CHAINED)
    found = known.select("id", F.when(reached, F.col("length") - F.col("hops")).alias("page_no"), standing.alias("standing"))
    return rows.join(found, F.col("__id") == F.col("id"), "left").withColumn("standing", F.coalesce("standing", F.lit(REPEATED))).drop("__id", "__asked", "id")


def chain_completeness(chained: DataFrame) -> DataFrame:
    """``source, pages, chained, repeated, forks, behind, loops, verdict`` of pages that ``chain_pages`` has placed.

    Repeated requests, forks and loops make a source unknown; pages behind a gap, no first page, or a last
    page that hands on a token make it partial.
    """
    counts = {"chained": CHAINED, "repeated": REPEATED, "forks": FORK, "behind": BEHIND_GAP, "loops": LOOP}
    per_source = chained.groupBy("source").agg(
        F.count("*").alias("pages"), *[F.count_if(F.col("standing") == s).alias(n) for n, s in counts.items()],
        F.max(F.when(F.col("page_no").isNotNull(), F.struct("page_no", F.col("next_token").isNotNull().alias("more")))).alias("last"),
    )
    odd = (F.col("repeated") > 0) | (F.col("forks") > 0) | (F.col("loops") > 0)
    cut = (F.col("behind") > 0) | F.coalesce(F.col("last.more"), F.lit(True))
    verdict = F.when(odd, "unknown").when(cut, "partial").otherwise("complete")
    return per_source.select("source", "pages", *counts, verdict.alias("verdict"))
