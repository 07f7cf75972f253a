"""Sharding by a hierarchical weighted hash tree.

A row descends from the root over region and rack to its shard. At each level every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's own name, and the least
draw wins. A draw depends on nothing but the key, the child and its weight, so a changed weight
moves rows only into the subtrees that grew or out of those that shrank; rows of the other
subtrees never change places among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import stage

#: Children of a region and of a rack in the tree that ``layout`` builds.
FANOUT = 2


@dataclass(frozen=True)
class Leaf:
    """A shard: its place in the tree and its weight."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = 8, fanout: int = FANOUT) -> list[Leaf]:
    """Equal shards: the first ``base`` fill racks and regions, each later one is a region of its own.

    A new region takes rows only into itself, so each shard beyond ``base`` moves rows only to
    itself. Inside the base tree use ``reweighted``, which moves rows between changed subtrees.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    inner = [Leaf(f"region{i // fanout**2}", f"rack{i // fanout}", i) for i in range(min(shards, base))]
    return inner + [Leaf(f"region+{i}", f"rack+{i}", i) for i in range(base, shards)]


def reweighted(tree: list[Leaf], weights: dict[int, float]) -> list[Leaf]:
    """The same tree with other weights for some shards; weight 0 empties a shard."""
    return [Leaf(x.region, x.rack, x.shard, weights.get(x.shard, x.weight)) for x in tree]


def _children(tree: list[Leaf], path) -> list[tuple[str, float]]:
    """Names and summed weights below a node; nodes of weight 0 take part in no draw."""
    sums: dict[str, float] = {}
    for leaf in tree:
        name = path(leaf)
        if name is not None:
            sums[name] = sums.get(name, 0.0) + leaf.weight
    return [(name, weight) for name, weight in sums.items() if weight > 0]


def _drawn(key: Column, children: list[tuple[str, float]]) -> Column:
    """The child with the least weighted draw; the name decides ties."""
    if len(children) == 1:
        return F.lit(children[0][0])
    kids = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in children])

    def draw(kid: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(kid["name"], key), 11) + F.lit(1)).cast("double") / F.lit(float(2**53))
        return F.struct((-F.log(unit) / kid["weight"]).alias("draw"), kid["name"].alias("name"))

    return F.array_min(F.transform(kids, draw))["name"]


def _branch(node: Column, ways: dict[str, Column]) -> Column:
    names = list(ways)
    found = ways[names[-1]]
    for name in names[:-1]:
        found = F.when(node == name, ways[name]).otherwise(found)
    return found


def shard_of(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key. Equal keys share a shard; null is a key like any other."""
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    regions = _children(tree, lambda x: x.region)
    if not regions:
        raise ValueError("the tree has no weight")
    racks = {r: _children(tree, lambda x, r=r: x.rack if x.region == r else None) for r, _ in regions}
    shards = {
        (r, k): _children(tree, lambda x, r=r, k=k: str(x.shard) if (x.region, x.rack) == (r, k) else None)
        for r in racks for k, _ in racks[r]
    }
    inside = {r: _branch(_drawn(key, racks[r]), {k: _drawn(key, shards[r, k]) for k, _ in racks[r]}) for r in racks}
    return _branch(_drawn(key, regions), inside).cast("int")


def slots(placed: DataFrame, shard: str = "shard", out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in input order.

    The rows are written once with their input partition; a shard is numbered inside each of
    these, plus the rows of the same shard in earlier ones. A group thus holds a part of one
    input partition, however few shards there are and whatever the keys.
    """
    part, place = "__part", "__place"
    kept = stage(placed.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id()}), "slots")
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(shard, part).agg(F.count("*").alias("__n")).select(
        shard, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = F.row_number().over(Window.partitionBy(shard, part).orderBy(place)) - 1
    return kept.join(starts, [shard, part]).withColumn(out, F.col("__start") + inside).drop(part, place, "__start")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place all documents by the ``key`` law: the key and the number of shards decide.

    One row per input row: key, ``size`` (UTF-8 bytes plus 1; a null text has no bytes),
    ``text_crc32`` (of no bytes, thus 0, for a null text), ``law``, ``shard``, ``slot`` and
    ``grown_shard``, the place with one more shard. Repeated rows share a shard and have slots of
    their own, a null key is a key, no rows give no rows; other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), layout(shards)).alias("shard"),
        shard_of(F.col(key), layout(shards + 1, base=shards)).alias("grown_shard"),
    )
    return slots(placed)
