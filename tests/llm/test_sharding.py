import zlib

from pyspark.sql import functions as F

from recordloom.llm import sharding


def test_contract(spark, documents):
    docs = documents(*[(i, None if i % 50 == 0 else "é" * (i % 7), "en") for i in range(3000)]).repartition(5)
    rows = {r.doc_id: r for r in sharding.shard_documents(docs).collect()}
    assert len(rows) == 3000
    for r in rows.values():
        text = "" if r.doc_id % 50 == 0 else "é" * (r.doc_id % 7)
        assert (r.size, r.text_crc32, r.law) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "key")
        assert r.grown_shard in (r.shard, 8)
    for shard in range(8):
        own = sorted(r.slot for r in rows.values() if r.shard == shard)
        assert own == list(range(len(own))) and 280 < len(own) < 470
    assert 230 < sum(r.grown_shard == 8 for r in rows.values()) < 440


def test_key_alone_decides(documents):
    some = {r.doc_id: r.shard for r in sharding.shard_documents(documents(*[(i, "a", "en") for i in range(100)])).collect()}
    more = {r.doc_id: r.shard for r in sharding.shard_documents(documents(*[(i, "b" * i, "de") for i in range(50, 150)])).collect()}
    assert all(some[i] == more[i] for i in range(50, 100))


def replay(key, tree):
    """The descent in plain Python, with the public xxHash."""
    import math

    import xxhash

    key = "\x00null" if key is None else str(key)

    def least(children):
        def draw(name):
            seed = xxhash.xxh64(name.encode(), seed=42).intdigest()
            unit = ((xxhash.xxh64(key.encode(), seed=seed).intdigest() >> 11) + 1) / 2**53
            return -math.log(unit) / children[name], name

        return min((n for n, w in children.items() if w > 0), key=draw)

    def summed(leaves, name):
        sums = {}
        for x in leaves:
            sums[name(x)] = sums.get(name(x), 0) + x.weight
        return sums

    region = least(summed(tree, lambda x: x.region))
    rack = least(summed([x for x in tree if x.region == region], lambda x: x.rack))
    return int(least(summed([x for x in tree if (x.region, x.rack) == (region, rack)], lambda x: str(x.shard))))


def test_against_a_replay_of_the_tree(spark):
    keys = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    for tree in (sharding.layout(8), sharding.layout(11), sharding.reweighted(sharding.layout(8), {1: 5.0, 3: 0.0, 4: 0.5})):
        got = keys.select("id", sharding.shard_of(F.col("id"), tree).alias("s")).collect()
        assert {r.id: r.s for r in got} == {r.id: replay(r.id, tree) for r in got}


def _moves(spark, old, new, n=20000):
    key = F.col("id")
    return spark.range(n).select(sharding.shard_of(key, old).alias("a"), sharding.shard_of(key, new).alias("b")).groupBy("a", "b").count().collect()


def test_weights_hold(spark):
    tree = sharding.reweighted(sharding.layout(8), {0: 3.0, 5: 0.0})
    counts = dict(spark.range(50000).groupBy(sharding.shard_of(F.col("id"), tree).alias("s")).count().collect())
    assert 5 not in counts and abs(counts[0] / 50000 - 3 / 9) < 0.02 and abs(counts[7] / 50000 - 1 / 9) < 0.02


def test_movement_stays_in_changed_subtrees(spark):
    old = sharding.layout(8)
    new = sharding.reweighted(old, {0: 4.0})
    place = {x.shard: (x.region, x.rack) for x in old}
    for a, b, _ in _moves(spark, old, new):
        if a != b:  # only into the region whose weight grew, and there out of racks that did not grow
            assert place[b][0] == place[0][0]
            assert place[a][0] != place[b][0] or place[b][1] == place[0][1]
            assert place[a] != place[b] or b == 0


def test_growth_moves_rows_only_to_the_new_shard(spark):
    for n in (8, 9, 12):
        assert all(a == b or b == n for a, b, _ in _moves(spark, sharding.layout(n, base=8), sharding.layout(n + 1, base=8), 5000))


def test_odd_rows(odd, empty, clashing):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == 10 and {r.size for r in rows if r.doc_id == 1} == {1} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({(r.shard, r.slot) for r in rows}) == 10
    assert sharding.shard_documents(empty).count() == 0
    assert sharding.shard_documents(clashing).columns == sharding.shard_documents(odd).columns
    assert sharding.shard_documents(clashing).count() == 10


def test_hot_key(documents, spark):
    docs = documents(*[(1, "same", "en")] * 700, *[(i, "x", "en") for i in range(2, 300)]).repartition(7)
    rows = sharding.shard_documents(docs).collect()
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
