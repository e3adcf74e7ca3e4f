"""Joins with one row per key, and the sizes they go by."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import lookup


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("weighted", [False, True])
def test_equals_a_plain_join(spark, how, limit, weighted):
    """A heavy key with a match, a heavy one without, null keys, light keys."""
    keys = [1] * 400 + [2] * 300 + [None] * 200 + list(range(3, 60)) * 2
    big = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k INT, i INT")
    dim = spark.createDataFrame([(k, f"v{k}", keys.count(k)) for k in [1, *range(3, 50), 1000]], "k INT, v STRING, n LONG")
    got = lookup.lookup_join(big, dim if weighted else dim.drop("n"), ["k"], how, weight="n" if weighted else None, broadcast_bytes=limit)
    want = big.join(dim.drop("n"), "k", how)
    assert sorted(map(tuple, got.select("k", "i", "v").collect()), key=repr) == sorted(map(tuple, want.select("k", "i", "v").collect()), key=repr)


def test_sizes_are_measured(spark):
    short = lookup.settled(spark.range(10).select("id", F.lit("x").alias("s")))
    long = lookup.settled(spark.range(10).select("id", F.repeat(F.lit("x"), 100_000).alias("s"), F.array(F.lit("ab")).alias("a")))
    assert short.size < 1000 and 1_000_000 < long.size < 1_010_000
    assert lookup.fits_broadcast(long.table, limit=2_000_000) and not lookup.fits_broadcast(long.table, limit=900_000)
    assert not lookup.fits_broadcast(short.table, 8, 40) and lookup.fits_broadcast(short.table, 8, 80)


def test_a_settled_table_is_not_computed_again(spark):
    dim = lookup.settled(spark.range(5).withColumnRenamed("id", "k"))
    context = spark.sparkContext
    context.setJobGroup("again", "again")
    try:
        lookup.lookup_join(spark.range(9).withColumnRenamed("id", "k"), dim, ["k"], "inner")
        assert not context.statusTracker().getJobIdsForGroup("again")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_only_hot_keys_are_dealt_out(spark):
    """Of a key with half of all rows the small rows are repeated, of the others not."""
    from rasterloom.operators import lookup

    big = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 5000).alias("k"), "id")
    hot = lookup.settle_hot(big.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")), 64).collect()
    assert [(r["k"], r["_parts"]) for r in hot] == [(-1, 64)]
    small = spark.range(-1, 3000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = lookup.salted_join(big, small, ["k"], ["id"])
    assert sorted(got.columns) == ["id", "k", "w"]
    want = big.join(small, "k")
    assert got.select("id", "k", "w").exceptAll(want.select("id", "k", "w")).isEmpty() and got.count() == want.count()
    assert lookup.salted_join(big.limit(0), small, ["k"], ["id"]).count() == 0
