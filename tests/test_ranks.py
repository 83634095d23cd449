"""Ranks by ranges against sorting in one place."""

import random

from pyspark.sql import functions as F

from sievemark.operators import pricing, ranks


def test_ranks_are_those_of_a_sort(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    key = lambda r: (r[1] is not None, r[1] or 0, -r[2])
    out = ranks.ranked(df, ["g"], ["v", F.desc("id")], "rank")
    assert out.columns == ["g", "v", "id", "rank"]
    want = {(*r, k) for g in ("a", "b", None) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=key), 1)}
    assert {tuple(r) for r in out.collect()} == want
    whole = ranks.ranked(df, [], ["v", F.desc("id")], "rank")
    assert {tuple(r) for r in whole.collect()} == {(*r, k) for k, r in enumerate(sorted(rows, key=key), 1)}
    assert ranks.ranked(df.limit(0), ["g"], ["v"], "rank").count() == 0


def test_a_large_group_spreads_and_repeated_rows_count(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), (F.col("id") % 5000).alias("v"))
    out = ranks.ranked(df, ["g"], ["v"], "rank")
    assert out.agg(F.sum("rank"), F.count_distinct("rank"), F.max("rank")).first()[:] == (20_000 * 20_001 // 2, 20_000, 20_000)
    assert out.filter("v != floor((rank - 1) / 4)").count() == 0


def test_price_lists_are_checked(spark, monkeypatch):
    monkeypatch.setattr(pricing.small, "__defaults__", (3,))
    steps = spark.range(4).select(F.col("id").alias("at"), F.col("id").alias("v"))
    for call in (lambda: pricing.as_of(spark.range(1), "id", steps, "at", "v"), lambda: pricing.tier_faults(steps.selectExpr("at as low", "at as high", "v as code"))):
        try:
            call()
        except ValueError as fault:
            assert "at most 3" in str(fault)
        else:
            raise AssertionError("no check")
    few = pricing.as_of(spark.range(5), "id", steps.limit(2), "at", "v").collect()
    assert sorted((r.id, r.v) for r in few) == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 1)]


def test_first_key_goes_before_the_second(spark):
    df = spark.createDataFrame([(1, 10, "x"), (2, 20, "y"), (3, 30, "z")], "row long, a long, b string")
    other = spark.createDataFrame([(10, "y", 7), (None, "x", 5), (99, "y", 3), (None, None, 1)], "a long, b string, v long")
    assert sorted(map(tuple, pricing.first_of_keys(df, other, ["a", "b"], "v", "row").select("row", "v").collect()), key=str) == [(1, 7), (2, 3), (3, None)]
