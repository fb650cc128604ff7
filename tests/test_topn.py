"""Top-n beyond the optimizer's group limit: rows drop by histograms before the shuffle."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.test_trips import frame, trip
from tripflow.operators import flows, layers
from tripflow.operators.topn import can_be_first, in_order, top_per_group


def plain(rows, n):
    """rows of (group, key, key, id): the first n of each group by keys, nulls first, NaN last."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[0]].append(row)

    def place(x):
        return (x is not None, x != x if x is not None else False, x if x is not None and x == x else 0)

    return {r for found in groups.values() for r in sorted(found, key=lambda r: (place(r[1]), place(r[2]), r[3]))[:n]}


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 40), (3, 1500), (4, 3000)])
def test_histograms_keep_all_first_rows(spark, seed, n):
    rng = random.Random(seed)
    ties = [None, 0.0, 1.0, 1.0, 1e12, -5.0, float("nan")]
    rows = [(rng.choice(["hot", "hot", None, "a"]), rng.choice(ties) if rng.random() < 0.8 else rng.random() * 10**rng.randrange(9),
             rng.choice([None, 1.5, rng.random()]), i) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, a double, b double, id long").repartition(5)
    keys = [F.col("a"), F.col("b")]
    want = plain(rows, n)
    left = can_be_first(df, ["g"], keys, n)
    assert {repr(r) for r in want} <= {repr(tuple(r)) for r in left.collect()}
    order = [F.asc_nulls_first("a"), F.asc_nulls_first("b"), F.asc("id")]
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "0")
    got = top_per_group(df, ["g"], order, n, keys=keys).drop("rank").collect()
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def many_flows(spark):
    """60,000 flows of one mode: nearly all of one trip, as in real trip tables."""
    ids = spark.range(60_000)
    return ids.select(
        F.lit("Q2 Thursday").alias("dataset"), F.lit(None).cast("string").alias("mode"),
        (30 + F.col("id") / 5000).alias("start_lat"), F.lit(1.0).alias("start_lng"), F.lit(2.0).alias("end_lat"),
        F.lit(3.0).alias("end_lng"), F.when(F.col("id") % 1000 == 0, F.col("id") + 2).otherwise(1).alias("trip_count"),
    )


def test_five_thousand_of_sixty_thousand_drop_before_the_shuffle(spark):
    df = many_flows(spark)
    left = can_be_first(df, ["dataset", "mode"], flows._size_keys(), 5000)
    assert 5000 <= left.count() < 5100
    top = top_per_group(df, ["dataset", "mode"], flows.largest_first(()), 5000, keys=flows._size_keys())
    plan = top._jdf.queryExecution().executedPlan().toString().splitlines()
    joins = [i for i, line in enumerate(plan) if "BroadcastHashJoin" in line]
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    # Plans print from the result down: the joins that drop rows lie below every shuffle.
    assert joins and shuffles and min(joins) > max(i for i in shuffles if i < min(joins))
    assert not [i for i in shuffles if i > min(joins)]
    everything = df.orderBy(F.desc("trip_count"), *in_order(["start_lat"])).limit(5000)
    assert {tuple(r) for r in top.drop("rank").collect()} == {tuple(r) for r in everything.collect()}


def test_large_samples_and_tops_equal_small_ways(spark):
    rng = random.Random(2)
    rows = [trip(start_lat=rng.randrange(400) / 8, mode=rng.choice(["A", None])) for _ in range(3000)]
    trips = frame(spark, rows)
    all_flows = flows.od_flows(trips)
    n = 90
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    large = [sorted(map(str, job().collect())) for job in (
        lambda: flows.top_flows(trips, n), lambda: flows.top_od(trips, n), lambda: layers.origin_sample(all_flows, n))]
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    small = [sorted(map(str, job().collect())) for job in (
        lambda: flows.top_flows(trips, n), lambda: flows.top_od(trips, n), lambda: layers.origin_sample(all_flows, n))]
    assert large == small
