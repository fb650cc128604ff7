"""Positions and sums over groups that span many partitions, against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tripflow.operators import context, prefix
from tests.test_context import LOG, START, entry


@pytest.fixture(autouse=True)
def several_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows_of(seed, n=3000):
    """A third of the rows in one group; keys far apart, with groups of one row and no key."""
    rng = random.Random(seed)
    keys = rng.sample(range(-10**12, 10**12), n)
    return [(rng.choice(["hot", None, "a", f"g{i}"]), k, rng.randrange(50)) for i, k in enumerate(keys)]


@pytest.mark.parametrize("seed", [1, 2])
def test_positions_and_suffix_sums_equal_loops(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    groups = defaultdict(list)
    for g, k, v in rows:
        groups[g].append((k, v))
    want_place, want_sum = set(), set()
    for g, found in groups.items():
        found.sort()
        for i, (k, v) in enumerate(found):
            want_place.add((g, k, v, i, len(found)))
            want_sum.add((g, k, v, sum(x for _, x in found[i:]), len(found) - i))
    assert {tuple(r) for r in prefix.positions(df, ["g"], ["k"]).collect()} == want_place
    dealt = prefix.dealt(df, ["g"], ["k"])
    assert dealt.filter("g = 'hot'").select("__part").distinct().count() > 1
    sums = prefix.suffix_sums(dealt, ["g"], {"s": F.col("v"), "n": F.lit(1)})
    assert {tuple(r) for r in sums.select("g", "k", "v", "s", "n").collect()} == want_sum


def test_positions_without_groups_with_ties_and_empty(spark):
    df = spark.createDataFrame([(3,), (None,), (3,), (1,)], "k long")
    got = sorted(tuple(r) for r in prefix.positions(df, [], ["k"]).select("position", "k", "group_rows").collect())
    assert got == [(0, None, 4), (1, 1, 4), (2, 3, 4), (3, 3, 4)]
    assert prefix.positions(df.filter("k > 5"), [], ["k"]).count() == 0


def test_no_window_spans_a_whole_log(spark):
    """One agent owns a third of a log whose positions are seconds, with gaps of years."""
    rng = random.Random(7)
    seconds = sorted(rng.sample(range(10**9), 1000)) + sorted(rng.sample(range(1_700_000_000, 1_700_100_000), 1000))
    rows = [entry(1, 0, "x" * 40)[:1] + (s,) + (START, None, "x" * 40) for s in seconds]
    rows += [(a, 5 * a, START, None, "y" * 40) for a in range(2, 4000)]
    log = spark.createDataFrame(rows, LOG).repartition(6)
    sums = context.token_suffix_sum(log)
    got = {r.idx: r.suffix_tokens for r in sums.filter("agent_id = 1").collect()}
    assert got == {s: 10 * (len(seconds) - i) for i, s in enumerate(seconds)}
    plan = sums._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__part" in line for line in windows)
    assert context.token_budget(log, 250).filter("agent_id = 1").count() == 25
