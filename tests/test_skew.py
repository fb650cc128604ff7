"""Hot keys are split at run time where a join meets a third of all rows on one key."""

import re

import pytest

from tests.test_routes import SEGMENTS, segments
from tests.test_trips import frame, trip
from tripflow.operators import flows, routes, schedule

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def skewed_joins(df):
    return len(re.findall(r"SortMergeJoin\(skew=true\)", final_plan(df)))


def hot_trips(spark, **changes):
    rows = [
        trip(person_id=1 if i % 3 else i, start_lat=30 + i / 1000, **changes) for i in range(6000)
    ]
    return frame(spark, rows).repartition(16)


def test_a_hot_person_is_split(small_partitions):
    spark = small_partitions
    people = spark.range(6000).selectExpr("'Q2' AS season", "id AS person_id").repartition(8)
    flow = flows.od_flows(hot_trips(spark), population=people)
    assert skewed_joins(flow) == 1
    assert flow.count() == 6000


def test_a_hot_route_is_split(small_partitions):
    spark = small_partitions
    rows = [
        trip(person_id=i, start_lat=30 + i / 1000, network_link_ids=[1, 2] if i % 3 else [1, 100 + i, 2])
        for i in range(6000)
    ]
    found = routes.trajectories(frame(spark, rows).repartition(16), segments(spark, SEGMENTS))
    assert skewed_joins(found) >= 1
    assert found.count() == 6000


def test_a_hot_link_is_split(small_partitions):
    spark = small_partitions
    rows = [
        trip(start_lat=30 + i / 1000, network_link_ids=[1, 1, 1000 + i, 2]) for i in range(4000)
    ]
    found = routes.route_patterns(frame(spark, rows).repartition(16), segments(spark, SEGMENTS))
    assert skewed_joins(found) >= 1
    assert found.count() == 4000


def test_a_hot_question_is_split(small_partitions):
    spark = small_partitions
    asks = spark.range(20000).selectExpr(
        "id AS request_id", "'rail' AS agency", "'A' AS origin_stop", "'B' AS dest_stop",
        "CAST(if(id % 3 = 0, id % 80000, 40000) AS int) AS now_secs",
    ).repartition(16)
    calls = [("rail", f"t{h}", s, i, f"{h:02d}:{10 * i:02d}:00", f"{h:02d}:{10 * i:02d}:00")
             for h in range(24) for i, s in enumerate("AB")]
    times = spark.createDataFrame(
        calls,
        "agency string, trip_id string, stop_id string, stop_sequence int, "
        "arrival_time string, departure_time string",
    )
    found = schedule.next_departure(asks, times)
    assert skewed_joins(found) >= 1
    assert found.filter("eta_min = 10").count() == 20000
