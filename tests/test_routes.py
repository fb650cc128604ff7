"""Trajectories, patterns and stitched lines on hand-made rows."""

import random
import time

from pyspark.sql import functions as F

from tests.test_trips import frame, trip
from tripflow.functions.geo import point_xy, stitch, trajectory_lines
from tripflow.operators import layers, routes


def segments(spark, rows):
    return spark.createDataFrame(
        [("Q2", *r) for r in rows], "season string, stableEdgeId string, geometry string"
    )


SEGMENTS = [("1", "LINESTRING(1 1, 2 2)"), ("2", "LINESTRING(2 2, 3 3)"), ("3", None)]


def test_trajectories_follow_link_order_and_count_known_links(spark):
    rows = [
        trip(person_id=1, network_link_ids=[2, 1]),
        trip(person_id=2, network_link_ids=[1, 9]),
        trip(person_id=3, network_link_ids=[1, 8, 9]),
        trip(person_id=4, network_link_ids=[3]),
        trip(person_id=5, network_link_ids=[]),
        trip(person_id=6, network_link_ids=None),
        trip(person_id=7, network_link_ids=[1, None]),
        trip(person_id=8, network_link_ids=[None]),
    ]
    found = routes.trajectories(frame(spark, rows), segments(spark, SEGMENTS)).collect()
    by_person = {r.person_id: r for r in found}
    assert set(by_person) == {1, 2, 7}
    assert by_person[1].trajectory_segments == "LINESTRING(2 2, 3 3)|LINESTRING(1 1, 2 2)"
    assert (by_person[2].matched_segments, by_person[2].total_links) == (1, 2)
    assert by_person[7].total_links == 1


def test_duplicate_segments_add_no_links(spark):
    twice = SEGMENTS + [("1", "LINESTRING(1 1, 2 2)"), ("1", None)]
    (row,) = routes.trajectories(frame(spark, [trip()]), segments(spark, twice)).collect()
    assert (row.matched_segments, row.total_links) == (2, 2)


def test_segments_of_another_season_do_not_match(spark):
    rows = [trip(dataset="Q4 Thursday")]
    assert routes.trajectories(frame(spark, rows), segments(spark, SEGMENTS)).count() == 0


def test_patterns_merge_lists_with_the_same_trajectory(spark):
    rows = [
        trip(network_link_ids=[1, 2], distance_miles=1.0),
        trip(network_link_ids=[1, 2], distance_miles=2.0),
        trip(network_link_ids=[1, 2, 9], distance_miles=6.0),
        trip(network_link_ids=[1, 2], mode="BIKING"),
    ]
    found = {r.mode: r for r in
             routes.route_patterns(frame(spark, rows), segments(spark, SEGMENTS)).collect()}
    assert found["WALKING"].trip_count == 3
    assert found["WALKING"].avg_distance_miles == 3.0
    assert found["BIKING"].trip_count == 1


def test_missing_trajectories_are_counted(spark):
    rows = [trip(network_link_ids=[9]), trip(network_link_ids=[9]), trip(network_link_ids=[3]), trip()]
    (row,) = routes.missing_trajectory(frame(spark, rows), segments(spark, SEGMENTS)).collect()
    assert (row.route_patterns, row.trip_count) == (2, 3)


def points(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    line = df.select(stitch(trajectory_lines(F.col("t"))).alias("p")).first().p
    return [(p.lat, p.lng) for p in line]


def test_stitching_drops_only_close_joints(spark):
    assert points(spark, "LINESTRING(1 1, 2 2)|LINESTRING(2.0004 2, 3 3)") == [(1, 1), (2, 2), (3, 3)]
    assert points(spark, "LINESTRING(1 1, 2 2)|LINESTRING(2.0006 2, 3 3)") == [
        (1, 1), (2, 2), (2, 2.0006), (3, 3)]
    # One close difference is not enough.
    assert len(points(spark, "LINESTRING(1 1, 2 2)|LINESTRING(2 9, 3 3)")) == 4


def test_stitching_accepts_both_spellings_and_skips_what_is_no_line(spark):
    text = "LINESTRING (1 1, 2 2)|POINT(7 7)|LINESTRING(2 2, x y, 3 3, 4)"
    assert points(spark, text) == [(1, 1), (2, 2), (3, 3)]
    assert points(spark, "") == []
    assert points(spark, None) == []


def test_a_single_point_line_keeps_the_point_before_it(spark):
    # The one vertex is dropped, so the next line is compared with (2, 2) again.
    text = "LINESTRING(1 1, 2 2)|LINESTRING(2.0004 2)|LINESTRING(2.0008 2, 5 5)"
    assert points(spark, text) == [(1, 1), (2, 2), (2, 2.0008), (5, 5)]


def test_stitching_equals_walking_through_random_lines(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(400):
        at, lines = 0.0, []
        for _ in range(rng.randrange(7)):
            size, at = rng.choice([0, 1, 1, 2, 3]), at + rng.choice([0, 0, 0.0004, -0.0003, 1])
            inner = []
            for _ in range(size):
                inner.append(f"{at:.4f} 5")
                at += rng.choice([0.0001, 1])
            at -= 1
            lines.append(f"LINESTRING({', '.join(inner)})")
        texts.append("|".join(lines))

    def plain(text):
        done = []
        for line in text.split("|"):
            line = [(5.0, float(p.split()[0])) for p in line[11:-1].split(", ") if p]
            if done and line and abs(done[-1][1] - line[0][1]) < 0.0005:
                line = line[1:]
            done += line
        return done

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stitch(trajectory_lines(F.col("t"))).alias("p"))
    for row in df.collect():
        assert [(p.lat, p.lng) for p in row.p] == plain(row.t), row.t


def test_a_line_of_many_segments_is_stitched_in_linear_time(spark):
    def seconds(n):
        text = "|".join(f"LINESTRING({i} 0, {i + 0.5} 0, {i + 1} 0)" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(F.size(stitch(trajectory_lines(F.col("t")))))
        start = time.perf_counter()
        assert df.first()[0] == 2 * n + 1
        return time.perf_counter() - start

    seconds(100)
    small, large = seconds(5_000), seconds(50_000)
    assert large < 30 * small + 1


def test_texts_travel_once_per_trajectory(spark):
    patterns = routes.route_patterns(frame(spark, [trip()]), segments(spark, SEGMENTS))
    plan = patterns._jdf.queryExecution().executedPlan().toString().splitlines()
    groups = [line for line in plan if "HashAggregate(keys=[dataset" in line and "drawn" in line]
    assert groups and not any("trajectory_segments" in line for line in groups)


def test_point_text(spark):
    df = spark.createDataFrame([("POINT(-121.7 38)",), ("POINT (1 2)",), ("LINE",), (None,)], "w string")
    got = [tuple(r) for r in df.select(*point_xy(F.col("w"))).collect()]
    assert got == [(-121.7, 38.0), (1.0, 2.0), (None, None), (None, None)]


def test_network_features_draw_dashes_where_no_line_results(spark):
    odd = [("1", "POINT(1 1)"), ("2", "LINESTRING(2 2, 3 3)")]
    rows = [trip(network_link_ids=[1]), trip(network_link_ids=[2], mode=None)]
    patterns = routes.route_patterns(frame(spark, rows), segments(spark, odd))
    drawn = {(r.kind, r.mode): r for r in layers.network_features(patterns, "A to B").collect()}
    assert drawn[("network_route", "WALKING")].dash == "5, 10"
    assert len(drawn[("network_route", "WALKING")].coords) == 2
    assert drawn[("network_route", "UNKNOWN")].dash is None
    assert drawn[("network_origin", "UNKNOWN")].popup == "Origin: UNKNOWN trips"


def test_links_of_a_trip(spark):
    rows = [trip(person_id=1, network_link_ids=[5, None]), trip(person_id=2, network_link_ids=None)]
    got = routes.trip_links(frame(spark, rows)).select("link_position", "link_id").collect()
    assert [tuple(r) for r in got] == [(0, 5), (1, None)]
