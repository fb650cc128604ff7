"""Flows, modes, regions: hand-made edge rows and properties."""

import random
from collections import Counter
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from tripflow.functions import style
from tripflow.functions.numbers import round_places
from tripflow.operators import flows, layers, modes, prefilter, regions
from tripflow.operators.topn import in_order, top_per_group
from tripflow.plans.registry import QUERIES
from tripflow.sources.trips import TRIPS

SCHEMA = "dataset string, " + TRIPS
NAN = float("nan")


def trip(**changes):
    row = {
        "dataset": "Q2 Thursday", "person_id": 1, "mode": "WALKING",
        "start_lat": 38.0, "start_lng": -121.7, "end_lat": 37.4, "end_lng": -122.15,
        "distance_miles": 1.0, "duration_minutes": 10.0, "network_link_ids": [1, 2],
        "origin_census_tract": "a", "destination_census_tract": "b",
        "passengers": 1, "day_type": "weekday", "quarter": "Q2",
    }
    row.update(changes)
    return row


def frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def test_valid_coords_is_inclusive_and_drops_null_and_nan(spark):
    rows = [
        trip(start_lat=90.0), trip(start_lat=-90.0), trip(end_lng=180.0),
        trip(start_lat=90.0001), trip(end_lng=-180.5), trip(start_lng=None), trip(end_lat=NAN),
    ]
    assert flows.valid_coords(frame(spark, rows)).count() == 3


def test_usable_drops_nan_zero_and_null(spark):
    rows = [
        trip(), trip(distance_miles=NAN), trip(duration_minutes=NAN),
        trip(distance_miles=0.0), trip(duration_minutes=None),
    ]
    (row,) = modes.mode_summary(frame(spark, rows)).collect()
    assert (row.total_trips, row.avg_distance_miles, row.percentage) == (1, 1.0, 100.0)


def test_null_mode_is_a_group_of_its_own(spark):
    rows = [trip(mode=None), trip(mode=None), trip()]
    found = {r.mode: r.trip_count for r in flows.od_flows(frame(spark, rows)).collect()}
    assert found == {None: 2, "WALKING": 1}
    stats = {r.mode: r.unique_routes for r in modes.mode_statistics(frame(spark, rows)).collect()}
    assert stats == {None: 1, "WALKING": 1}


def test_mode_statistics_leaves_incomplete_routes_out_of_the_distinct_count(spark):
    rows = [trip(duration_minutes=float(d), start_lat=lat) for d, lat in
            [(1, 38.0), (2, 38.0), (3, 38.5), (10, None)]]
    (row,) = modes.mode_statistics(frame(spark, rows)).collect()
    assert row.unique_routes == 2
    assert row.median_duration_min == 2.0
    assert row.std_duration_min == round(stdev([1, 2, 3, 10]), 2)


def test_population_join_repeats_and_filters_like_an_inner_join(spark):
    trips = frame(spark, [trip(person_id=p) for p in (1, 1, 2, 3)])
    people = spark.createDataFrame(
        [("Q2", 1), ("Q2", 1), ("Q2", 2), ("Q4", 3)], "season string, person_id long"
    )
    joined = flows.trips_with_population(trips, people)
    assert Counter(r.person_id for r in joined.collect()) == {1: 4, 2: 1}
    (flow,) = flows.od_flows(trips, population=people).collect()
    assert flow.trip_count == 5
    (point,) = regions.origin_counts(trips, population=people).collect()
    assert (point.trip_count, point.x, point.y) == (5, -121.7, 38.0)


def test_shares_sum_to_a_hundred_and_flows_to_valid_rows(spark):
    rng = random.Random(1)
    rows = [
        trip(
            dataset=rng.choice(["Q2 Thursday", "Q4 Saturday"]),
            mode=rng.choice(["WALKING", "BIKING", None]),
            start_lat=rng.choice([38.0, 38.1, 999.0]),
        )
        for _ in range(500)
    ]
    trips = frame(spark, rows)
    shares = modes.mode_popularity(trips).groupBy("dataset").agg(F.sum("percentage")).collect()
    assert all(abs(s[1] - 100) <= 0.2 for s in shares)
    total = flows.od_flows(flows.valid_coords(trips)).agg(F.sum("trip_count")).first()[0]
    assert total == sum(r["start_lat"] < 90 for r in rows)


def test_flow_stats_names_the_unknown_mode_among_leaders(spark):
    rows = [("d", None, 9), ("d", "b", 2), ("d", "a", 2), ("d", "c", 1), ("d", "e", 5)]
    df = spark.createDataFrame(rows, "dataset string, mode string, trip_count long")
    (row,) = flows.flow_stats(df).collect()
    assert row.top_route_modes == "UNKNOWN, e, a"
    assert (row.total_route_instances, row.max_route_frequency, row.avg_route_frequency) == (19, 9, 3.8)


@pytest.mark.parametrize("n", [1, 7, 1500])
def test_top_per_group_is_exact_with_one_hot_group(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(20)}", rng.randrange(50), i)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(13)
    got = {(r.g, r.id): r.rank for r in
           top_per_group(df, ["g"], [F.desc("v"), *in_order(["id"])], n, fan_in=4).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:n]
        want.update({(g, r[2]): i + 1 for i, r in enumerate(ordered)})
    assert got == want


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    rows = [trip(mode=rng.choice("abc"), start_lat=float(rng.randrange(40, 50))) for _ in range(400)]
    once, again = frame(spark, rows).repartition(1), frame(spark, rows).repartition(11)

    def keys(trips):
        top = flows.top_flows(trips, 3)
        sample = layers.origin_sample(flows.top_flows(trips), 4, seed=5)
        return (
            sorted(map(tuple, top.collect())),
            sorted((r.mode, r.start_lat, r.pick) for r in sample.collect()),
        )

    assert keys(once) == keys(again)


def test_sample_keeps_everything_when_small_and_changes_with_the_seed(spark):
    rows = [trip(start_lat=float(i)) for i in range(30)]
    top = flows.top_flows(frame(spark, rows))
    assert layers.origin_sample(top, 2000).count() == 30
    picks = [
        {r.start_lat for r in layers.origin_sample(top, 5, seed=s).collect()} for s in (0, 1)
    ]
    assert len(picks[0]) == len(picks[1]) == 5 and picks[0] != picks[1]


def test_boxes_quarters_and_tracts(spark):
    rows = [trip(), trip(start_lat=38.03), trip(day_type="weekend"), trip(quarter="Q1")]
    trips = frame(spark, rows)
    assert regions.od_bbox(trips).count() == 3
    assert regions.quarter_daytype(trips).count() == 2
    (share,) = regions.bbox_mode_share(trips).collect()
    assert (share.total_trips, share.percentage) == (3, 100.0)
    (pair,) = regions.tract_flows(trips).collect()
    assert (pair.origin_census_tract, pair.trip_count) == ("a", 4)


@pytest.mark.parametrize("value", [2.25, 1.15, 0.05, 12.5, 1234567.8])
def test_decimals_match_exact_binary_rounding(spark, value):
    got = spark.range(1).select(style.decimals(F.lit(value), 1), style.decimals(F.lit(value), 0)).first()
    assert tuple(got) == (f"{value:.1f}", f"{value:.0f}")


def test_round_places_scales_first(spark):
    values = [32.175, 2.675, -2.5, 1.005, NAN]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double")
           .select(round_places(F.col("v"), 2)).collect()]
    assert got[:4] == [32.17, 2.68, -2.5, 1.0] and got[4] != got[4]


def test_unknown_modes_are_drawn_in_the_default_colours(spark):
    rows = [trip(mode=None), trip(mode="ROCKET")]
    top = flows.top_od(frame(spark, rows))
    drawn = {r.mode: r.colour for r in layers.fixed_colour_features(top).collect()}
    assert drawn == {"UNKNOWN": "gray", "ROCKET": "gray"}


def test_palette_starts_over(spark):
    rows = [trip(mode=f"m{i:02d}") for i in range(12)]
    colours = {r.mode: r.colour for r in
               layers.colours_by_name(flows.top_flows(frame(spark, rows))).collect()}
    assert colours["m10"] == colours["m00"] == style.PALETTE[0]
    assert colours["m11"] == style.PALETTE[1]


def test_statistics_count_more_flows_than_are_drawn(spark):
    from tripflow.operators import reports

    rows = [trip(start_lat=30 + i / 1000, dataset="d") for i in range(3000)]
    trips = frame(spark, rows)
    (stats,) = flows.flow_stats(flows.od_flows(flows.valid_coords(trips))).collect()
    (report,) = reports.dataset_report(trips).collect()
    for row in (stats, report):
        assert (row.total_route_instances, row.max_route_frequency, row.avg_route_frequency) == (3000, 1, 1.0)


def test_people_are_filtered_at_the_scan_and_the_rows_stay_the_same(spark):
    rng = random.Random(4)
    rows = [trip(person_id=rng.randrange(20_000), dataset=rng.choice(["Q2 Thursday", "Q4 Saturday"])) for _ in range(4000)]
    trips = frame(spark, rows)
    people = spark.createDataFrame([(s, p) for s in ("Q2", "Q4") for p in range(0, 20_000, 40)] + [(None, 1), ("Q2", None)],
                                   "season string, person_id long")
    want = sum(1 for r in rows if r["person_id"] % 40 == 0)
    found = flows.with_population(trips, people)
    assert found.count() == want == flows.trips_with_population(trips, people).count()
    cells = prefilter.key_filter(people, ["season", "person_id"])
    passed = trips.filter(prefilter.may_have_key(cells, [flows.season_of(), F.col("person_id")])).count()
    assert want <= passed < want + 0.12 * len(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "substring(0x" in plan[plan.index("Filter"):].split("Exchange")[0] or "substring(" in plan


def test_plans_do_not_grow_with_the_filter_of_people(spark):
    trips = frame(spark, [trip(person_id=i, dataset="Q2 Thursday") for i in range(50)])
    for n in (10, 60_000):
        people = spark.range(0, 2 * n, 2).selectExpr("'Q2' AS season", "id AS person_id")
        found = flows.with_population(trips, people)
        assert found.count() == min(n, 25)
        assert len(found._jdf.queryExecution().toString()) < 100_000


def test_cells_of_a_filter_are_those_of_its_keys(spark):
    for n in (0, 1, 20_000):  # below and beyond one bitmap
        people = spark.range(n).selectExpr("'Q2' AS season", "id AS person_id")
        found = prefilter.key_filter(people, ["season", "person_id"])
        (cells,) = found.cells.first()
        used = people.select(F.explode(F.array(*prefilter._cells(["season", "person_id"], found.n_cells)))).distinct()
        assert len(cells) == found.n_cells
        assert {i for i, byte in enumerate(cells) if byte} == {c for (c,) in used.collect()}


def test_a_population_beyond_the_filter_is_joined_without_one(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "MAX_CELLS", 1024)
    people = spark.range(3000).selectExpr("'Q2' AS season", "id AS person_id")
    assert prefilter.key_filter(people, ["season", "person_id"]) is None
    assert flows.with_population(frame(spark, [trip(person_id=5), trip(person_id=5000)]), people).count() == 1


def test_what_the_driver_holds_of_a_filter_does_not_grow_with_the_people(spark):
    trips = frame(spark, [trip(person_id=i) for i in range(50)])
    for n in (1000, 100_000, 400_000):
        people = spark.range(0, 2 * n, 2).selectExpr("'Q2' AS season", "id AS person_id")
        found = prefilter.key_filter(people, ["season", "person_id"])
        assert (found.n_cells if found else 0) <= 2**20
        assert flows.with_population(trips, people).count() == 25


@pytest.mark.parametrize("name", ["origin_counts", "origin_features", "top_flows_with_population", "top_od_500",
                                  "trips_with_population", "od_line_features"])
def test_queries_with_a_population_make_no_filter_beyond_a_megabyte(spark, monkeypatch, name):
    made = []

    def seen(*args):
        made.append(prefilter.key_filter(*args))
        return made[-1]

    monkeypatch.setattr(flows, "key_filter", seen)
    QUERIES[name](spark, "/root/testdata/sf0.1")
    assert made and all(found is None or found.n_cells <= 2**20 for found in made)


def test_a_population_beyond_the_filter_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "MAX_CELLS", 1024)
    people = spark.range(3000).selectExpr("'Q2' AS season", "id AS person_id")
    found = flows.with_population(frame(spark, [trip(person_id=5), trip(person_id=5000)]), people)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["origin_counts", "origin_features", "top_flows_with_population", "top_od_500",
                                  "trips_with_population", "od_line_features"])
def test_queries_send_no_large_population_through_the_driver(spark, name):
    # 277,000 people, which Spark takes for less than its limit of 10 MB.
    plan = QUERIES[name](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def hot_table(spark, folder):
    """65 orders and two line items each, the last with 100,000 more: a file of a few kB."""
    spark.range(65).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.range(100_130).selectExpr(
        "least(id div 2, 64) AS l_orderkey", "7L AS l_partkey", "5L AS l_suppkey", "1 AS l_linenumber", "3.0D AS l_quantity",
        "0.01D AS l_tax", "timestamp '1996-05-02' AS l_shipdate",
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_trips_with_population_sends_no_small_file_of_many_trips_through_the_driver(spark, tmp_path):
    found = QUERIES["trips_with_population"](spark, hot_table(spark, tmp_path))
    plan = final_plan(found)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # No one of the keys of 13; twice the keys of 17.
    copies = {k: 1 + (k % 17 == 0) for k in range(65) if k % 13}
    assert found.count() == sum(2 * n for n in copies.values()) + 100_000


def test_top_od_500_sends_no_small_file_of_many_trips_through_the_driver(spark, tmp_path):
    found = QUERIES["top_od_500"](spark, hot_table(spark, tmp_path))
    plan = final_plan(found)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    copies = {k: 1 + (k % 17 == 0) for k in range(65) if k % 13}
    assert [(r.dataset, r.trip_count, r["rank"]) for r in found.collect()] == [
        ("Q2 Thursday", sum(2 * n for n in copies.values()) + 100_000, 1)
    ]


def test_merged_sketches_equal_one_pass_within_the_stated_error(spark):
    rng = random.Random(5)
    rows = [trip(duration_minutes=rng.lognormvariate(2, 1), day_type=str(rng.randrange(30)), mode=rng.choice(["A", None]))
            for _ in range(20_000)]
    trips = frame(spark, rows).repartition(6)
    sketches = modes.duration_sketches(trips)
    assert sketches.count() == 60
    merged = modes.merged_quantiles(sketches)
    assert {r.mode: r.trips for r in merged.collect()} == Counter(r["mode"] for r in rows)
    assert all(r.rank_error <= 0.01 for r in modes.rank_errors(trips, merged).collect())
    tail = modes.merged_quantiles(sketches, share=0.9, name="p90")
    assert all(r.rank_error <= 0.01 for r in modes.rank_errors(trips, tail, share=0.9, name="p90").collect())
