"""Readers, writers and the table catalogue on files made for the test."""

import json
import zipfile

from pyspark.sql import functions as F

from tests.test_trips import frame, trip
from tripflow.functions.geo import OD_COLUMNS
from tripflow.operators import flows, regions
from tripflow.sources import catalog, gtfs, sinks
from tripflow.sources.trips import read_population, read_segments, read_trips, stack_datasets, write_trips

FEED = "﻿trip_id,stop_id,arrival_time,departure_time,stop_sequence,extra\na,A,08:00:00,08:00:10,1,x\na,B,25:10:00,,two,\n"
OTHER_ORDER = "stop_sequence,departure_time,trip_id,stop_id,arrival_time\n3,09:00:00,b,C,09:00:00\n"


def test_trips_are_read_by_partition_with_filters_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "trips")
    rows = [trip(), trip(dataset="Q4 Saturday", start_lat=999.0), trip(dataset="Q4 Saturday")]
    frame(spark, rows).write.partitionBy("dataset").parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    trips = read_trips(spark, path)
    query = flows.od_flows(flows.valid_coords(trips.filter(F.col("dataset") == "Q4 Saturday")))
    assert [r.trip_count for r in query.collect()] == [1]
    plan = query._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(start_lat,-90.0)" in plan
    assert "PartitionFilters: [isnotnull(dataset" in plan
    scanned = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "mode" in scanned and "distance_miles" not in scanned and "network" not in scanned


def scanned_rows(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_box_reads_few_rows_of_trips_clustered_by_both_ends(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    ids = spark.range(200_000)
    spread = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(10_000)) / 10_000
    wide = ids.select(
        F.lit("Q2 Thursday").alias("dataset"), F.col("id").alias("person_id"), F.lit("WALKING").alias("mode"),
        (36.8 + 1.8 * spread(1)).alias("start_lat"), (-122.8 + 1.8 * spread(2)).alias("start_lng"),
        (36.8 + 1.8 * spread(3)).alias("end_lat"), (-122.8 + 1.8 * spread(4)).alias("end_lng"),
    )
    odd = spark.createDataFrame([("Q2 Thursday", -1, None, None, float("nan"), 999.0, 38.0)],
                                "dataset string, person_id long, mode string, start_lat double, start_lng double, end_lat double, end_lng double")
    trips = wide.unionByName(odd)
    write_trips(trips, str(tmp_path / "near"), rows_per_page=1000)
    trips.write.partitionBy("dataset").option("parquet.page.row.count.limit", 1000).parquet(str(tmp_path / "far"))
    near, far = (regions.od_bbox(read_trips(spark, str(tmp_path / x)).select("dataset", "person_id", "mode", *OD_COLUMNS)) for x in ("near", "far"))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))
    assert read_trips(spark, str(tmp_path / "near")).count() == 200_001
    assert scanned_rows(far) > 150_000 and scanned_rows(near) < 0.15 * scanned_rows(far)
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_population_and_segments_by_season(spark, tmp_path):
    spark.createDataFrame([("Q2", 1)], "season string, person_id long").write.partitionBy(
        "season").parquet(str(tmp_path / "p"))
    spark.createDataFrame(
        [("Q4", "7", "LINESTRING(1 1, 2 2)")], "season string, stableEdgeId string, geometry string"
    ).write.partitionBy("season").parquet(str(tmp_path / "s"))
    assert read_population(spark, str(tmp_path / "p")).first().asDict() == {"person_id": 1, "season": "Q2"}
    assert read_segments(spark, str(tmp_path / "s")).first().season == "Q4"


def test_stacking_labels_tables_and_fills_absent_columns(spark):
    a = spark.createDataFrame([(1,)], "person_id long")
    b = spark.createDataFrame([(2, "WALKING")], "person_id long, mode string")
    got = {tuple(r) for r in stack_datasets({"A": a, "B": b}).select("dataset", "person_id", "mode").collect()}
    assert got == {("A", 1, None), ("B", 2, "WALKING")}


def test_companion_tables_fall_back_to_the_fourth_quarter(spark):
    df = spark.createDataFrame(
        [("bay_2024_Q2_thursday_trip",), ("bay_2024_Q1_thursday_trip",)], "table_name string"
    )
    got = {r.table_name: (r.population_table, r.segments_table) for r in catalog.companion_tables(df).collect()}
    assert got == {
        "bay_2024_Q2_thursday_trip": ("bay_2024_Q2_population", "bay_2024_Q2_network_segments"),
        "bay_2024_Q1_thursday_trip": ("bay_2024_Q1_population", "bay_2024_Q4_network_segments"),
    }


def test_table_columns(spark):
    df = spark.createDataFrame([], "stableEdgeId string, geometry string, ids array<bigint>")
    assert [tuple(r) for r in catalog.table_columns(df).collect()] == [
        ("geometry", "string"), ("ids", "array<bigint>"), ("stableEdgeId", "string")]


def test_feed_folders_with_different_column_orders(spark, tmp_path):
    for name, text in (("rail", FEED), ("bus", OTHER_ORDER)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "stop_times.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty").mkdir()
    folders = {n: str(tmp_path / n) for n in ("rail", "bus", "empty")}
    got = {tuple(r) for r in gtfs.read_feed_folders(spark, folders).collect()}
    assert got == {
        ("rail", "a", "08:00:00", "08:00:10", "A", 1),
        ("rail", "a", "25:10:00", None, "B", None),
        ("bus", "b", "09:00:00", "09:00:00", "C", 3),
    }


def test_feed_zips(spark, tmp_path):
    for name, text in (("rail", FEED), ("bus", OTHER_ORDER), ("empty", None)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as feed:
            feed.writestr("agency.txt", "agency_id\n1\n")
            if text:
                feed.writestr("stop_times.txt", text)
    got = {tuple(r) for r in gtfs.read_feed_zips(spark, str(tmp_path)).collect()}
    assert got == {
        ("rail", "a", "08:00:00", "08:00:10", "A", 1),
        ("rail", "a", "25:10:00", None, "B", None),
        ("bus", "b", "09:00:00", "09:00:00", "C", 3),
    }


def test_feeds_with_the_same_columns_are_one_scan_and_need_no_job(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"a b{k}").mkdir()
        (tmp_path / f"a b{k}" / "stop_times.txt").write_text(FEED if k % 2 else OTHER_ORDER, encoding="utf-8")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    feeds = gtfs.read_feed_folders(spark, {f"agency {k}": str(tmp_path / f"a b{k}") for k in range(12)})
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert feeds._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 2
    got = {r.agency: r["count"] for r in feeds.groupBy("agency").count().collect()}
    assert got == {f"agency {k}": 2 if k % 2 else 1 for k in range(12)}


def test_a_zip_is_one_partition_and_leaves_in_batches(spark, tmp_path, monkeypatch):
    text = "stop_id,trip_id\n" + "".join(f'"S, {i}",t{i}\n' for i in range(50_000)) + "\nshort\n"
    for name in ("x", "y"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as feed:
            feed.writestr("stop_times.txt", text)
    reader = gtfs.FeedZipReader(str(tmp_path), "stop_times")
    parts = reader.partitions()
    assert len(parts) == 2
    assert [b.num_rows for b in reader.read(parts[0])] == [20_000, 20_000, 10_001]
    rows = gtfs.read_feed_zips(spark, f"file:{tmp_path}")
    assert rows.rdd.getNumPartitions() == 2 and rows.count() == 100_002
    assert rows.filter("trip_id IS NULL").count() == 2 and rows.filter("stop_id = 'S, 7'").count() == 2


def test_rows_are_dealt_over_zips_without_a_shuffle_by_agency(spark, tmp_path):
    feed = spark.range(1000).selectExpr(
        "'rail' AS agency", "CAST(id AS string) AS trip_id", "'08:00:00' AS arrival_time",
        "'08:00:00' AS departure_time", "'S' AS stop_id", "CAST(id AS int) AS stop_sequence")
    packed = gtfs.write_feed_zips(feed, str(tmp_path / "zips"), rows_per_zip=100)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert packed.count() == 10


def test_zips_written_and_read_are_the_same_rows(spark, tmp_path):
    rows = [("rail", f"t{i}", "08:00:00", None if i % 7 else "09:0", f'stop "{i}", x', i) for i in range(300)]
    rows += [("bus", "t", None, None, "é", None)]
    feed = spark.createDataFrame(rows, f"agency string, {gtfs.FEED_SCHEMAS['stop_times']}").repartition(4)
    written = gtfs.write_feed_zips(feed, str(tmp_path / "zips"), rows_per_zip=100).collect()
    assert sum(r.n_rows for r in written) == 301 and len([r for r in written if r.agency == "rail"]) > 1
    back = gtfs.read_feed_zips(spark, str(tmp_path / "zips")).withColumn("agency", F.substring_index("agency", ".", 1))
    assert sorted(map(str, back.collect())) == sorted(map(str, feed.collect()))
    (tmp_path / "none").mkdir()
    assert gtfs.read_feed_zips(spark, str(tmp_path / "none")).count() == 0


FEATURES = (
    "dataset string, mode string, rank long, kind string, coords array<struct<lat:double,lng:double>>, "
    "colour string, size double, opacity double, dash string, tooltip string, popup string"
)


def features(spark):
    return spark.createDataFrame(
        [
            ("Q2", "WALKING", 1, "flow", [(1.0, 2.0), (3.0, 4.0)], "red", 2.0, 0.5, None, "t", None),
            ("Q2", "UNKNOWN", 1, "origin", [(1.0, 2.0)], "red", 2.0, 0.5, None, None, None),
        ],
        FEATURES,
    )


def test_layers_are_written_by_dataset_and_mode(spark, tmp_path):
    path = str(tmp_path / "layers")
    sinks.write_layers(features(spark), path)
    assert spark.read.json(path).filter("dataset = 'Q2' AND mode = 'UNKNOWN'").first().kind == "origin"
    assert (tmp_path / "layers" / "dataset=Q2" / "mode=WALKING").is_dir()


def test_a_rerun_replaces_only_the_datasets_it_computed(spark, tmp_path):
    path = str(tmp_path / "layers")
    both = features(spark).unionByName(features(spark).withColumn("dataset", F.lit("Q4")))
    sinks.write_layers(both, path)
    sinks.write_layers(features(spark).withColumn("colour", F.lit("blue")), path)
    got = {(r.dataset, r.colour) for r in sinks.read_layers(spark, path, both).collect()}
    assert got == {("Q2", "blue"), ("Q4", "red")}


def test_geojson_text(spark):
    got = {r.mode: json.loads(r.feature) for r in sinks.to_geojson(features(spark)).collect()}
    assert got["WALKING"]["geometry"] == {"type": "LineString", "coordinates": [[2.0, 1.0], [4.0, 3.0]]}
    assert got["UNKNOWN"]["geometry"] == {"type": "Point", "coordinates": [2.0, 1.0]}
    assert got["WALKING"]["properties"]["tooltip"] == "t"
