"""Named queries: each runs an operator over whole tables and returns flat columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripflow.functions.geo import OD_COLUMNS, points_text
from tripflow.operators import context, flows, layers, modes, regions, reports, routes, schedule
from tripflow.plans import inputs
from tripflow.sources import catalog, gtfs, sinks
from tripflow.sources.shared import partition_folders, shared_folder, written
from tripflow.sources.trips import TRIPS, read_parquet, read_trips, stack_datasets, write_trips

Query = Callable[[SparkSession, str], DataFrame]

AGENCIES = (inputs.RAIL, inputs.BUS)
REGION_LABEL = "East to Bay"
# Ranks of merged medians may be off by so much.
MEDIAN_RANK_ERROR = 0.01


def _trip_query(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(inputs.trips(spark, sf_dir))


def _log_query(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(inputs.memory_log(spark, sf_dir))


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("coords", points_text(F.col("coords")))


def trips_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.col("network_link_ids")
    return inputs.trips(spark, sf_dir).select(
        "dataset",
        "person_id",
        "mode",
        *OD_COLUMNS,
        "distance_miles",
        "duration_minutes",
        F.size(links).cast("long").alias("link_count"),
        F.array_join(links.cast("array<string>"), ",").alias("links"),
    )


def companion_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.companion_tables(inputs.trip_table_names(spark, sf_dir))


def datasets_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables stored apart, one per dataset, stacked under their labels."""
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    inputs.trips(spark, sf_dir).write.partitionBy("dataset").parquet(folder)
    apart = {label: read_parquet(spark, path, TRIPS) for label, path in partition_folders(spark, folder, "dataset").items()}
    return stack_datasets(apart).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("trip_count"), F.sum("distance_miles").alias("distance_miles")
    )


def _box_trips(trips: DataFrame) -> DataFrame:
    return regions.od_bbox(trips).select("dataset", "person_id", "mode", *OD_COLUMNS)


def stored_od_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips between two boxes, out of a table clustered by both ends."""
    folder = f"{shared_folder(spark)}/trips-{uuid.uuid4().hex}"
    write_trips(inputs.trips(spark, sf_dir), folder)
    return _box_trips(read_trips(spark, folder))


def mode_medians_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians from stored sketches of each day type, held against the trips."""
    trips = inputs.trips(spark, sf_dir)
    folder = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    sketches = written(modes.duration_sketches(trips), folder)
    merged = modes.merged_quantiles(sketches)
    errors = modes.rank_errors(trips, merged).withColumn("within", F.col("rank_error") <= MEDIAN_RANK_ERROR)
    named = errors.select(F.col("dataset").alias("d"), F.col("mode").alias("m"), "within")
    same = F.col("dataset").eqNullSafe(F.col("d")) & F.col("mode").eqNullSafe(F.col("m"))
    return merged.join(named, same).select("dataset", "mode", "trips", "shortest", "longest", "within")


def gtfs_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scheduled(inputs.stop_times(spark, sf_dir))


def _scheduled(stop_times: DataFrame) -> DataFrame:
    return schedule.schedule_seconds(stop_times).select(
        "agency", "trip_id", "stop_id", "stop_sequence", F.col("dep_secs").cast("long").alias("dep_secs"),
        F.col("arr_secs").cast("long").alias("arr_secs"),
    )


def gtfs_feed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times written as feeds whose columns differ in order, and read back."""
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    given = inputs.stop_times(spark, sf_dir)
    columns = list(gtfs.feed_columns("stop_times"))
    for agency, order in (("rail", columns), ("bus", columns[::-1])):
        gtfs.write_feed_folders(given.filter(F.col("agency") == agency), f"{folder}/{agency}", order)
    feeds = {agency: f"{folder}/{agency}/agency={agency}" for agency in ("rail", "bus")}
    return _scheduled(gtfs.read_feed_folders(spark, feeds, pattern="*.csv"))


def gtfs_feed_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times packed into feed zips, several per agency, and read back."""
    folder = f"{shared_folder(spark)}/feeds-{uuid.uuid4().hex}"
    gtfs.write_feed_zips(inputs.stop_times(spark, sf_dir), folder, rows_per_zip=20_000).count()
    read = gtfs.read_feed_zips(spark, folder)
    return _scheduled(read.withColumn("agency", F.substring_index("agency", ".", 1)))


def trips_with_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = inputs.trips(spark, sf_dir).select("dataset", "person_id", "mode", *OD_COLUMNS)
    return flows.trips_with_population(trips, inputs.population(spark, sf_dir))


def top_od_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.top_od(
        inputs.trips(spark, sf_dir), 500, inputs.population(spark, sf_dir)
    )


def top_flows_with_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.top_flows(
        inputs.trips(spark, sf_dir), 20, population=inputs.population(spark, sf_dir)
    )


def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.origin_counts(
        inputs.trips(spark, sf_dir), 500, inputs.population(spark, sf_dir)
    )


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = regions.od_bbox(inputs.trips(spark, sf_dir))
    return routes.route_patterns(boxed, inputs.segments(spark, sf_dir))


def trip_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = regions.od_bbox(inputs.trips(spark, sf_dir))
    return routes.trajectories(boxed, inputs.segments(spark, sf_dir)).select(
        "dataset",
        "person_id",
        "mode",
        *OD_COLUMNS,
        "distance_miles",
        "duration_minutes",
        "trajectory_segments",
        "matched_segments",
        "total_links",
    )


def stitched_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.stitched(_patterns(spark, sf_dir)).select(
        "dataset",
        "mode",
        *OD_COLUMNS,
        "trajectory_segments",
        F.size("points").cast("long").alias("n_points"),
        points_text(F.col("points")).alias("points"),
    )


def missing_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.missing_trajectory(
        inputs.trips(spark, sf_dir), inputs.segments(spark, sf_dir)
    )


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.asks_of(
        inputs.requests(spark, sf_dir), schedule.stop_map(spark, AGENCIES)
    )


def place_to_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asks(spark, sf_dir).select(
        "request_id", "agency", "origin", "destination", "origin_stop", "dest_stop"
    )


def fare_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = schedule.with_fares(
        _asks(spark, sf_dir),
        schedule.fare_table(spark, AGENCIES),
        schedule.per_agency(AGENCIES, "default_fare"),
    )
    return priced.select("request_id", "agency", "origin_stop", "dest_stop", "cost")


def next_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = schedule.next_departure(
        _asks(spark, sf_dir),
        inputs.stop_times(spark, sf_dir),
        schedule.per_agency(AGENCIES, "missing_dest"),
    )
    return answered.select(
        "request_id",
        "agency",
        "trip_id",
        *[F.col(c).cast("long").alias(c) for c in ("now_secs", "dep_secs", "arr_secs")],
        "eta_min",
    )


def offers_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = inputs.requests(spark, sf_dir)
    return schedule.stack_offers(
        schedule.schedule_offers(requests, inputs.stop_times(spark, sf_dir), AGENCIES),
        schedule.fixed_offers(requests, inputs.FIXED_OFFERS),
    )


def best_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.best_offer(offers_union(spark, sf_dir))


def _with_tag_columns(df: DataFrame) -> DataFrame:
    return df.select("agent_id", "idx", "time", "tag", "tokens", "text")


def _tags_as_text() -> Column:
    return F.concat(F.lit("('"), F.array_join("tags", "', '"), F.lit("')"))


def last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.last_entries(inputs.memory_log(spark, sf_dir)).select(
        "agent_id", "idx", "time", "text", "rank"
    )


def agent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.agent_context(
        inputs.memory_log(spark, sf_dir),
        inputs.agent_config(spark, sf_dir),
        F.expr("timestampadd(HOUR, CAST(agent_id % 24 AS int), TIMESTAMP_NTZ '2024-01-20 00:30:00')"),
    )


def layer_features(trips: DataFrame) -> DataFrame:
    return _features(_drawn(trips))


def _drawn(trips: DataFrame) -> DataFrame:
    drawn = layers.flow_features(flows.top_flows(trips, 20), sample=5)
    return drawn.unionByName(layers.top_route_features(modes.frequent_trips(trips, 20)))


def layer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers written to files, one dataset replaced later by its own run, and read back."""
    trips = inputs.trips(spark, sf_dir)
    path = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    drawn = _drawn(trips)
    weekend = F.col("dataset").endswith("Saturday")
    # A first draft of the weekend's layers, in grey; the rest is final.
    sinks.write_layers(drawn.withColumn("colour", F.when(weekend, "draft").otherwise(F.col("colour"))), path)
    sinks.write_layers(_drawn(trips.filter(weekend)), path)
    return _features(sinks.read_layers(spark, path, drawn))


def layer_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers as GeoJSON text, parsed again."""
    given = _drawn(inputs.trips(spark, sf_dir))
    feature = F.col("feature")
    style = ("kind", "colour", "dash", "tooltip", "popup")
    kind = F.get_json_object(feature, "$.geometry.type")
    place = F.get_json_object(feature, "$.geometry.coordinates")
    pairs = F.when(kind == "Point", F.array(F.from_json(place, "array<double>"))).otherwise(
        F.from_json(place, "array<array<double>>")
    )
    points = F.transform(pairs, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
    return sinks.to_geojson(given).select(
        "dataset",
        "mode",
        F.get_json_object(feature, "$.type").alias("type"),
        kind.alias("geometry"),
        points_text(points).alias("coords"),
        *[F.get_json_object(feature, f"$.properties.{c}").alias(c) for c in style],
        *[F.get_json_object(feature, f"$.properties.{c}").cast("double").alias(c) for c in ("size", "opacity")],
    )


def network_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(
        layers.network_features(_patterns(spark, sf_dir), REGION_LABEL, sample=10)
    )


def od_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(layers.fixed_colour_features(top_od_500(spark, sf_dir)))


def origin_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = origin_counts(spark, sf_dir)
    return _features(
        layers.origin_features(counts).unionByName(layers.origin_features(counts, classed=False))
    )


QUERIES: dict[str, Query] = {
    # Scans and names
    "trips_scan": trips_scan,
    "datasets_union": datasets_union,
    "companion_tables": companion_tables,
    "gtfs_stop_times": gtfs_stop_times,
    "gtfs_feed_folders": gtfs_feed_folders,
    "gtfs_feed_zips": gtfs_feed_zips,
    # Filters
    "valid_coords": _trip_query(
        lambda t: flows.valid_coords(t).select("dataset", "person_id", "mode", *OD_COLUMNS)
    ),
    "od_bbox_trips": _trip_query(_box_trips),
    "stored_od_box": stored_od_box,
    "quarter_daytype": _trip_query(regions.quarter_daytype),
    # Flows
    "od_flows": _trip_query(lambda t: flows.od_flows(flows.valid_coords(t))),
    "top_flows_per_mode": _trip_query(lambda t: flows.top_flows(t, 20, ordered=True)),
    "flow_rank": _trip_query(flows.top_flows),
    "top_flows_with_population": top_flows_with_population,
    "top_od_500": top_od_500,
    "flow_stats": _trip_query(lambda t: flows.flow_stats(flows.od_flows(flows.valid_coords(t)))),
    "trips_with_population": trips_with_population,
    # Modes and routes
    "mode_summary": _trip_query(modes.mode_summary),
    "mode_ranking": _trip_query(modes.mode_ranking),
    "mode_popularity": _trip_query(modes.mode_popularity),
    "mode_medians_merged": mode_medians_merged,
    "mode_statistics": _trip_query(modes.mode_statistics),
    "route_frequency": _trip_query(modes.route_frequency),
    "frequent_trips": _trip_query(modes.frequent_trips),
    # Regions
    "origin_counts": origin_counts,
    "tract_flows": _trip_query(regions.tract_flows),
    "bbox_mode_details": _trip_query(regions.bbox_mode_details),
    "bbox_mode_share": _trip_query(regions.bbox_mode_share),
    # Network routes
    "trip_links": _trip_query(
        lambda t: routes.trip_links(
            t.select("dataset", "person_id", "mode", "network_link_ids")
        ).withColumn("link_position", F.col("link_position").cast("long"))
    ),
    "trip_trajectories": trip_trajectories,
    "route_patterns": _patterns,
    "stitched_routes": stitched_routes,
    "missing_trajectory": missing_trajectory,
    # Schedules and offers
    "place_to_stop": place_to_stop,
    "fare_lookup": fare_lookup,
    "next_departure": next_departure,
    "offers_union": offers_union,
    "best_offer": best_offer,
    # Message logs
    "token_suffix_sum": _log_query(context.token_suffix_sum),
    "token_budget_context": _log_query(lambda log: _with_tag_columns(context.token_budget(log))),
    "adaptive_tail_context": _log_query(lambda log: _with_tag_columns(context.adaptive_tail(log))),
    "context_span": _log_query(lambda log: context.context_span(context.token_budget(log))),
    "context_text": _log_query(
        lambda log: context.context_text(context.token_budget(log)).select("agent_id", "context")
    ),
    "understanding_context": _log_query(context.understanding_context),
    "latest_by_tag": _log_query(context.latest_by_tag),
    "latest_by_text_tag": _log_query(
        lambda log: context.latest_by_tag(log.withColumn("tags", _tags_as_text()))
    ),
    "last_entries": last_entries,
    "agent_context": agent_context,
    "normalise_answers": lambda spark, sf_dir: context.normalise_answers(
        inputs.answers(spark, sf_dir)
    ),
    # Layers and reports
    "mode_colours": _trip_query(lambda t: layers.colours_by_name(flows.valid_coords(t))),
    "mode_colours_by_size": lambda spark, sf_dir: layers.colours_by_size(_patterns(spark, sf_dir)),
    "origin_sample": _trip_query(lambda t: layers.origin_sample(flows.top_flows(t), 5)),
    "layer_features": _trip_query(layer_features),
    "layer_files": layer_files,
    "layer_geojson": layer_geojson,
    "network_features": network_features,
    "od_line_features": od_line_features,
    "origin_features": origin_features,
    "dataset_report": _trip_query(reports.dataset_report),
}
