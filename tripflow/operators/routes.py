"""Road-network trajectories: link ids to geometries, route patterns, stitched lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tripflow.functions.geo import OD_COLUMNS, stitch, trajectory_lines
from tripflow.functions.numbers import round_places
from tripflow.operators.flows import season_of
from tripflow.operators.skew import join_on_hot_keys


def route_key(links: Column) -> Column:
    """Digest of a link list. The text keeps NULL elements apart from absent ones."""
    return F.unhex(F.sha2(links.cast("string"), 256))


def has_links(links: str = "network_link_ids") -> Column:
    return F.size(links) > 0


def trip_links(trips: DataFrame) -> DataFrame:
    """One row per trip and link; trips without links give none."""
    others = [c for c in trips.columns if c != "network_link_ids"]
    return trips.select(
        *others, F.posexplode("network_link_ids").alias("link_position", "link_id")
    )


def unique_segments(segments: DataFrame) -> DataFrame:
    """One geometry per season and segment id, so that joining links adds no rows."""
    return segments.groupBy(
        "season", F.col("stableEdgeId").cast("string").alias("edge")
    ).agg(F.min("geometry").alias("geometry"))


def link_trajectories(lists: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows with ``network_link_ids`` -> joined geometries, matched and total links.

    Rows must be distinct in season and their other columns, which come back
    with the ``route`` digest in place of the list. A digest needs no row
    number and is the same when a lost task runs again.
    """
    kept = [c for c in lists.columns if c != "network_link_ids"]
    links = lists.select(
        *kept,
        route_key(F.col("network_link_ids")).alias("route"),
        F.posexplode("network_link_ids").alias("link_position", "link_id"),
    ).withColumn("edge", F.col("link_id").cast("string"))
    return (
        join_on_hot_keys(links, unique_segments(segments), ["season", "edge"], "left")
        .groupBy(*kept, "route")
        .agg(
            F.expr("listagg(geometry, '|') WITHIN GROUP (ORDER BY link_position)").alias(
                "trajectory_segments"
            ),
            F.count("geometry").alias("matched_segments"),
            F.count("link_id").alias("total_links"),
        )
    )


def well_matched(min_matched: float) -> Column:
    return (F.col("matched_segments") > 0) & (
        F.try_divide("matched_segments", "total_links") >= F.lit(min_matched)
    )


def trajectories(trips: DataFrame, segments: DataFrame, min_matched: float = 0.5) -> DataFrame:
    """Trips with their trajectory, where at least this share of the links is known.

    A trajectory depends on the link list alone, so each list is looked up once
    however many trips took it, and only lists, not trips, are exploded.
    """
    linked = trips.filter(has_links()).withColumn("season", season_of())
    lists = linked.select("season", "network_link_ids").distinct()
    known = link_trajectories(lists, segments).filter(well_matched(min_matched))
    keyed = linked.withColumn("route", route_key(F.col("network_link_ids")))
    return join_on_hot_keys(
        keyed.drop("network_link_ids"), known, ["season", "route"]
    ).drop("route")


def _trips_per_list(trips: DataFrame, *measures: Column) -> DataFrame:
    """Trips counted per group, ends and link list, before any link is looked up."""
    return (
        trips.filter(has_links())
        .groupBy("dataset", "mode", *OD_COLUMNS, "network_link_ids")
        .agg(F.count(F.lit(1)).alias("n"), *measures)
        .withColumn("season", season_of())
    )


def route_patterns(trips: DataFrame, segments: DataFrame, min_matched: float = 0.5) -> DataFrame:
    """Trips that share ends, mode and trajectory: count and averages.

    Trips are summed per link list, then per trajectory, because different
    lists can give the same one. Each list is looked up once, whoever took it,
    by a second and narrow scan; only lists are exploded. Patterns are grouped by
    the 128-bit digest of their trajectory, and its text is joined last.
    """
    sums = [
        f(c).alias(f"{name}_{c}")
        for c in ("distance_miles", "duration_minutes")
        for name, f in (("sum", F.sum), ("known", F.count))
    ]
    lists = trips.filter(has_links()).select(season_of().alias("season"), "network_link_ids").distinct()
    known = link_trajectories(lists, segments).filter(well_matched(min_matched))
    # Many lists and many ends share a trajectory: a digest stands for its text until the end.
    known = known.withColumn("drawn", F.unhex(F.md5("trajectory_segments")))
    texts = known.groupBy("drawn").agg(F.first("trajectory_segments").alias("trajectory_segments"))
    counted = _trips_per_list(trips, *sums).withColumn("route", route_key(F.col("network_link_ids")))
    patterns = (
        join_on_hot_keys(
            counted.drop("network_link_ids"), known.select("season", "route", "drawn"), ["season", "route"]
        )
        .groupBy("dataset", "mode", *OD_COLUMNS, "drawn")
        .agg(
            F.sum("n").alias("trip_count"),
            round_places(
                F.sum("sum_distance_miles") / F.sum("known_distance_miles"), 2
            ).alias("avg_distance_miles"),
            round_places(
                F.sum("sum_duration_minutes") / F.sum("known_duration_minutes"), 2
            ).alias("avg_duration_min"),
        )
    )
    averages = ["trip_count", "avg_distance_miles", "avg_duration_min"]
    return join_on_hot_keys(patterns, texts, ["drawn"]).select(
        "dataset", "mode", *OD_COLUMNS, "trajectory_segments", *averages
    )


def missing_trajectory(trips: DataFrame, segments: DataFrame) -> DataFrame:
    """Per dataset and mode: distinct routes and trips whose links match no geometry.

    Whether a list has any text is a flag per list; no geometry leaves its scan.
    """
    counted = _trips_per_list(trips).withColumn("route", route_key(F.col("network_link_ids")))
    links = (
        counted.select("season", "route", "network_link_ids")
        .dropDuplicates(["season", "route"])
        .select("season", "route", F.explode(F.array_distinct("network_link_ids").cast("array<string>")).alias("edge"))
    )
    drawn = segments.groupBy("season", F.col("stableEdgeId").cast("string").alias("edge")).agg(
        F.bool_or(F.col("geometry").isNotNull() & (F.col("geometry") != "")).alias("drawn")
    )
    seen = join_on_hot_keys(links, drawn.filter("drawn"), ["season", "edge"]).select("season", "route").distinct()
    return (
        join_on_hot_keys(counted.drop("network_link_ids"), seen, ["season", "route"], "left_anti")
        .groupBy("dataset", "mode")
        .agg(F.count(F.lit(1)).alias("route_patterns"), F.sum("n").alias("trip_count"))
    )


def stitched(patterns: DataFrame, eps: float = 0.0005) -> DataFrame:
    """Patterns with their geometry as one line of points, parsed once per pattern."""
    return patterns.withColumn(
        "points", stitch(trajectory_lines(F.col("trajectory_segments")), eps)
    )
