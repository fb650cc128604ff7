"""Regions: bounding boxes, origin points, census tracts, day and quarter filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tripflow.functions.geo import (
    DESTINATION_BOX,
    ORIGIN_BOX,
    Box,
    in_box,
    point_wkt,
    point_xy,
    valid_start,
)
from tripflow.operators.flows import with_population
from tripflow.operators.modes import averages, share_of_dataset, usable
from tripflow.operators.topn import in_order, top_per_group


def od_bbox(
    trips: DataFrame, origin_box: Box = ORIGIN_BOX, dest_box: Box = DESTINATION_BOX
) -> DataFrame:
    """Trips starting in one box and ending in the other."""
    return trips.filter(
        in_box("start_lat", "start_lng", origin_box) & in_box("end_lat", "end_lng", dest_box)
    )


def bbox_mode_details(
    trips: DataFrame, origin_box: Box = ORIGIN_BOX, dest_box: Box = DESTINATION_BOX
) -> DataFrame:
    """Per mode between the boxes: trips, averages and ranges."""
    return (
        od_bbox(trips, origin_box, dest_box)
        .filter(usable())
        .groupBy("dataset", "mode")
        .agg(
            F.count(F.lit(1)).alias("total_trips"),
            *averages(),
            F.min("distance_miles").alias("min_distance_miles"),
            F.max("distance_miles").alias("max_distance_miles"),
            F.min("duration_minutes").alias("min_duration_min"),
            F.max("duration_minutes").alias("max_duration_min"),
        )
    )


def bbox_mode_share(
    trips: DataFrame, origin_box: Box = ORIGIN_BOX, dest_box: Box = DESTINATION_BOX
) -> DataFrame:
    """Per mode between the boxes: trips and share of the dataset."""
    counts = (
        od_bbox(trips, origin_box, dest_box)
        .filter(usable())
        .groupBy("dataset", "mode")
        .agg(F.count(F.lit(1)).alias("total_trips"))
    )
    return counts.withColumn("percentage", share_of_dataset("total_trips", 1))


def origin_counts(
    trips: DataFrame, n: int = 500, population: DataFrame | None = None
) -> DataFrame:
    """The n busiest origin points of each dataset and mode pair, as WKT and x, y.

    Grouping runs on the coordinates and the text is built for the n rows kept.
    Starts outside WGS84 make no point and are left out.
    """
    count = F.count(F.lit(1))
    if population is not None:
        trips = with_population(trips, population)
        count = F.sum("copies")
    points = (
        trips.filter(valid_start())
        .groupBy("dataset", "start_lng", "start_lat", "mode")
        .agg(count.alias("trip_count"))
    )
    order = [F.desc("trip_count"), *in_order(["mode", "start_lat", "start_lng"])]
    top = top_per_group(points, ["dataset"], order, n).withColumn(
        "origin_wkt", point_wkt(F.col("start_lat"), F.col("start_lng"))
    )
    x, y = point_xy(F.col("origin_wkt"))
    return top.select("dataset", "mode", "origin_wkt", "trip_count", "rank", x, y)


def tract_flows(trips: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Trips per pair of census tracts."""
    return trips.groupBy(*by, "origin_census_tract", "destination_census_tract").agg(
        F.count(F.lit(1)).alias("trip_count")
    )


def quarter_daytype(
    trips: DataFrame, quarters: Sequence[str] = ("Q2", "Q4"), day_type: str = "weekday"
) -> DataFrame:
    """Trips of some quarters on one kind of day, flat columns."""
    return trips.filter(
        F.col("quarter").isin(*quarters) & (F.col("day_type") == day_type)
    ).select(
        F.col("start_lat").alias("origin_lat"),
        F.col("start_lng").alias("origin_lon"),
        F.col("end_lat").alias("dest_lat"),
        F.col("end_lng").alias("dest_lon"),
        "passengers",
        "day_type",
        "quarter",
    )
