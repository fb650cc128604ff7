"""The summary of each dataset: popularity, route counts and the leading route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tripflow.functions.geo import OD_COLUMNS
from tripflow.functions.numbers import round_places
from tripflow.operators.flows import leading_modes, stats_over_modes, valid_coords
from tripflow.operators.modes import mode_popularity, usable


def popularity_report(trips: DataFrame) -> DataFrame:
    """Per dataset: the most used mode, its share and the three leading modes."""
    place = Window.partitionBy("dataset").orderBy(
        F.desc("total_individual_trips"), F.asc_nulls_first("mode")
    )
    first = F.col("place") == 1
    return (
        mode_popularity(trips)
        .withColumn("place", F.row_number().over(place))
        .groupBy("dataset")
        .agg(
            F.max(F.when(first, F.col("mode"))).alias("top_mode"),
            F.max(F.when(first, F.col("percentage"))).alias("top_mode_percentage"),
            F.max(F.when(first, F.col("total_individual_trips"))).alias("top_mode_trips"),
            leading_modes("place", 3).alias("top_modes"),
        )
    )


def dataset_report(trips: DataFrame) -> DataFrame:
    """One row per dataset: flow statistics, popularity and the most repeated route.

    All flows count. One aggregate per origin, destination and mode is reduced
    to a row per mode, which carries its totals and its most repeated usable
    route, and those rows to one. Popularity also counts trips with invalid
    ends and is a second, narrow scan that shuffles one row per mode and task.
    """
    good = usable()
    od = valid_coords(trips).groupBy("dataset", "mode", *OD_COLUMNS).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.count_if(good).alias("usable_trips"),
        F.avg(F.when(good, F.col("distance_miles"))).alias("avg_distance"),
        F.avg(F.when(good, F.col("duration_minutes"))).alias("avg_duration"),
    )
    # The least of these is the route with most trips, ties by mode and ends.
    route = F.when(
        F.col("usable_trips") > 0,
        F.struct(
            (-F.col("usable_trips")).alias("fewer"),
            "mode",
            *OD_COLUMNS,
            "avg_distance",
            "avg_duration",
        ),
    )
    per_mode = od.groupBy("dataset", "mode").agg(
        F.sum("trip_count").alias("total"),
        F.max("trip_count").alias("largest"),
        F.count(F.lit(1)).alias("flows"),
        F.min(route).alias("route"),
    )
    stats = stats_over_modes(per_mode, 3, F.min("route").alias("route"))
    return (
        stats.join(popularity_report(trips), "dataset", "left")
        .withColumns(
            {
                "top_route_mode": F.col("route.mode"),
                "top_route_trips": -F.col("route.fewer"),
                "top_route_distance_miles": round_places(F.col("route.avg_distance"), 2),
                "top_route_duration_min": round_places(F.col("route.avg_duration"), 2),
            }
        )
        .drop("route")
    )
