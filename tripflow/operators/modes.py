"""Mode shares, mode statistics and the most frequent routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions.geo import OD_COLUMNS
from tripflow.functions.numbers import round_places
from tripflow.operators.flows import valid_coords
from tripflow.operators.topn import in_order, top_per_group


def usable() -> Column:
    """Positive distance and duration; NaN, which Spark ranks above all numbers, fails."""
    checks = [
        (F.col(c) > 0) & ~F.isnan(c) for c in ("distance_miles", "duration_minutes")
    ]
    return checks[0] & checks[1]


def averages(digits: int = 2) -> list[Column]:
    return [
        round_places(F.avg("distance_miles"), digits).alias("avg_distance_miles"),
        round_places(F.avg("duration_minutes"), digits).alias("avg_duration_min"),
    ]


def share_of_dataset(count: str, digits: int) -> Column:
    """Percentage of the dataset's total; runs on one row per mode."""
    total = F.sum(count).over(Window.partitionBy("dataset"))
    return round_places(F.col(count) * F.lit(100.0) / total, digits)


def mode_summary(trips: DataFrame, digits: int = 2) -> DataFrame:
    """Trips, average distance and duration and share of each mode."""
    per_mode = (
        trips.filter(usable())
        .groupBy("dataset", "mode")
        .agg(F.count(F.lit(1)).alias("total_trips"), *averages())
    )
    return per_mode.withColumn("percentage", share_of_dataset("total_trips", digits))


def mode_popularity(trips: DataFrame, digits: int = 1) -> DataFrame:
    """Trips and share of each mode."""
    per_mode = (
        trips.filter(usable())
        .groupBy("dataset", "mode")
        .agg(F.count(F.lit(1)).alias("total_individual_trips"))
    )
    return per_mode.withColumn("percentage", share_of_dataset("total_individual_trips", digits))


def mode_ranking(trips: DataFrame, n: int = 5) -> DataFrame:
    """The n most used modes of each dataset, ranked; one row per mode goes in."""
    place = Window.partitionBy("dataset").orderBy(
        F.desc("total_trips"), F.asc_nulls_first("mode")
    )
    return (
        mode_summary(trips)
        .withColumn("rank", F.row_number().over(place).cast("long"))
        .filter(F.col("rank") <= n)
    )


def route_frequency(trips: DataFrame, n: int = 10) -> DataFrame:
    """The n most repeated exact routes of each dataset."""
    routes = (
        trips.filter(usable())
        .groupBy("dataset", "mode", *OD_COLUMNS)
        .agg(F.count(F.lit(1)).alias("route_frequency"), *averages())
    )
    order = [F.desc("route_frequency"), *in_order(["mode", *OD_COLUMNS])]
    return top_per_group(routes, ["dataset"], order, n)


def frequent_trips(trips: DataFrame, n: int = 20) -> DataFrame:
    """As ``route_frequency`` over valid coordinates, with the range of distances."""
    routes = (
        valid_coords(trips)
        .filter(usable())
        .groupBy("dataset", "mode", *OD_COLUMNS)
        .agg(
            F.count(F.lit(1)).alias("trip_count"),
            *averages(),
            F.min("distance_miles").alias("min_distance_miles"),
            F.max("distance_miles").alias("max_distance_miles"),
        )
    )
    order = [F.desc("trip_count"), *in_order(["mode", *OD_COLUMNS])]
    return top_per_group(routes, ["dataset"], order, n)


def mode_statistics(trips: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """Per mode: trips, averages, sample deviation, approximate median, distinct routes.

    Two aggregations rather than one: next to a distinct count every route
    would carry its own median sketch through the shuffle. Apart, the sketches
    are one per mode and task, and the routes are counted after a plain
    distinct. Both results have one row per mode.
    """
    rows = trips.filter(usable())
    numbers = rows.groupBy("dataset", "mode").agg(
        F.count(F.lit(1)).alias("total_trips"),
        *averages(),
        round_places(F.stddev_samp("duration_minutes"), 2).alias("std_duration_min"),
        F.percentile_approx("duration_minutes", 0.5, accuracy).alias("median_duration_min"),
    )
    complete = rows
    for column in OD_COLUMNS:
        complete = complete.filter(F.col(column).isNotNull())
    routes = (
        complete.select("dataset", "mode", *OD_COLUMNS)
        .distinct()
        .groupBy("dataset", "mode")
        .agg(F.count(F.lit(1)).alias("unique_routes"))
        .select(
            F.col("dataset").alias("r_dataset"), F.col("mode").alias("r_mode"), "unique_routes"
        )
    )
    same = F.col("dataset").eqNullSafe(F.col("r_dataset")) & F.col("mode").eqNullSafe(
        F.col("r_mode")
    )
    return (
        numbers.join(routes, same, "left")
        .drop("r_dataset", "r_mode")
        .fillna(0, ["unique_routes"])
    )


# Items a quantile sketch keeps per level: ranks are within half a percent or so.
SKETCH_ITEMS = 1024


def duration_sketches(trips: DataFrame, by: Sequence[str] = ("dataset", "mode", "day_type", "quarter")) -> DataFrame:
    """A mergeable quantile sketch of the durations of each group, with its bounds.

    A sketch has a size that hardly grows with the trips. Stored, it stands for
    them: new days add sketches, and no old trip is read again.
    """
    return trips.filter(usable()).groupBy(*by).agg(
        F.kll_sketch_agg_double("duration_minutes", F.lit(SKETCH_ITEMS)).alias("sketch"),
        F.count(F.lit(1)).alias("trips"),
        F.min("duration_minutes").alias("shortest"),
        F.max("duration_minutes").alias("longest"),
    )


def merged_quantiles(
    sketches: DataFrame, by: Sequence[str] = ("dataset", "mode"), share: float = 0.5, name: str = "median_duration_min"
) -> DataFrame:
    """Trips and a quantile of the durations of each group, from its sketches alone."""
    merged = sketches.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("trips").alias("trips"),
        F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"),
    )
    quantile = F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    return merged.select(*by, "trips", "shortest", "longest", quantile.alias(name))


def rank_errors(
    trips: DataFrame, quantiles: DataFrame, by: Sequence[str] = ("dataset", "mode"), share: float = 0.5,
    name: str = "median_duration_min",
) -> DataFrame:
    """How far the rank of each quantile lies from ``share`` among the trips themselves."""
    renamed = quantiles.select(*[F.col(c).alias(f"q_{c}") for c in by], F.col(name).alias("quantile"))
    same = [F.col(c).eqNullSafe(F.col(f"q_{c}")) for c in by]
    ranks = trips.filter(usable()).join(renamed, same).groupBy(*by).agg(
        (F.count_if(F.col("duration_minutes") < F.col("quantile")) / F.count(F.lit(1))).alias("below"),
        (F.count_if(F.col("duration_minutes") <= F.col("quantile")) / F.count(F.lit(1))).alias("upto"),
    )
    return ranks.select(*by, F.greatest(F.col("below") - share, share - F.col("upto"), F.lit(0.0)).alias("rank_error"))
