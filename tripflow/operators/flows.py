"""Origin-destination flows: counts, the largest ones per mode, their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions.geo import OD_COLUMNS, valid_od
from tripflow.functions.style import known_mode
from tripflow.operators.prefilter import key_filter, may_have_key
from tripflow.operators.skew import join_on_hot_keys
from tripflow.operators.topn import in_order, top_per_group

BY = ("dataset", "mode")


def valid_coords(trips: DataFrame) -> DataFrame:
    """Trips whose both ends are valid WGS84 coordinates."""
    return trips.filter(valid_od())


def season_of(dataset: str = "dataset"):
    """Season label of a dataset label: 'Q2 Thursday' -> 'Q2'."""
    return F.substring_index(F.col(dataset), " ", 1)


def with_population(trips: DataFrame, population: DataFrame) -> DataFrame:
    """Trips with the number of matching population rows as ``copies``.

    The inner join repeats a trip once per population row of its person, so
    counting with ``copies`` as weight equals counting after that join while
    no person meets its copies pair by pair. Where a filter can hold the
    population, trips of other people drop at the scan, before they are shuffled.
    Neither side is broadcast, however small Spark takes it for.
    """
    people = population.groupBy("season", "person_id").agg(F.count(F.lit(1)).alias("copies"))
    cells = key_filter(population.select("season", F.col("person_id").cast("long").alias("person_id")), ["season", "person_id"])
    known = may_have_key(cells, [season_of(), F.col("person_id").cast("long")])
    return join_on_hot_keys(
        trips.filter(known).withColumn("season", season_of()), people, ["season", "person_id"], merge=True
    )


def trips_with_population(trips: DataFrame, population: DataFrame) -> DataFrame:
    """Inner join with the population, one row per trip and population row."""
    return (
        with_population(trips, population)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("copies", "copy")
    )


def od_flows(
    trips: DataFrame, by: Sequence[str] = BY, population: DataFrame | None = None
) -> DataFrame:
    """Trips per origin, destination and group; with a population, of its people only."""
    count = F.count(F.lit(1))
    if population is not None:
        trips = with_population(trips, population)
        count = F.sum("copies")
    return trips.groupBy(*by, *OD_COLUMNS).agg(count.alias("trip_count"))


def largest_first(by: Sequence[str] = ("mode",)):
    """Most trips first, then every key, so that ties are settled the same way each run."""
    return [F.desc("trip_count"), *in_order([*by, *OD_COLUMNS])]


def _size_keys() -> list[Column]:
    """The order of the largest flows as numbers.

    On a logarithm small counts, which most flows share, have bins of their own.
    """
    return [-F.log2("trip_count"), *[F.col(c) for c in OD_COLUMNS]]


def top_flows(
    trips: DataFrame,
    n: int = 1000,
    by: Sequence[str] = BY,
    population: DataFrame | None = None,
    ordered: bool = False,
) -> DataFrame:
    """The n largest valid flows of each group, ranked."""
    flows = od_flows(valid_coords(trips), by, population)
    top = top_per_group(flows, by, largest_first(()), n, keys=_size_keys())
    return top.orderBy(*in_order(by), "rank") if ordered else top


def top_od(trips: DataFrame, n: int = 500, population: DataFrame | None = None) -> DataFrame:
    """The n largest flows of each dataset over all modes; coordinates unchecked."""
    return top_per_group(
        od_flows(trips, BY, population), ["dataset"], largest_first(("mode",)), n, keys=_size_keys()[:1]
    )


def flow_stats(flows: DataFrame, top_modes: int = 3) -> DataFrame:
    """Per dataset: sum, maximum and mean of the flow counts and its leading modes.

    ``flows`` are all flows, however few of them a map would draw.
    """
    per_mode = flows.groupBy("dataset", "mode").agg(
        F.sum("trip_count").alias("total"),
        F.max("trip_count").alias("largest"),
        F.count(F.lit(1)).alias("flows"),
    )
    return stats_over_modes(per_mode, top_modes)


def leading_modes(place: str, top_modes: int):
    """Mode names up to a place, in order; collects no more than that many."""
    leader = F.when(
        F.col(place) <= top_modes,
        F.struct(F.col(place).alias("place"), known_mode(F.col("mode")).alias("mode")),
    )
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(leader)), lambda s: s.mode), ", "
    )


def stats_over_modes(per_mode: DataFrame, top_modes: int, *more) -> DataFrame:
    """Flow statistics from one row per dataset and mode, plus further aggregates.

    Flows without a mode are a mode of their own and rank like any other.
    """
    standing = Window.partitionBy("dataset").orderBy(F.desc("total"), F.asc_nulls_first("mode"))
    return (
        per_mode.withColumn("place", F.row_number().over(standing))
        .groupBy("dataset")
        .agg(
            F.sum("total").alias("total_route_instances"),
            F.max("largest").alias("max_route_frequency"),
            (F.sum("total") / F.sum("flows")).alias("avg_route_frequency"),
            leading_modes("place", top_modes).alias("top_route_modes"),
            *more,
        )
    )
