"""Trip, population and segment tables: declared schemas, scans and stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripflow.functions.geo import OD_COLUMNS

TRIPS = (
    "person_id long, mode string, start_lat double, start_lng double, end_lat double, "
    "end_lng double, distance_miles double, duration_minutes double, "
    "network_link_ids array<long>, origin_census_tract string, "
    "destination_census_tract string, passengers int, day_type string, quarter string"
)
POPULATION = "person_id long"
SEGMENTS = "stableEdgeId string, geometry string"


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with its declared schema; filters and columns reach the scan."""
    return spark.read.schema(schema).parquet(path)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """Trips of all datasets from files partitioned by ``dataset``."""
    return read_parquet(spark, path, TRIPS + ", dataset string")


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """People of all seasons from files partitioned by ``season``."""
    return read_parquet(spark, path, POPULATION + ", season string")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Network segments of all seasons from files partitioned by ``season``."""
    return read_parquet(spark, path, SEGMENTS + ", season string")


def curve_key(columns: Sequence[str] = OD_COLUMNS, bits: int = 15) -> Column:
    """Place on a Z-order curve of both ends: rows near in all four numbers are mostly near on it.

    Degrees are cut into ``2**bits`` steps (15: about 600 m) and their bits dealt
    in turn. Missing, NaN and outlying values take the nearest step.
    """
    steps = 2**bits - 1
    key = F.lit(0).cast("long")
    for place, column in enumerate(columns):
        limit = 90 if column.endswith("lat") else 180
        value = F.coalesce(F.nanvl(F.col(column), F.lit(0.0)), F.lit(0.0))
        step = F.least(F.greatest(F.floor((value + limit) / (2 * limit) * steps), F.lit(0)), F.lit(steps)).cast("long")
        for bit in range(bits):
            one = F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(one, bit * len(columns) + place))
    return key


def write_trips(trips: DataFrame, path: str, rows_per_page: int = 5_000) -> None:
    """Trips by dataset, each in the order of a curve through both ends.

    A box of origins and destinations then lies in few files and, inside them, in
    few pages: the Parquet statistics that every reader checks leave out the
    rest. Ranges of (dataset, curve) are dealt to as many tasks as there are
    shuffle partitions, so a large dataset is many files.
    """
    parts = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = trips.withColumn("__curve", curve_key())
    ordered = keyed.repartitionByRange(parts, "dataset", "__curve").sortWithinPartitions("dataset", "__curve")
    writer = ordered.drop("__curve").write.option("parquet.page.row.count.limit", rows_per_page)
    writer.partitionBy("dataset").parquet(path)


def stack_datasets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Trip tables under their labels as one table with a ``dataset`` column."""
    labelled = [df.withColumn("dataset", F.lit(label)) for label, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)
