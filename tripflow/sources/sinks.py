"""Map layers as JSON files and GeoJSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_layers(features: DataFrame, path: str, partition_by=("dataset", "mode")) -> None:
    """One folder per dataset and mode, written by as many tasks as hold its rows.

    Only the folders that ``features`` have rows for are replaced; others stay as they are.
    """
    writer = features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).json(path)


def read_layers(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Layers written by `write_layers`, with the columns and types of ``like``."""
    return spark.read.schema(like.schema).json(path).select(*like.columns)


def to_geojson(features: DataFrame) -> DataFrame:
    """Each feature as the text of a GeoJSON Feature, longitude first."""
    pairs = F.transform("coords", lambda p: F.array(p.lng, p.lat))
    style = F.struct("kind", "colour", "size", "opacity", "dash", "tooltip", "popup")
    point = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.get(pairs, F.lit(0)).alias("coordinates")).alias(
                "geometry"
            ),
            style.alias("properties"),
        )
    )
    line = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates")).alias("geometry"),
            style.alias("properties"),
        )
    )
    return features.select(
        "dataset", "mode", F.when(F.size("coords") == 1, point).otherwise(line).alias("feature")
    )
