"""Table names and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def season_prefix(table: Column) -> Column:
    """First three parts of a trip table name."""
    return F.substring_index(table, "_", 3)


def population_table(table: Column) -> Column:
    return F.concat(season_prefix(table), F.lit("_population"))


def segments_table(table: Column) -> Column:
    """Segments of the season named in the table name, the Q4 ones otherwise."""
    region = F.substring_index(table, "_", 2)
    season = F.when(table.contains("Q2"), F.lit("Q2")).otherwise(F.lit("Q4"))
    return F.concat(region, F.lit("_"), season, F.lit("_network_segments"))


def companion_tables(tables: DataFrame, name: str = "table_name") -> DataFrame:
    """Each distinct trip table with its population and segment table."""
    table = F.col(name)
    return tables.select(name).distinct().select(
        name,
        population_table(table).alias("population_table"),
        segments_table(table).alias("segments_table"),
    )


def table_columns(df: DataFrame) -> DataFrame:
    """Column names and types in name order; reads the schema only."""
    fields = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    rows = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for n, t in fields]
    )
    return df.sparkSession.range(1).select(F.inline(rows))
