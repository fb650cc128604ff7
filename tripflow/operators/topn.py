"""Exact top-n per group that survives a group holding a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.sources.shared import cut

_SPREAD = "__spread"
# Bins of a histogram, per group and key.
BINS = 4096


def _narrowed(rows: DataFrame, groups: Sequence[str], key: Column, n: int) -> DataFrame:
    """``rows`` less those whose key is beyond the bin in which their group's n-th row lies.

    ``rows`` have ``__sure`` (certainly among the first n), and ``__tied`` (of
    those not sure, whether all keys so far are equal). A group has ``BINS`` bins
    between the smallest and the largest key of its tied rows; nulls are a bin
    before them and NaN one behind.
    """
    keyed = rows.withColumn("__key", key.cast("double"))
    unsure = keyed.filter(~F.col("__sure"))
    number = F.when(~F.isnan("__key"), F.col("__key"))
    ranges = cut(
        unsure.groupBy(*groups).agg(
            F.min(number).alias("__low"), F.max(number).alias("__high"), F.bool_and("__tied").alias("__all_tied")
        ).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__low", "__high", "__all_tied")
    )
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    share = F.try_divide(F.col("__key") - F.col("__low"), F.col("__high") - F.col("__low"))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")
    bin_ = F.when(F.col("__key").isNull(), -1).when(F.isnan("__key"), BINS).otherwise(place)
    placed = keyed.join(ranges, same, "left").drop(*[f"__g{i}" for i in range(len(groups))])
    # Rows that earlier keys leave in different order stay as they are.
    placed = placed.withColumn("__bin", F.when(~F.col("__sure") & F.col("__all_tied"), bin_))
    upto = Window.partitionBy(*groups).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*groups).agg(F.count_if("__sure").alias("__n_sure"))
    bins = placed.filter(F.col("__bin").isNotNull()).groupBy(*groups, "__bin").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__k0"), F.max("__key").alias("__k1")
    )
    sure = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], "__n_sure")
    limits = cut(
        bins.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
        .join(sure, same)
        .filter(F.col("__before") + F.col("__n_sure") < n)
        .groupBy(*[f"__g{i}" for i in range(len(groups))])
        .agg(
            F.max("__bin").alias("__limit"),
            F.max_by(F.col("__k0").eqNullSafe(F.col("__k1")), "__bin").alias("__one_key"),
        )
    )
    marked = placed.join(limits, same, "left").drop(*[f"__g{i}" for i in range(len(groups))])
    inside = F.col("__bin").isNull() | (F.col("__bin") <= F.col("__limit"))
    return (
        marked.filter(inside)
        .withColumn("__tied", F.coalesce(F.col("__all_tied") & F.col("__one_key"), F.lit(False)))
        .withColumn("__sure", F.col("__sure") | F.coalesce(F.col("__bin") < F.col("__limit"), F.lit(False)))
        .drop("__key", "__low", "__high", "__all_tied", "__bin", "__limit", "__one_key")
    )


def can_be_first(df: DataFrame, groups: Sequence[str], keys: Sequence[Column], n: int) -> DataFrame:
    """A part of ``df`` that holds the n first rows of each group in the order of ``keys``.

    ``keys`` are numbers, smaller ones first, nulls before all. Histograms of a
    key per group tell the bin of the n-th row; rows beyond it drop where they
    are, and rows that tie with it go on to the next key. What is left of a group
    are n rows and those that share the last bin. Only bins and limits, a row
    each per group, are shuffled; limits are stored, so that Spark knows their
    size when it chooses the join.
    """
    rows = df.withColumns({"__sure": F.lit(False), "__tied": F.lit(True)})
    for key in keys:
        rows = _narrowed(rows, groups, key, n)
    return rows.drop("__sure", "__tied")


def top_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_col: str = "rank",
    fan_in: int | None = None,
    keys: Sequence[Column] = (),
) -> DataFrame:
    """The n first rows of each group with their rank, starting at 1.

    ``order`` has to be total for repeatable results. Rows are ranked twice:
    within (group, slice of the input partitions), then within the group over
    the slice winners alone. A row outside its slice's first n cannot be in the
    group's first n, so nothing is lost, and the last step sees at most
    n * fan_in rows of a group however large the group is. There are as many
    slices as shuffle partitions, 64 at least. Up to the
    optimizer's group-limit threshold each task also drops rows before the
    first shuffle; beyond it `can_be_first` does, if ``keys`` give the leading
    part of the order as numbers. ``df`` is then stored, as it is read more than once.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit and keys:
        df = can_be_first(cut(df), groups, keys, n)
    if fan_in is None:
        fan_in = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.withColumn(_SPREAD, F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    by_slice = Window.partitionBy(*groups, _SPREAD).orderBy(*order)
    winners = (
        spread.withColumn(rank_col, F.row_number().over(by_slice))
        .filter(F.col(rank_col) <= n)
        .drop(_SPREAD, rank_col)
    )
    by_group = Window.partitionBy(*groups).orderBy(*order)
    return (
        winners.withColumn(rank_col, F.row_number().over(by_group))
        .filter(F.col(rank_col) <= n)
        .withColumn(rank_col, F.col(rank_col).cast("long"))
    )


def in_order(columns: Sequence[str]) -> list[Column]:
    """Ascending tie-break over key columns, NULL first."""
    return [F.asc_nulls_first(c) for c in columns]
