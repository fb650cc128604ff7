"""Positions and running sums in an order, also where one group holds most rows.

A window over a group would sort it in one task. Here rows are dealt by ranges of
(group, order), so a large group spans many partitions. Each partition is summed
up by itself, the totals of the partitions before it are added, and only those
totals, one row per partition and group, meet in a window.

The dealt rows are written once to the shared folder: range bounds come from a
sample, and totals and rows have to see the same bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.sources.shared import cut

PART, PLACE = "__part", "__place"
_FIRST, _ROWS = "__first", "__rows"
# A partition id takes the upper 31 bits of Spark's increasing ids, a row number the lower 33.
_ROW_BITS = 33


def dealt(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` in ranges of (groups, order), nulls first, with ``__part`` and ``__place`` of each row.

    Places rise in order within a part, parts rise in order of their ranges. The
    order has to be total but for rows that may stand for each other.
    """
    keys = [F.asc_nulls_first(c) for c in [*groups, *order]]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(PLACE, ids)
    part = F.shiftright(PLACE, _ROW_BITS).cast("int")
    return cut(sorted_rows.withColumn(PART, part))


def with_other_parts(
    rows: DataFrame, groups: Sequence[str], totals: Mapping[str, Column], after: bool = False
) -> DataFrame:
    """Dealt ``rows`` with the aggregates ``totals`` over the parts of their group before (or after) their own.

    ``__first`` is the group's first place in the part and ``__rows`` the size
    of the group. The aggregates must be sums or counts.
    """
    per_part = rows.groupBy(*groups, PART).agg(
        F.min(PLACE).alias(_FIRST), F.count(F.lit(1)).alias(_ROWS), *[c.alias(name) for name, c in totals.items()]
    )
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    others = group.orderBy(F.desc(PART) if after else F.asc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    names = {c: f"__{i}" for i, c in enumerate([*groups, PART])}
    offsets = per_part.select(
        *[F.col(c).alias(name) for c, name in names.items()],
        _FIRST,
        F.sum(_ROWS).over(group).alias(_ROWS),
        *[F.coalesce(F.sum(name).over(others), F.lit(0)).alias(name) for name in totals],
    )
    same = [F.col(c).eqNullSafe(F.col(name)) for c, name in names.items()]
    return rows.join(offsets, same).drop(*names.values())


def positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], position: str = "position", size: str = "group_rows"
) -> DataFrame:
    """``df`` with the place of each row in its group, from 0, and the size of the group."""
    placed = with_other_parts(dealt(df, groups, order), groups, {"__before": F.count(F.lit(1))})
    at = F.col("__before") + F.col(PLACE) - F.col(_FIRST)
    return placed.select(*df.columns, at.alias(position), F.col(_ROWS).alias(size))


def suffix_sums(rows: DataFrame, groups: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Dealt ``rows`` with each amount of ``sums`` summed from the row itself to the end of its group.

    The windows see one part of a group at most.
    """
    amounts = {f"__of_{name}": amount for name, amount in sums.items()}
    rows = rows.withColumns(amounts)
    later = with_other_parts(rows, groups, {name: F.sum(f"__of_{name}") for name in sums}, after=True)
    inside = Window.partitionBy(PART, *groups).orderBy(F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    upto = {name: F.sum(f"__of_{name}").over(inside) + F.col(name) for name in sums}
    return later.withColumns(upto).drop(*amounts, _FIRST, _ROWS)
