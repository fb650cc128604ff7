"""Joins whose hot keys adaptive execution can split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_TAG = "__tag"


def join_on_hot_keys(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", merge: bool = False
) -> DataFrame:
    """Join rows with an aggregate that has one row per key.

    An aggregate is already partitioned by its keys, so a join on the same keys
    would use it in place, and Spark splits a skewed partition only where both
    sides come straight from a shuffle of the join. A digest as one more join
    key asks for that shuffle; it carries one row per key. Leading the keys, the
    digest also settles most comparisons of the sort on its first eight bytes.

    ``merge``: neither side is broadcast. Spark goes by an estimate from the size
    of compressed files, in which an exploded array counts once and millions of
    equal rows of a hot key next to nothing, so it may send a table through the
    driver that is far beyond its limit.
    """
    tag = F.xxhash64(*keys)
    if merge:
        per_key = per_key.hint("merge")
    return (
        rows.withColumn(_TAG, tag)
        .join(per_key.withColumn(_TAG, tag), [_TAG, *keys], how)
        .drop(_TAG)
    )
