"""Rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_places(value: Column, digits: int) -> Column:
    """A double rounded as warehouses do: scaled, rounded half away from zero, scaled back.

    ``F.round`` judges ties on the shortest decimal text instead, so 32.175,
    which is stored slightly below the tie, would go up.
    """
    scale = F.lit(float(10**digits))
    return F.round(value * scale, 0) / scale
