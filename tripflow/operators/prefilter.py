"""A Bloom filter of join keys, applied where rows are scanned."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripflow.sources.shared import cut

# The filter has a byte per cell and this many cells at most: 1 MB. The driver copies it
# for every stage that has it in its tasks; one of 16 MB filled a heap of 750 MB.
MAX_CELLS = 2**20
# Cells per key. With two probes about one row in twenty without a key passes.
CELLS_PER_KEY = 8
PROBES = 2
# Spark's bitmaps have so many bits.
BITMAP_BITS = 2**15


class KeyFilter(NamedTuple):
    """One stored row with one byte per cell."""

    cells: DataFrame
    n_cells: int


def _cells(keys: Sequence[str | Column], n_cells: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(n_cells)).cast("int") for i in range(PROBES)]


def key_filter(keys: DataFrame, columns: Sequence[str]) -> KeyFilter | None:
    """The cells of all keys; None where there are more keys than a filter may hold.

    The number of keys is estimated first, so the filter is as large as it needs
    to be. Tasks pack the cells into bitmaps, so the driver gets a bit per cell.
    A row in the shared folder, unlike a literal, is in no plan, so it is neither
    copied when a plan is rewritten nor printed with it.
    """
    n = keys.agg(F.approx_count_distinct(F.struct(*columns))).first()[0]
    n_cells = 1 << max(10, (CELLS_PER_KEY * n - 1).bit_length() if n else 0)
    if n_cells > MAX_CELLS:
        return None
    used = keys.select(F.explode(F.array(*_cells(columns, n_cells))).alias("cell"))
    bitmaps = used.groupBy(F.expr(f"cell DIV {BITMAP_BITS}").alias("at")).agg(
        F.bitmap_construct_agg(F.col("cell").cast("long") % BITMAP_BITS).alias("bits")
    )
    cells = np.zeros((-(-n_cells // BITMAP_BITS), BITMAP_BITS), dtype=np.uint8)
    for row in bitmaps.collect():
        cells[row["at"]] = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little")
    packed = pa.array([cells.ravel()[:n_cells].tobytes()], pa.binary())
    return KeyFilter(cut(keys.sparkSession.createDataFrame(pa.table({"cells": packed}))), n_cells)


def may_have_key(found: KeyFilter | None, keys: Sequence[str | Column]) -> Column:
    """False only for rows whose key is not in the filter; true without a filter."""
    if found is None:
        return F.lit(True)
    table, yes = found.cells.scalar(), F.lit(b"\x01")
    tests = [F.substring(table, cell + 1, F.lit(1)) == yes for cell in _cells(keys, found.n_cells)]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out
