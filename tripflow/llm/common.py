"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripflow.sources.shared import cut, discard, shared_folder, written  # noqa: F401

# Fixed by the contracts: the ASCII white space that ends a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns an operator is about to add, whatever their case."""
    taken = {name.lower() for name in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose last column has about ``most`` bytes, a row at least.

    So what a worker holds at once follows from the longest value, not from the rows of a batch.
    """
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        if pa.types.is_list(column.type):
            size = pc.multiply(pc.list_value_length(column), 4)
        else:
            size = pc.binary_length(column)
        upto = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
