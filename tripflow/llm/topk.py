"""Exact top-k search by distributed selection on score histograms.

Every query is scored against every candidate, block by block. The first pass
counts scores in wide bins per query; the bin that holds the k-th score is then
counted in finer bins, until a bin is one score wide. A last pass keeps what
scores above the k-th score, and as many of its ties as are wanted, by smaller
id. Nothing is sorted but those few rows, and scores are never stored.

Queries and candidates are met in blocks. The blocks of queries are dealt over
parts of a bounded size; a task holds one part and reads candidates past it from
their files. Neither side is broadcast, copied or has to fit one machine.

Vectors that are null, or hold a null or non-finite component, take no part,
nor do rows without an id. A row that repeats a candidate counts again. Rows that repeat a
query's id and vector ask once. Only vectors of equal length are compared. Scores
are exact integers, held between -2**61 and 2**61. Fewer than k candidates:
all are returned. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripflow.llm.common import cut, discard
from tripflow.operators.topn import top_per_group

BINS = 1024
CANDIDATES_IN_BLOCK = 4096
QUERIES_IN_BLOCK = 1024
# A task holds a part of the queries: about so many bytes, but no fewer parts than this if there are blocks enough.
PART_BYTES = 2**24
QUERY_PARTS = 8
# Scores beyond this are held at it, so that differences of scores stay longs.
_MOST = 2**61
_QUERY = ("query_id", "tag", "dim")


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component as long; null where the vector takes no part."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _bytes(vectors: list[np.ndarray]) -> bytes:
    """Vectors of whole numbers, each in the fewest of 2, 4 or 8 bytes that hold all of them."""
    numbers = np.array(vectors, "<i8")
    low, high = numbers.min(initial=0), numbers.max(initial=0)
    kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return numbers.astype(kind).tobytes()


def _numbers(packed: pa.Scalar, rows: int, width: int) -> np.ndarray:
    """The vectors that `_bytes` has packed."""
    held = packed.as_buffer()
    return np.frombuffer(held, f"<i{held.size // (rows * width) if width else 8}").reshape(rows, width)


def _packed(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (id, v) as blocks of one vector length: (block, dim, ids, vectors), of at most ``limit`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([_bytes(vectors)], pa.binary())],
                names=["dim", "ids", "vectors"],
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, vectors = held.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v.values.to_numpy())
                if len(ids) == limit:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.select("id", "v").mapInArrow(run, "dim int, ids binary, vectors binary")


def _query_blocks(state: DataFrame) -> DataFrame:
    """Queries as blocks with the bin each looks into: lower end and scores still wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            rows = held.pop(dim)
            q, tags, vectors, low, need = zip(*rows, strict=True)
            packed = [np.array(q, "<i8").tobytes(), np.array(tags, "<i8").tobytes(), _bytes(vectors),
                      np.array(low, "<i8").tobytes(), np.array(need, "<i8").tobytes()]
            columns = [pa.array([x], pa.binary()) for x in packed]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *columns], names=["dim", "q", "tags", "qv", "low", "need"])

        for batch in batches:
            lists = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for q, tag, low, need, v in zip(*lists, batch.column(2), strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((q, tag, v.values.to_numpy(), low, need))
                if len(rows) == QUERIES_IN_BLOCK:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    rows = state.select("query_id", "tag", "v", "low", "need")
    return rows.mapInArrow(run, "dim int, q binary, tags binary, qv binary, low binary, need binary")


def _scores(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as exact int64, in floats while those are exact and in Python integers beyond."""
    dim = q.shape[1]
    most = float(np.abs(q.astype(float)).max()) * float(np.abs(vectors.astype(float)).max()) * dim if dim else 0
    if most >= 2**53:
        exact = q.astype(object) @ vectors.astype(object).T
        return np.clip(exact, -_MOST, _MOST).astype(np.int64)
    kind = np.float32 if most < 2**24 else np.float64
    return (q.astype(kind) @ vectors.astype(kind).T).astype(np.int64)


def _meetings(blocks: DataFrame, state: DataFrame, parts: int) -> DataFrame:
    """Every block of candidates with every block of queries of its length.

    Spark takes blocks for the size of the files they are made from, several times
    too low, and would broadcast them; the hint has tasks read both sides instead.
    """
    asked = _query_blocks(state).repartition(parts).hint("shuffle_replicate_nl")
    return blocks.join(asked, "dim").select("dim", "ids", "vectors", "q", "tags", "qv", "low", "need")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            dim, *packed = [batch.column(c)[i] for c in range(batch.num_columns)]
            ids, q, tags, low, need = [np.frombuffer(packed[c].as_buffer(), "<i8") for c in (0, 2, 3, 5, 6)]
            width = dim.as_py()
            scores = _scores(_numbers(packed[4], len(q), width), _numbers(packed[1], len(ids), width))
            yield width, ids, q, tags, low, need, scores, ids[None, :] != q[:, None]


def _histograms(meetings: DataFrame, width: int, span: int) -> DataFrame:
    """(query, bin, n) over scores in [low, low + span).

    A block hands on its bins from the top down to the one by which it holds all
    scores still wanted; the wanted score cannot lie below that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, _, q, tags, low, need, scores, other in _each(batches):
            inside = other & (scores >= low[:, None]) & (scores - low[:, None] < span)
            at = np.flatnonzero(inside)
            row = at // scores.shape[1]
            bins = (scores.ravel()[at] - low[row]) // width
            counts = np.bincount(row * BINS + bins, minlength=len(q) * BINS).reshape(-1, BINS)
            above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            r, b = np.nonzero((counts > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[r]), pa.array(tags[r]), pa.array(np.full(len(r), dim, np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[r, b])],
                names=[*_QUERY, "bin", "n"],
            )

    found = meetings.mapInArrow(run, "query_id long, tag long, dim int, bin int, n long")
    return found.groupBy(*_QUERY, "bin").agg(F.sum("n").alias("n"))


def _selected(meetings: DataFrame) -> DataFrame:
    """Per block, what scores above the k-th score and the first of its ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, q, tags, low, need, scores, other in _each(batches):
            r, c = np.nonzero(other & (scores > low[:, None]))
            tied_r, tied_c = np.nonzero(other & (scores == low[:, None]))
            order = np.lexsort((ids[tied_c], tied_r))
            tied_r, tied_c = tied_r[order], tied_c[order]
            place = np.arange(len(tied_r)) - np.searchsorted(tied_r, tied_r)
            first = place < need[tied_r]
            r, c = np.concatenate([r, tied_r[first]]), np.concatenate([c, tied_c[first]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[r]), pa.array(tags[r]), pa.array(ids[c]), pa.array(scores[r, c])],
                names=["query_id", "tag", "vec_id", "score"],
            )

    return meetings.mapInArrow(run, "query_id long, tag long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int, factor: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each query."""

    def taking_part(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), factor).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")

    blocks = cut(_packed(taking_part(candidates), CANDIDATES_IN_BLOCK))
    asked = taking_part(queries).select(
        F.col("id").alias("query_id"), F.xxhash64("v").alias("tag"), F.size("v").alias("dim"), "v"
    ).dropDuplicates(["query_id", "tag"])
    # |score| is at most the product of the longest vectors' lengths.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    reach, n_queries, n_numbers = asked.agg(F.max(norm), F.count(F.lit(1)), F.sum(F.col("dim").cast("long") + 4)).first()
    other = taking_part(candidates).agg(F.max(norm)).first()[0]
    bound = int(min((reach or 0.0) * (other or 0.0) * 1.0001 + 1, _MOST))
    state = cut(asked.withColumn("low", F.lit(-bound).cast("long")).withColumn("need", F.lit(k).cast("long")))
    parts = max(1, min(-(-n_queries // QUERIES_IN_BLOCK), max(QUERY_PARTS, -(-8 * (n_numbers or 0) // PART_BYTES))))
    span = 2 * bound + 1
    while span > 1:
        width = -(-span // BINS)
        counted = _histograms(_meetings(blocks, state, parts), width, span)
        before, state = state, cut(_narrowed(state, counted, width))
        discard(before)
        span = width
    winners = _selected(_meetings(blocks, state, parts))
    ranked = top_per_group(winners, ["query_id", "tag"], [F.desc("score"), F.asc("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _narrowed(state: DataFrame, counted: DataFrame, width: int) -> DataFrame:
    """Move each query to the bin that holds its k-th score; with too few scores it stays.

    The files of the queries are smaller than their rows, so no side is broadcast.
    """
    bins = F.sort_array(F.collect_list(F.struct((-F.col("bin")).alias("down"), "n")))
    start = F.struct(F.lit(0).cast("long").alias("above"), F.lit(-1).cast("int").alias("bin"))
    found = counted.groupBy(*_QUERY).agg(bins.alias("bins")).join(state.select("query_id", "tag", "need").hint("merge"), ["query_id", "tag"])
    place = F.aggregate("bins", start, lambda done, b: F.when(done["bin"] >= 0, done)
                        .when(done["above"] + b["n"] >= F.col("need"), F.struct(done["above"].alias("above"), (-b["down"]).cast("int").alias("bin")))
                        .otherwise(F.struct((done["above"] + b["n"]).alias("above"), done["bin"].alias("bin"))))
    chosen = found.select("query_id", "tag", place.alias("at")).filter("at.bin >= 0")
    return state.join(chosen.hint("merge"), ["query_id", "tag"], "left").select(
        "query_id", "tag", "dim", "v",
        F.when(F.col("at").isNull(), F.col("low")).otherwise(F.col("low") + F.col("at.bin") * width).alias("low"),
        F.when(F.col("at").isNull(), F.col("need")).otherwise(F.col("need") - F.col("at.above")).alias("need"),
    )
