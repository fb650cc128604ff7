"""Line dedup over a corpus: of lines within one edit of each other the earliest stays.

Equal lines first become one distinct line with its earliest place. Distinct
lines then emit, as hashed keys, themselves and their variants with one
character deleted. Lines that share a variant and the place of the deletion
differ by a substitution there; a line equal to a variant differs from those
that emit it by an insertion. So the earliest line of a key is a partner for all
others, found by a minimum instead of by pairs, and `levenshtein` verifies it.

Two tests that lose no pair keep variants few. Lines within one edit share their
first or their last part; only lines that share one with another line go on.
Cut into short blocks, such lines agree in all but one block, before it from the
front and behind it from the back; only the blocks in which a line agrees so with
another emit the variants of deletions in them.

A line goes if an earlier line of the corpus is within the bound, whether or
not that one stays. Earlier means a smaller doc_id, then a smaller position;
rows without a doc_id come last. Rows that share a doc_id share their verdicts
on equal lines. Lines shorter than ``min_chars`` (without outer white space)
always stay: headings and blank lines shape a text. Null text stays null, empty
text empty, and an empty table gives an empty one. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tripflow.llm.common import cut, discard, without
from tripflow.operators.skew import join_on_hot_keys

MIN_CHARS = 10
BLOCK = 32
# Hashes of lines to look at again are marked in so many bits, whatever the
# corpus. Bits that lines share let more lines through, never fewer.
MARK_BITS = 22
_LINE = ["h1", "h2", "size"]
_PLACES = 31  # bits of a line number
_LAST = 2**64  # in place of a missing doc_id
_WHITE = " \t\r\x0b\x0c"
# Spark's xxhash64 starts from 42 and hands the hash of one value on as the seed of the next.
_SEED = 42
_SALT = "~"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _place(key: Column, position: Column) -> Column:
    """One orderable number for a line's place; a decimal so that its minimum aggregates by hash."""
    document = F.coalesce(key.cast("decimal(20,0)"), F.lit(Decimal(_LAST)).cast("decimal(20,0)"))
    return (document * F.lit(2**_PLACES).cast("decimal(11,0)") + position).cast("decimal(32,0)")


def _ends(line: Column, size: Column) -> list[Column]:
    """Keys that lines within one edit share: a first or a last part.

    Sizes fall into classes from a power of two to the next. With k below half
    of a class's least size, one edit cannot touch both the first and the last k
    characters. A line of that least size may pair with one of the class below.
    """
    binary = F.length(F.bin(size))
    found = []
    for below in (0, 1):
        least = F.pow(F.lit(2), binary - 1 - below).cast("int")
        k = F.floor((least - 1) / 2).cast("int")
        emits = F.lit(True) if not below else size == F.pow(F.lit(2), binary - 1).cast("int")
        found.append(F.when(emits, F.xxhash64(F.lit(0), least, F.substring(line, F.lit(1), k))))
        found.append(F.when(emits, F.xxhash64(F.lit(1), least, F.right(line, k))))
    return found


def _marked(buckets: DataFrame) -> np.ndarray:
    """A bit per bucket of h1; at most 2**MARK_BITS buckets reach the driver."""
    found = buckets.select(F.pmod("h1", F.lit(2**MARK_BITS)).cast("int").alias("bucket")).distinct().toPandas()
    bits = np.zeros(2**MARK_BITS, dtype=bool)
    bits[found["bucket"].to_numpy(dtype=np.int64)] = True
    return np.packbits(bits)


def _signed(digest: int) -> int:
    return digest - 2**64 if digest >= 2**63 else digest


def _looked_up(docs: DataFrame, key: str, text: str, min_chars: int, repeated: np.ndarray, likely: np.ndarray) -> DataFrame:
    """(key, position, h1, h2, size, line) of all lines with a marked hash; the line only where marked likely."""
    marks = docs.sparkSession.sparkContext.broadcast((repeated, likely))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, near = (np.unpackbits(m).astype(bool) for m in marks.value)
        salted = xxhash.xxh64_intdigest(_SALT, _SEED)
        for batch in batches:
            rows: list[tuple] = []
            for at in range(batch.num_rows):
                for position, line in enumerate((batch.column(1)[at].as_py() or "").split("\n")):
                    if len(line) < min_chars or len(line.strip(_WHITE)) < min_chars:
                        continue
                    data = line.encode()
                    h1 = xxhash.xxh64_intdigest(data, _SEED)
                    bucket = h1 % 2**MARK_BITS
                    if again[bucket] or near[bucket]:
                        h2 = xxhash.xxh64_intdigest(data, salted)
                        rows.append((at, position, _signed(h1), _signed(h2), len(line), line if near[bucket] else None))
            ats, *columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ats, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                names=["key", "position", *_LINE, "line"],
            )

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = source.select("key").schema
    for name, kind in (("position", "integer"), ("h1", "long"), ("h2", "long"), ("size", "integer"), ("line", "string")):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


class _Sums:
    """Hashes of any beginning or end of a line, or of the line less a character, by prefix sums modulo 2**64."""

    def __init__(self, line: str):
        codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64)
        self.size = n = len(codes)
        mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        powers = np.multiply.accumulate(np.full(n + 1, _ODD, dtype=np.uint64))
        zero = np.zeros(1, dtype=np.uint64)
        self.first = np.concatenate([zero, np.cumsum(mixed * powers[:n])])
        self.last = np.concatenate([zero, np.cumsum(mixed[::-1] * powers[:n])])
        self.moved = np.concatenate([zero, np.cumsum(mixed[1:] * powers[: n - 1])])

    def less(self, at: np.ndarray) -> np.ndarray:
        """The line without the character at each place."""
        return self.first[at] + (self.moved[self.size - 1] - self.moved[at])


def _slices(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of the batch in slices of about ``most`` bytes of a text column, a row at least."""
    upto = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _blocks(lines: DataFrame) -> DataFrame:
    """(block, h1, begin, end): a key for each block of a line, made of all but the block.

    For a partner of the same size blocks lie at 0, BLOCK, 2 * BLOCK ...; for one that is
    shorter by a character the block is longer by one. ``end`` is exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                found: list[list[np.ndarray]] = [[], [], [], []]
                for h1, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    sums = _Sums(line)
                    for extra in (0, 1):
                        shorter = sums.size - extra
                        begin = np.arange(0, max(shorter, 1), BLOCK)
                        end = np.minimum(begin + BLOCK, shorter)
                        mixed = (np.full(len(begin), shorter, dtype=np.uint64) * _ODD + begin.astype(np.uint64)) * _ODD ^ sums.first[begin]
                        mixed = (mixed ^ mixed >> np.uint64(32)) * _ODD + sums.last[shorter - end]
                        for values, own in zip(found, (mixed.view(np.int64), np.full(len(begin), h1), begin, end + extra), strict=True):
                            values.append(own)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v), pa.int64()).cast(k) for v, k in zip(found, kinds, strict=True)],
                    names=["block", "h1", "begin", "end"],
                )

    return lines.select("h1", "line").mapInArrow(run, "block long, h1 long, begin int, end int")


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``keys`` whose key another h1 has too, without the key."""
    several = keys.groupBy(name).agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b")
    # The key hashed anew, so that a hot key's rows come straight from a shuffle and can be split.
    tag = F.xxhash64(name).alias("tag")
    rest = [c for c in keys.columns if c != name]
    return keys.select(tag, *rest).join(several.select(tag), "tag").select(*rest)


def _variants(lines: DataFrame, spots: DataFrame) -> DataFrame:
    """(variant, left, deleted, h1, h2, size, place): lines and their variants by hash.

    ``deleted`` is -1 for the line itself; ``left`` is the size of what is hashed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 3):
                found: list[list[np.ndarray]] = [[], [], []]
                for line, spots in zip(part.column(3).to_pylist(), part.column(5).to_pylist(), strict=True):
                    sums = _Sums(line)
                    marks = np.zeros(sums.size, dtype=bool)
                    for spot in spots:
                        marks[spot["begin"] : spot["end"]] = True
                    at = np.flatnonzero(marks)
                    left = np.full(len(at) + 1, sums.size - 1)
                    left[0] += 1
                    for values, own in zip(found, (np.concatenate([sums.first[-1:], sums.less(at)]).view(np.int64), left, np.append(-1, at)), strict=True):
                        values.append(own)
                rows = pa.array(np.repeat(np.arange(part.num_rows), list(map(len, found[0]))))
                variants = [pa.array(np.concatenate(v), pa.int64()) for v in found]
                yield pa.RecordBatch.from_arrays(
                    [variants[0], variants[1].cast(pa.int32()), variants[2].cast(pa.int32()), *[part.column(c).take(rows) for c in (0, 1, 2, 4)]],
                    names=["variant", "left", "deleted", *_LINE, "place"],
                )

    schema = "variant long, left int, deleted int, h1 long, h2 long, size int, place decimal(32,0)"
    per_line = spots.groupBy("h1").agg(F.collect_set(F.struct("begin", "end")).alias("spots"))
    return join_on_hot_keys(lines, per_line, ["h1"]).select(*_LINE, "line", "place", "spots").mapInArrow(run, schema)


def near_earlier(lines: DataFrame) -> DataFrame:
    """(h1, h2, size) of distinct lines that have an earlier line within one edit.

    ``lines``: (h1, h2, size, line, place), one row per distinct line.
    """
    blocks = cut(_blocks(lines))
    emitted = cut(_variants(lines, _shared(blocks, "block")))
    discard(blocks)
    deletions, selves = emitted.filter("deleted >= 0"), emitted.filter("deleted < 0").drop("deleted")
    key = ["variant", "left"]
    # A substitution: the same variant by a deletion at the same place.
    first_at = deletions.groupBy(*key, "deleted").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    substituted = join_on_hot_keys(deletions, first_at.filter("first < last").drop("last"), [*key, "deleted"])
    # An insertion: a line that equals the variant of a longer one.
    first_of = deletions.groupBy(*key).agg(F.min("place").alias("first"))
    shorter = join_on_hot_keys(selves, first_of, key)
    longer = join_on_hot_keys(deletions, selves.select(*key, F.col("place").alias("first")), key)
    meets = [x.filter("first < place").select(*_LINE, "first") for x in (substituted, shorter, longer)]
    likely = meets[0].unionByName(meets[1]).unionByName(meets[2]).distinct()
    texts = lines.select(*_LINE, "line")
    earlier = lines.select(F.col("place").alias("first"), F.col("line").alias("before"))
    return (
        join_on_hot_keys(likely, earlier, ["first"])
        .join(texts, _LINE)
        .filter(F.levenshtein("line", "before", 1) >= 0)
        .select(*_LINE)
        .distinct()
    )


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, dropped): the line numbers of each document that are to go, for documents with any."""
    met = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("position", "line")).filter(
        F.length(F.btrim("line", F.lit(_WHITE))) >= min_chars
    )
    line, size = F.col("line"), F.length("line")
    # Equal lines have equal ends, so any of a group serves.
    ends = [f"end{i}" for i in range(4)]
    distinct = cut(
        met.select(
            F.xxhash64(line).alias("h1"),
            F.xxhash64(F.lit(_SALT), line).alias("h2"),
            size.alias("size"),
            _place(F.col("key"), F.col("position")).alias("place"),
            *[c.alias(n) for n, c in zip(ends, _ends(line, size), strict=True)],
        )
        .groupBy(*_LINE)
        .agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ends])
    )
    keys = distinct.select("h1", F.explode(F.array_distinct(F.array_compact(F.array(*ends)))).alias("end"))
    likely = cut(_shared(keys, "end").distinct())
    repeats = distinct.filter("n > 1")
    hits = cut(_looked_up(docs, key, text, min_chars, _marked(repeats.select("h1")), _marked(likely)))
    place = _place(F.col("key"), F.col("position"))
    first = distinct.join(likely, "h1").select(*_LINE, "place")
    lines = cut(
        hits.filter("line IS NOT NULL").select(*_LINE, place.alias("place"), "line")
        .join(first, [*_LINE, "place"]).dropDuplicates([*_LINE, "place"])
    )
    near = near_earlier(lines).withColumn("near", F.lit(True))
    verdict = distinct.select(*_LINE, "n", F.col("place").alias("first")).join(near, _LINE, "left").filter("n > 1 OR near")
    gone = join_on_hot_keys(hits.drop("line"), verdict.drop("n"), _LINE).filter(F.col("near").isNotNull() | (place > F.col("first")))
    return gone.groupBy("key").agg(F.collect_set("position").alias("dropped")).withColumnRenamed("key", key)


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped``."""
    added = ["n_lines", "n_dropped"]
    rows = without(docs, [*added, "__key", "__dropped"])
    gone = repeated_lines(docs, key, text, min_chars).select(F.col(key).alias("__key"), F.col("dropped").alias("__dropped"))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    # In an array of its own the text is split once, not once for each line kept.
    joined = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(kept, lambda i: F.get(own, i)), "\n")), 0)
    columns = [F.when(F.col("__dropped").isNull(), F.col(text)).otherwise(joined).alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns]
    return rows.join(gone, rows[key].eqNullSafe(gone["__key"]), "left").select(
        *columns,
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
