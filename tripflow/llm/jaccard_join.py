"""Near-duplicate texts by the Jaccard similarity of their word shingles, exactly.

A text is the set of its distinct shingles, as 64-bit hashes. Equal sets become
one class. A class indexes only the rarest shingles of its set: two sets as
similar as asked must share one of those. Shingles are ordered by a count over
all texts, kept in a table of fixed size; any order gives the same links, and a
rare-first one gives few candidates. Candidates pass filters on length, on the
place of the shared shingle and on a parity sketch of the rest of the sets, and are
verified once per pair on the whole sets.

A shingle that many classes share is not turned into all its pairs. Its classes
are first compared with the one among them that has the fewest rarer shingles;
those that are similar to it are linked through it. Only classes that links do not
join yet can still need a comparison of their own, if they pass the filters; the
sketch is one of the conditions under which they are joined. No pair is compared twice.

Null and empty texts, and texts without words, have an empty set and are linked
with nothing. Texts shorter than a shingle are one shingle of all their words.
Repeated rows are members of one class. Missing ids do not name a component; one
of only such rows has none. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from tripflow.llm.common import cut, text_or_empty
from tripflow.llm.graph import components
from tripflow.operators.skew import join_on_hot_keys

# The table of shingle counts: 2**19 buckets, whatever the corpus.
BUCKET_BITS = 19
# A sketch has a bit or more per shingle, a power of two, and so many at least.
SKETCH_BITS = 1024
# Keys of texts to read again are marked in so many bits, whatever the corpus.
# Bits that keys share let more texts through, never fewer.
MARK_BITS = 22
# Word hashes a worker keeps at hand; bounds memory only.
_CACHED = 500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct shingles of a text as 64-bit hashes."""
        words = text.encode().translate(_LOWER).split()
        if len(self.known) > _CACHED:
            self.known = {}
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(words):
            return hashes
        width = min(self.width, len(words))
        mixed = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            mixed = (mixed ^ hashes[i : len(hashes) - width + 1 + i]) * _ODD
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Small slices of the batches, with the texts of the last column."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield part, part.column(part.num_columns - 1).to_pylist()


def bucket_counts(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many sets over all texts hold a shingle of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(width), np.zeros(2**BUCKET_BITS, dtype=np.int64)
        for _, texts in _texts(batches):
            found = np.concatenate([shingler(t) for t in texts])
            counts += np.bincount(_bucket(found), minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["bucket", "n"])

    counted = docs.select(text_or_empty(text).alias("text")).mapInArrow(run, "bucket int, n long")
    frame = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**19 rows at most
    counts = np.zeros(2**BUCKET_BITS, dtype=np.int64)
    counts[frame["bucket"].to_numpy()] = frame["n"].to_numpy()
    return counts


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def signatures(docs: DataFrame, counts: np.ndarray, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(key, n, own, cls, prefix, sketch): set size, shingles no other text has, set digest, rarest shingles, parity sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(width), shared.value
        for part, texts in _texts(batches):
            sizes, own, classes, prefixes, sketches = [], [], [], [], []
            for shingles in map(shingler, texts):
                n = len(shingles)
                sizes.append(n)
                # A bucket that one text alone fills holds a shingle that no other text has.
                held = counts[_bucket(shingles)]
                own.append(int(np.count_nonzero(held == 1)))
                classes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                # Shingles come sorted, so a stable sort by count settles ties by hash.
                order = np.argsort(held, kind="stable")
                prefixes.append(shingles[order[: n - _least_overlap(n, percent) + 1 if n else 0]].view(np.int64))
                size = max(SKETCH_BITS, 1 << (n - 1).bit_length()) if n else SKETCH_BITS
                bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
                sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(own, pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["key", "n", "own", "cls", "prefix", "sketch"],
            )

    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    longs = ArrayType(LongType())
    schema = source.select("key").schema.add("n", "long").add("own", "long").add("cls", "binary")
    return source.mapInArrow(run, schema.add("prefix", longs).add("sketch", longs))


def _fits(n: Column, m: Column, percent: int) -> Column:
    """The length filter."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _wanted(n: Column, m: Column, percent: int) -> Column:
    """The least overlap that sets of n and m shingles need."""
    return F.ceil(percent * (n + m) / (100 + percent))


def _placed(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """The positional filter: shingles before and after a shared one bound the overlap."""
    most = F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1)
    return most >= _wanted(n, m, percent)


def _sets(needed: DataFrame, docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(node, shingles): the whole sets of the needed (node, cls, key), made anew from one text each.

    Their keys are marked in a bitmap of fixed size, so that texts without a
    mark are read but neither cut into shingles nor shuffled.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(2**MARK_BITS)).cast("int")
    found = needed.select(bucket("key").alias("bucket")).distinct().toArrow()  # 2**MARK_BITS rows at most
    bits = np.zeros(2**MARK_BITS, dtype=bool)
    bits[found["bucket"].to_numpy()] = True
    marks = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, marked = Shingler(width), np.unpackbits(marks.value).astype(bool)
        for part, texts in _texts(batches):
            hits = marked[part.column(0).to_numpy()]
            sets = [shingler(t).tobytes() for t, hit in zip(texts, hits, strict=True) if hit]
            classes = [xxhash.xxh3_128_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    source = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text")).select(bucket("key"), "text")
    made = source.mapInArrow(run, "cls binary, shingles binary")
    # Copies make the same set many times; one of each class stays.
    return cut(join_on_hot_keys(made, needed.select("node", "cls"), ["cls"]).groupBy("node").agg(F.first("shingles").alias("shingles")))


def _sketched(n: Column, s: Column, m: Column, t: Column, percent: int) -> Column:
    """The suffix filter: two sets differ by at least as many shingles as their parity sketches by bits.

    Sketches of sets that pass the length filter differ in size by a factor of
    two at most; the larger one is folded.
    """
    size = F.least(F.size(s), F.size(t))

    def folded(sketch: Column) -> Column:
        halves = F.zip_with(F.slice(sketch, F.lit(1), size), F.slice(sketch, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sketch) > size, halves).otherwise(sketch)

    bits = F.zip_with(folded(s), folded(t), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, x: total + x)
    return apart <= _apart(n, m, percent)


def _apart(n: Column, m: Column, percent: int) -> Column:
    """The most shingles in which sets of n and m may differ."""
    return n + m - 2 * _wanted(n, m, percent)


def _passes(percent: int) -> Column:
    """The filters on (n, at, own) of both sides: length, position, and shingles no other text has.

    The latter stand in one set of a pair alone, so they add up to a difference.
    """
    n, i, m, j = (F.col(c) for c in ("n_a", "at_a", "n_b", "at_b"))
    own = F.col("own_a") + F.col("own_b") <= _apart(n, m, percent)
    return _fits(n, m, percent) & own & _placed(n, i, m, j, percent)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not tell apart."""
    for side in "ab":
        brief = classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
        pairs = join_on_hot_keys(pairs, brief, [side])
    return pairs.filter(_sketched(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b"), percent)).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(nodes.join(classes.select("node", "cls", "key"), "node"), docs, key, text, width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                one, other = [np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3)]
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = join_on_hot_keys(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), ["a"])
    full = join_on_hot_keys(left, sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), ["b"])
    return cut(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def _entries(classes: DataFrame, percent: int) -> DataFrame:
    """(shingle, node, at, n, own): the index, less the shingles that one class alone has in its prefix.

    A class whose own shingles leave too few for any partner is not in it.
    """
    able = classes.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    sizes = [F.col(c).cast("int").alias(c) for c in ("n", "own")]
    index = able.select(F.posexplode("prefix").alias("at", "shingle"), "node", *sizes)
    shared = index.groupBy("shingle").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    # A shingle hashed anew is as good a name, and its rows come straight from a shuffle.
    again = F.xxhash64("shingle").alias("shingle")
    return cut(index.select(again, "node", "at", "n", "own").join(shared.select(again), "shingle"))


def _side(entries: DataFrame, side: str, *more: str) -> DataFrame:
    return entries.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "at", "own", *more)])


def _links(classes: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """(node, root): components of the classes that have links."""
    verify = lambda pairs: _verified(pairs, classes, docs, key, text, width, percent)
    entries = _entries(classes, percent)
    ordered = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]
    stars = entries.groupBy("shingle").agg(F.min_by(F.struct("node", "n", "at", "own"), "at").alias("star"))
    stars = stars.select("shingle", *[F.col(f"star.{c}").alias(f"{c}_a") for c in ("node", "n", "at", "own")])
    met = join_on_hot_keys(_side(entries, "b"), stars, ["shingle"]).filter("node_a <> node_b").filter(_passes(percent))
    compared = cut(met.select(*ordered).distinct())
    by_star = verify(cut(_likely(compared, classes, percent)))
    # Sketches go along with what is still open, so that the join itself tells most pairs apart.
    open_ = _open_entries(entries, components(by_star))
    open_ = cut(join_on_hot_keys(open_, classes.select("node", "sketch"), ["node"]))
    one, two = _side(open_, "a", "root", "sketch"), _side(open_, "b", "root", "sketch")
    likely = _sketched(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"), percent)
    meets = (one["shingle"] == two["shingle"]) & (F.col("root_a") < F.col("root_b")) & _passes(percent) & likely
    pairs = one.join(two, meets).select(*ordered).distinct()
    # Pairs that were compared with a star have their answer.
    rest = verify(cut(pairs.join(compared, ["a", "b"], "left_anti")))
    return components(by_star.union(rest))


def _open_entries(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Index entries with their class's root, where a shingle still meets several roots."""
    known = join_on_hot_keys(entries, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))
    several = known.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("shingle")
    return join_on_hot_keys(known, several, ["shingle"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(key, n_shingles, component_id) of every document."""
    counts = bucket_counts(docs, text, width)
    rows = cut(signatures(docs, counts, key, text, width, percent))
    firsts = [F.first(c).alias(c) for c in ("n", "own", "prefix", "sketch")]
    classes = cut(
        rows.filter("n > 0").groupBy("cls").agg(F.min("key").alias("key"), *firsts)
        .withColumn("node", F.monotonically_increasing_id())
    )
    roots = _links(classes, docs, key, text, width, percent)
    placed = classes.select("cls", "node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("key").alias("component_id"))
    named = join_on_hot_keys(placed.select("cls", "root"), names, ["root"]).select("cls", "component_id")
    alone = rows.filter("n = 0").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    linked = join_on_hot_keys(rows.filter("n > 0").select("key", "n", "cls"), named, ["cls"])
    return linked.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id").union(alone)
