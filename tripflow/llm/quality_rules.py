"""Quality rules: shape counts of a text and the perplexity its language gives it.

A modified Kneser-Ney model per language is counted by Spark over all texts:
grams of ``ORDER`` characters that run across words. Texts fall into two folds
by hash, so that copies share one; a text is judged by the model of the other
fold and does not vouch for itself. Each language then has a lower and an upper
band of perplexity, a median over windows, which quoted passages move little;
documents outside of it are rejected.

Probabilities are looked up by the full 64-bit hash of (fold, language, gram):
the most frequent grams in a sorted array of bounded size that is broadcast, with
an index over its hash ranges, all others by a join.

Null text: no words, all counts 0. Null language: a language of its own.
Documents without words have no perplexity, nor have those whose language has
no text in the other fold; the base rules alone judge them. Widths of the bands of
languages with few documents are drawn toward those of all languages.
Equal rows get equal results, an empty table an empty one; of the columns only
the named ones are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from tripflow.llm.common import byte_slices, cut, discard, text_or_empty

ORDER = 5
# Entries of the broadcast array of frequent grams, 16 bytes each, and the bits of its index.
NEAR, INDEX_BITS = 2**20, 20
SLOT_BITS = 20
# Log-probabilities are summed as whole numbers, so no order of adding shows.
UNIT = 1_000_000_000
# Characters of a window, and those a worker gathers before it counts.
WINDOW = 200
RUNNING = 8_000_000
# Documents that the widths of all languages count for in the band of each.
PRIOR_DOCS = 50
# A band reaches so many quartile distances below and above the median, and
# further for short texts, whose median over few windows scatters more. Chosen on
# one half of the labelled documents; the README gives the shares of the other.
REACH_BELOW = 5.0
REACH_ABOVE = 4.0
SHORT_WORDS = 40
# Width of a histogram bin, and the least quartile distance.
BIN, LEAST = 0.001, 0.005

_WHITE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_FAR = pa.list_(pa.struct([("part", pa.int32()), ("hash", pa.int64()), ("n", pa.int32())]))


def _fold_name(text: Column, lang: str) -> Column:
    """The fold of a text, 0 or 1, before the name of its language; equal texts share a fold."""
    fold = F.pmod(F.xxhash64(text), F.lit(2)).cast("string")
    return F.concat(fold, F.coalesce(F.col(lang).cast("string"), F.lit(""))).alias("name")


def _other(name: str = "name") -> Column:
    """The same language in the other fold."""
    return F.concat(F.translate(F.substring(name, 1, 1), "01", "10"), F.expr(f"substring({name}, 2)"))


def _running(words: list[bytes]) -> str:
    """The words in their order with single gaps, padded before and closed by a gap."""
    return " " * (ORDER - 1) + b" ".join(words).decode() + " " if words else ""


def _distinct(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of one of each hash, and how often it stands there.

    Each round settles the hashes that own a slot; the others go on to the next.
    """
    left, mixed = np.arange(len(hashes)), hashes
    while len(left):
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        owner = np.zeros(2**SLOT_BITS, dtype=np.int64)
        owner[slot] = left
        mine = hashes[owner[slot]] == hashes[left]
        n = np.bincount(slot[mine], minlength=2**SLOT_BITS)
        used = np.flatnonzero(n)
        yield owner[used], n[used]
        left = left[~mine]
        mixed = mixed[~mine] * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(31)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(name, gram, n): how often each gram of ``ORDER`` characters stands in the texts of a fold and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        sizes: Counter = Counter()

        def out(name: str) -> Iterator[pa.RecordBatch]:
            runs = held.pop(name)
            del sizes[name]
            joined = "".join(runs)
            # Grams that would end in the padding of a text are left out.
            inside = np.ones(len(joined), dtype=bool)
            starts = np.cumsum([0, *map(len, runs)])[:-1]
            for back in range(ORDER - 1):
                inside[starts + back] = False
            ends = np.flatnonzero(inside)
            for first, n in _distinct(_hashes(_codes(joined), ORDER, name)[ends]):
                grams = [joined[i - ORDER + 1 : i + 1] for i in ends[first].tolist()]
                for at in range(0, len(grams), 50_000):
                    some = grams[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some), pa.string()), pa.array(some, pa.string()), pa.array(n[at : at + 50_000], pa.int64())],
                        names=["name", "gram", "n"],
                    )

        for batch in byte_slices(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not (one := _running(body.encode().split())):
                    continue
                held.setdefault(name, []).append(one)
                sizes[name] += len(one)
                if sizes.total() > RUNNING:
                    yield from out(max(sizes, key=sizes.get))
        for name in list(held):
            yield from out(name)

    body = text_or_empty(text)
    counted = docs.select(_fold_name(body, lang), body.alias("text")).mapInArrow(run, "name string, gram string, n long")
    return counted.groupBy("name", "gram").agg(F.sum("n").alias("n"))


def _discounts(levels: list[DataFrame]) -> DataFrame:
    """(name, k, d1, d2, d3, uniform) from the counts of counts of each order."""
    met = None
    for k, grams in enumerate(levels, 1):
        times = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
        one = grams.groupBy("name").agg(*times, F.count(F.lit(1)).alias("types")).withColumn("k", F.lit(k))
        met = one if met is None else met.unionByName(one)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        # Where too few grams were seen i times the middle of the allowed range serves.
        value = F.lit(i) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.coalesce(F.when((value > 0) & (value < i), value), F.lit(i / 2)).alias(f"d{i}")

    return cut(met.select(F.col("name").alias("d_name"), "k", *[discount(i) for i in (1, 2, 3)], (1.0 / (F.col("types") + 1)).alias("uniform")))


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """(name, gram, p, b) per order from 1 on: an interpolated modified Kneser-Ney model.

    ``b`` is what the gram's context leaves to the next lower order. Lower orders
    count the distinct characters that stand before a gram. A context's grams are
    at most as many as there are characters, so its window is bounded.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        below = levels[0].groupBy("name", F.expr(f"right(gram, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, cut(below))
    discounts = _discounts(levels)
    found: list[DataFrame] = []
    for k, grams in enumerate(levels, 1):
        own = discounts.filter(F.col("k") == k).drop("k")
        rows = grams.join(own, F.col("name") == F.col("d_name")).withColumn("context", F.expr(f"left(gram, {k - 1})"))
        context = Window.partitionBy("name", "context")
        left = sum(
            F.col(f"d{i}") * F.sum(F.when((F.col("n") == i) if i < 3 else (F.col("n") > 2), 1).otherwise(0)).over(context) for i in (1, 2, 3)
        )
        total = F.sum("n").over(context)
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        shares = rows.select(
            "name", "gram", "uniform", (F.greatest(F.col("n") - less, F.lit(0.0)) / total).alias("a"), (left / total).alias("b")
        )
        if k == 1:
            with_below = shares.withColumn("below", F.col("uniform"))
        else:
            tails = found[-1].select(F.col("name").alias("t_name"), F.col("gram").alias("tail"), F.col("p").alias("below"))
            with_below = shares.join(tails, (F.col("name") == F.col("t_name")) & (F.expr(f"right(gram, {k - 1})") == F.col("tail")))
        found.append(cut(with_below.select("name", "gram", (F.col("a") + F.col("b") * F.col("below")).alias("p"), "b")))
    discard(*levels[:-1])
    return found


def cross_fitted(counts: DataFrame, model: list[DataFrame]) -> DataFrame:
    """(name, gram, n, log_p): every counted gram by the model of the other fold.

    A gram that the other fold does not have backs off: the weight its context
    leaves, if there is such a context, times the probability of its tail.
    """
    uniform = model[0].groupBy("name").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("uniform"))
    state = counts.select("name", "gram", "n", _other().alias("other"), F.col("gram").alias("rest"), F.lit(0.0).alias("log_b"))
    done = None
    for k in range(ORDER, 0, -1):
        grams = model[k - 1].select(F.col("name").alias("m_name"), F.col("gram").alias("m_gram"), "p")
        met = cut(state.join(grams, (F.col("other") == F.col("m_name")) & (F.col("rest") == F.col("m_gram")), "left").drop("m_name", "m_gram"))
        some = met.filter("p IS NOT NULL").select("name", "gram", "n", (F.col("log_b") + F.log("p")).alias("log_p"))
        done = some if done is None else done.unionByName(some)
        contexts = model[k - 1].groupBy(F.col("name").alias("c_name"), F.expr(f"left(gram, {k - 1})").alias("context")).agg(F.first("b").alias("b"))
        missing = met.filter("p IS NULL").withColumn("front", F.expr(f"left(rest, {k - 1})"))
        state = missing.join(contexts, (F.col("other") == F.col("c_name")) & (F.col("front") == F.col("context")), "left").select(
            "name", "gram", "n", "other", F.expr(f"right(rest, {k - 1})").alias("rest"), (F.col("log_b") + F.coalesce(F.log("b"), F.lit(0.0))).alias("log_b")
        )
    # Without any text in the other fold there is no model and no value.
    last = state.join(uniform.withColumnRenamed("name", "u_name"), F.col("other") == F.col("u_name"))
    return done.unionByName(last.select("name", "gram", "n", (F.col("log_b") + F.log("uniform")).alias("log_p")))


def _seed(lang: str, width: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{width} {lang}"))


def _hashes(codes: np.ndarray, width: int, lang: str) -> np.ndarray:
    """64-bit hashes of the ``width`` codes that end at each position."""
    mixed = np.full(len(codes), _seed(lang, width), dtype=np.uint64)
    for back in range(width - 1, -1, -1):
        mixed[back:] ^= codes[: len(codes) - back]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def hashed(model: DataFrame) -> DataFrame:
    """(hash, n, value): 64-bit hashes of (name, gram), and log_p in units of 1 / ``UNIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, grams = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            sizes, hashes = np.array(list(map(len, grams)), dtype=int), np.zeros(len(grams), dtype=np.uint64)
            for name, width in {(n, int(w)) for n, w in zip(names, sizes, strict=True)}:
                own = np.flatnonzero((names == name) & (sizes == width))
                hashes[own] = _hashes(_codes("".join(grams[i] for i in own)), width, name)[width - 1 :: width]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *batch.columns[2:]], names=["hash", "n", "value"])

    value = F.round(F.col("log_p") * UNIT).cast("long").alias("value")
    return model.select("name", "gram", F.col("n").cast("long").alias("n"), value).mapInArrow(run, "hash long, n long, value long")


def near_arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent grams, ``NEAR`` at most, and their values.

    They only spare the join: what is not among them is looked up in ``model``.
    """
    size = F.floor(F.log2("n") * 16).cast("int")
    held = {row["size"]: row["count"] for row in model.groupBy(size.alias("size")).count().collect()}
    least, taken = None, 0
    for step in sorted(held, reverse=True):
        taken += held[step]
        if taken > NEAR:
            break
        least = step
    chosen = model.filter(size >= least if least is not None else F.lit(False)).select("hash", "value")
    # As Arrow, since a million rows as Python objects fill a small driver.
    found = chosen.toArrow()
    hashes = found["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["value"].to_numpy()[order]


class Scorer:
    """Log-probabilities at hand, and the hashes of grams that have to be joined."""

    def __init__(self, near: tuple[np.ndarray, np.ndarray]):
        self.keys, self.values = near
        ranges = np.arange(2**INDEX_BITS, dtype=np.uint64) << np.uint64(64 - INDEX_BITS)
        self.starts = np.append(np.searchsorted(self.keys, ranges), len(self.keys)).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where not at hand, and whether they are at hand."""
        ranges = (hashes >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        values, hit = np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at, stop, left = self.starts[ranges], self.starts[ranges + 1], np.arange(len(hashes))
        while True:
            open_ = at < stop
            at, stop, left = at[open_], stop[open_], left[open_]
            if not len(left):
                return values, hit
            same = self.keys[at] == hashes[left]
            values[left[same]], hit[left[same]] = self.values[at[same]], True
            at, stop, left = at[~same] + 1, stop[~same], left[~same]

    def windows(self, name: str, texts: list[list[bytes]]) -> list[tuple[list[int], list[int], list[dict]]]:
        """For each text: characters and sums of its windows, and the grams to join, per window."""
        runs = [_running(words) for words in texts]
        hashes = _hashes(_codes("".join(runs)), ORDER, name)
        values, hit = self.find(hashes)
        found, end = [], 0
        for run in runs:
            start, end = end + ORDER - 1, end + len(run)
            if not run:
                end = start - ORDER + 1
                found.append(([], [], []))
                continue
            size = end - start
            cuts = np.arange(n := max(1, round(size / WINDOW))) * size // n
            lengths = np.diff(cuts, append=size)
            sums = np.add.reduceat(values[start:end], cuts)
            missed = np.flatnonzero(~hit[start:end])
            window = np.searchsorted(cuts, missed, side="right") - 1
            far = Counter(zip(window.tolist(), hashes[start:end][missed].view(np.int64).tolist(), strict=True))
            found.append((lengths.tolist(), sums.tolist(), [{"part": w, "hash": h, "n": n} for (w, h), n in far.items()]))
        return found


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur twice or more; ``window`` is a power of two.

    Ranks of windows come from ranks of their halves, so equality is exact.
    """
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ranks = np.array([seen.setdefault(w, len(seen)) for w in words])
    wide, kinds = 1, len(seen)
    while wide < window:
        left, right = ranks[:-wide], ranks[wide:]
        kept, ranks = np.unique(left * kinds + right, return_inverse=True)
        wide, kinds = wide * 2, len(kept)
        if kinds == len(ranks):
            return 0
    again = np.bincount(ranks)[ranks] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def shape(text: str) -> tuple[list[bytes], int, int, int, int]:
    """Words, their characters, symbols, repeated lines and repeated words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return (
        words,
        len(text) - sum(map(text.count, _WHITE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def scored(docs: DataFrame, model: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, counts, log_ppl, run_ppl) by a hashed model and the (name) it has texts of.

    ``log_ppl`` is the mean negative log-probability of a character, ``run_ppl``
    the median over windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(near_arrays(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in byte_slices(batches):
            names = batch.column(1).to_pylist()
            shapes = [shape(body) for body in batch.column(3).to_pylist()]
            parts: list = [None] * len(names)
            for name in set(names):
                own = [i for i, n in enumerate(names) if n == name]
                for i, found in zip(own, scorer.windows(name, [shapes[i][0] for i in own]), strict=True):
                    parts[i] = found
            counts = [[len(s[0]) for s in shapes], *[[s[i] for s in shapes] for i in (1, 2, 3, 4)]]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([p[0] for p in parts], pa.list_(pa.int32())),
                    pa.array([p[1] for p in parts], pa.list_(pa.int64())),
                    pa.array([p[2] for p in parts], _FAR),
                ],
                names=[key, "name", "__row", *_COUNTS, "__sizes", "__sums", "__far"],
            )

    body = text_or_empty(text)
    source = docs.select(key, _fold_name(body, lang), F.monotonically_increasing_id().alias("__row"), body.alias("text"))
    schema = source.drop("text").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    for name, kind in (("__sizes", "array<int>"), ("__sums", "array<bigint>"), ("__far", "array<struct<part:int,hash:bigint,n:int>>")):
        schema = schema.add(name, StructType.fromDDL(f"x {kind}")["x"].dataType)
    # Cut, so that row numbers are told once.
    rows = cut(source.mapInArrow(run, schema))
    far = rows.select("__row", F.explode("__far").alias("far")).select("__row", "far.*")
    joined = (
        far.join(model.select("hash", "value"), "hash")
        .groupBy("__row", "part")
        .agg(F.sum(F.col("n") * F.col("value")).alias("more"))
        .groupBy("__row")
        .agg(F.map_from_entries(F.collect_list(F.struct("part", "more"))).alias("__more"))
    )
    known = names.select(_other().alias("has"))
    totals = F.expr("transform(__sums, (x, i) -> x + coalesce(__more[i], 0L))")
    means = F.expr(f"sort_array(transform(__totals, (x, i) -> -x / ({UNIT}D * __sizes[i])))")
    middle = F.expr("(__means[(size(__means) - 1) div 2] + __means[size(__means) div 2]) / 2")
    chars = F.aggregate("__sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = -F.aggregate("__totals", F.lit(0).cast("long"), lambda a, x: a + x) / (UNIT * chars.cast("double"))
    judged = (F.col("n_words") > 0) & F.col("has").isNotNull()
    return (
        rows.drop("__far")
        .join(joined, "__row", "left")
        .join(known, F.col("name") == F.col("has"), "left")
        .withColumn("__totals", totals)
        .withColumn("__means", means)
        .select(
            key,
            F.expr("substring(name, 2)").alias("lang"),
            *_COUNTS,
            F.when(judged, whole).alias("log_ppl"),
            F.when(judged, middle).alias("run_ppl"),
        )
    )


def bands(rows: DataFrame) -> DataFrame:
    """(lang, middle, below, above): median and quartile distances of ``run_ppl``.

    Quartiles are read off a histogram, so any number of documents reduces to a
    few hundred rows per language before a window sees them. Distances are drawn
    toward the mean ones of all documents as if ``PRIOR_DOCS`` documents more were known.
    """
    own = F.floor(F.col("run_ppl") / BIN).alias("bin")
    bins = rows.filter("run_ppl IS NOT NULL").groupBy("lang", own).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN))

    found = upto.groupBy("lang").agg(*[quantile(q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)], F.sum("n").alias("n")).select(
        "lang",
        "n",
        F.col("q50").alias("middle"),
        F.greatest(F.col("q50") - F.col("q25"), F.lit(LEAST)).alias("below"),
        F.greatest(F.col("q75") - F.col("q50"), F.lit(LEAST)).alias("above"),
    )
    found = cut(found)
    mean = found.agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in ("below", "above")]).first()
    share = F.col("n") / (F.col("n") + PRIOR_DOCS)
    drawn = [(share * F.col(c) + (1 - share) * F.lit(mean[c] or LEAST)).alias(c) for c in ("below", "above")]
    return found.select("lang", "middle", *drawn)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, log-perplexity, band and verdict of every document."""
    counts = cut(gram_counts(docs, text, lang))
    orders = kneser_ney(counts)
    table = cut(hashed(cross_fitted(counts, orders)))
    names = cut(orders[0].select("name").distinct())
    discard(counts, *orders)
    few = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = cut(scored(docs, table, names, key, text, lang).withColumn("base_failed", few))
    wider = F.sqrt(1 + SHORT_WORDS / F.greatest(F.col("n_words"), F.lit(1)))
    return (
        rows.join(bands(rows.filter("NOT base_failed")), "lang", "left")
        .withColumn("lower", F.col("middle") - REACH_BELOW * wider * F.col("below"))
        .withColumn("upper", F.col("middle") + REACH_ABOVE * wider * F.col("above"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("run_ppl").between(F.col("lower"), F.col("upper")), F.lit(True)))
        .drop("middle", "below", "above")
    )
