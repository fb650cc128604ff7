"""Language of web pages by Bayesian fusion of four kinds of evidence.

- Text: the likelihood of its character trigrams under each language, tempered,
  since neighbouring trigrams tell much the same.
- The language the markup declares, and the address's suffix: how often pages
  of a language carry them, smoothed, counted over all pages.
- The host: a prior per host, shrunk toward its registered domain's, which is
  shrunk toward the prior of all pages, by grouped sums that leave the page itself out.

The trigram model is counted from texts of known language, at most
``MAX_TEXTS`` of each, those with the smallest hash of their id. It is a table
of fixed size per language. All statistics of pages cover all pages.

Null or empty markup has no text and no declaration, a null address no host and
no suffix; each is missing evidence and moves nothing, and a page without any
gets the prior of all pages. Repeated rows count each. Equal posteriors go to the
language first in order. Without any text of known language nothing can be told:
languages and confidence are null. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripflow.llm.common import cut, text_or_empty
from tripflow.operators.skew import join_on_hot_keys
from tripflow.operators.topn import in_order, top_per_group

MAX_TEXTS = 2000
BUCKET_BITS = 16
# Text speaks as loud as so many independent trigrams at most.
HEARD = 60.0
# Prior pages a host owes to its domain, a domain to all pages, a language to a declaration.
HOST_PAGES, DOMAIN_PAGES, SMOOTH = 5.0, 20.0, 1.0

_UNSEEN = re.compile(r"(?is)<!--.*?-->|<(script|style|nav|template|noscript)\b.*?</\1\s*>|<!doctype[^>]*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = r"(?is)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def visible_text(markup: str) -> str:
    """What a reader sees of a page, roughly: no scripts, styles, menus, comments or tags."""
    return html.unescape(_TAG.sub(" ", _UNSEEN.sub(" ", markup)))


def trigrams(text: str) -> np.ndarray:
    """How many trigrams of the lower-cased letters and gaps fall into each bucket (index, count)."""
    words = _NOT_LETTERS.sub(" ", text).strip().lower()
    if not words:
        return np.zeros((2, 0), dtype=np.int64)
    codes = np.frombuffer(f" {words} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    buckets = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    return np.stack(np.unique(buckets.astype(np.int64), return_counts=True))


def trigram_model(texts: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = MAX_TEXTS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and for each the log-probability of every bucket."""
    known = texts.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    brief = known.select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("mixed"))
    first = top_per_group(brief, ["lang"], [F.asc("mixed"), *in_order(["key"])], limit, keys=[F.col("mixed")])
    chosen = first.select("key", "lang").distinct()
    sample = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(chosen, ["key", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, n = trigrams(body.as_py())
                counts.setdefault(name, np.zeros(2**BUCKET_BITS, dtype=np.int64))[at] += n
        for name, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(own[used])], names=["lang", "bucket", "n"]
            )

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    frame = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**16 rows a language at most
    langs = sorted(frame["lang"].unique())
    table = np.full((len(langs), 2**BUCKET_BITS), 0.1)
    for i, name in enumerate(langs):
        own = frame[frame["lang"] == name]
        table[i, own["bucket"].to_numpy(dtype=np.int64)] += own["n"].to_numpy(dtype=float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, key: str, markup: str, url: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(key, host, domain, suffix, declared, n_grams, likelihood): tempered log-likelihood per language."""
    shared = pages.sparkSession.sparkContext.broadcast(model[1])
    n_langs = len(model[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sizes, found = [], []
            for body in batch.column(batch.num_columns - 1):
                at, n = trigrams(visible_text(body.as_py()))
                total = int(n.sum())
                sizes.append(total)
                scores = table[:, at] @ n if total else np.zeros(n_langs)
                found.append(scores * min(1.0, HEARD / max(total, 1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                names=[*batch.schema.names[:-1], "n_grams", "likelihood"],
            )

    def matched(column: Column, pattern: str) -> Column:
        return F.nullif(F.lower(F.regexp_extract(column, pattern, 1)), F.lit(""))

    address = F.col(url).cast("string")
    host = matched(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")
    source = pages.select(
        F.col(key).alias("key"),
        host.alias("host"),
        matched(text_or_empty(markup), _DECLARED).alias("declared"),
        text_or_empty(markup).alias("markup"),
    ).select(
        "key",
        "host",
        matched(F.col("host"), r"([^.]+\.[^.]+)$").alias("domain"),
        matched(F.col("host"), r"\.([a-z][a-z0-9-]*)$").alias("suffix"),
        "declared",
        "markup",
    )
    schema = source.drop("markup").schema.add("n_grams", "long").add("likelihood", T.ArrayType(T.DoubleType()))
    return source.mapInArrow(run, schema)


def _softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _added(*lists: Column) -> Column:
    total, *others = lists
    for other in others:
        total = F.zip_with(total, other, lambda a, b: a + b)
    return total


def _sums(n_langs: int, column: str = "weights") -> Column:
    # Sums of six decimals are exact in any order.
    return F.array(*[F.sum(F.round(F.col(column)[i], 6).cast("decimal(9,6)")).cast("double") for i in range(n_langs)])


def _shrunk(sums: Column, toward: Column, strength: float) -> Column:
    n = F.aggregate(sums, F.lit(0.0), lambda a, b: a + b)
    return F.zip_with(sums, toward, lambda s, t: (s + strength * t) / (n + strength))


def _given(rows: DataFrame, column: str, prior: Column, n_langs: int) -> DataFrame:
    """(column, log-odds per language): what carrying a value tells about the language.

    log P(language | value) - log P(language), shrunk toward 0 for rare values.
    """
    sums = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(_sums(n_langs).alias("sums"))
    rate = _shrunk(F.col("sums"), prior, SMOOTH)
    return sums.select(column, F.zip_with(rate, prior, lambda r, p: F.log(r / p)).alias(f"{column}_says"))


def languages(pages: DataFrame, model: tuple[list[str], np.ndarray], key: str = "page_id", markup: str = "html", url: str = "url") -> DataFrame:
    """(key, lang, confidence, text_lang, declared, suffix, host) of every page."""
    langs, n = model[0], len(model[0])
    evidence = text_evidence(pages, key, markup, url, model)
    if not langs:
        unknown = F.lit(None).cast("string")
        return evidence.select(
            F.col("key").alias(key), unknown.alias("lang"), F.lit(None).cast("double").alias("confidence"),
            unknown.alias("text_lang"), "declared", "suffix", "host",
        )
    even = F.array(*[F.lit(1.0 / n)] * n)
    rows = cut(evidence.withColumn("weights", F.when(F.col("n_grams") > 0, _softmax(F.col("likelihood"))).otherwise(even)))
    told = rows.filter("n_grams > 0")
    overall = told.agg(_sums(n).alias("sums")).first()["sums"]
    counts = [x or 0.0 for x in overall]
    prior = F.array(*[F.lit((c + 1.0) / (sum(counts) + n)) for c in counts])
    domains, hosts = (
        told.filter(F.col(c).isNotNull()).groupBy(c).agg(_sums(n).alias(f"{c}_sums")) for c in ("domain", "host")
    )
    joined = rows
    for column, frame in (
        ("host", hosts),
        ("domain", domains),
        ("declared", _given(told, "declared", prior, n)),
        ("suffix", _given(told, "suffix", prior, n)),
    ):
        joined = join_on_hot_keys(joined, frame, [column], "left")
    none = F.array(*[F.lit(0.0)] * n)
    # A page is no evidence for its own prior: its part is taken out of the sums.
    own = F.when(F.col("n_grams") > 0, F.transform("weights", lambda x: F.round(x, 6))).otherwise(none)

    def others(column: str) -> Column:
        return F.zip_with(F.coalesce(column, own), own, lambda s, x: F.greatest(s - x, F.lit(0.0)))

    joined = joined.withColumn("domain_prior", _shrunk(others("domain_sums"), prior, DOMAIN_PAGES))
    joined = joined.withColumn("host_prior", _shrunk(others("host_sums"), F.col("domain_prior"), HOST_PAGES))
    logged = F.transform("host_prior", lambda x: F.log(x))
    fused = _softmax(_added(
        F.col("likelihood"), logged, F.coalesce("declared_says", none), F.coalesce("suffix_says", none)
    ))
    names = F.array(*[F.lit(x) for x in langs])

    def best(weights: Column) -> Column:
        return F.element_at(names, F.array_position(weights, F.array_max(weights)).cast("int"))

    return joined.withColumn("fused", F.transform(fused, lambda x: F.round(x, 6))).select(
        F.col("key").alias(key),
        best(F.col("fused")).alias("lang"),
        F.array_max("fused").alias("confidence"),
        F.when(F.col("n_grams") > 0, best(F.col("weights"))).alias("text_lang"),
        "declared",
        "suffix",
        "host",
    )
