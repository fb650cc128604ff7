"""Quality of documents: a classifier's evidence, weighed by the record of their site.

A logistic model over the shape of a text is fitted on labelled documents. Its
probabilities, or the labels where there are any, are summed per host and per
path. A host's rate is shrunk toward the rate of all hosts, a path's toward its
host's, the more so the fewer documents there are; how much, the spread between
hosts (and paths) tells: empirical Bayes on two levels. The rate of its path
then replaces the prior in the document's own evidence.

The model is fitted on at most ``MAX_LABELLED`` labelled documents, those with
the smallest hash of their id; all else covers every document. Without labels of
both kinds there is no evidence and every document is as good as its prior.

Null text is empty; a text without words has no evidence, only its prior. Null
hosts or paths are one host or path. Labels of null quality or without a
document count for nothing, and of contradicting labels the higher wins. Rows
that repeat a document count again in the record of its site. An empty table
gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tripflow.llm.common import cut, text_or_empty
from tripflow.operators.skew import join_on_hot_keys

MAX_LABELLED = 50_000
# A document stays if it is good with at least this probability.
KEEP = 0.5
# Prior strength, in documents, where sites show no spread beyond chance, and its least.
STRENGTHS = (1.0, 1000.0)
_BIN_BITS = 12
_RIDGE = 1e-3

_CLASSES = {
    "symbols": b"#*$%&|<>",
    "shouts": b"!",
    "capitals": bytes(range(65, 91)),
    "digits": b"0123456789",
    "marks": b".,;:?\"'()-",
}
FEATURES = (*_CLASSES, "symbol_words", "distinct_words", "word_size", "log_words")
_MEMBERS = np.array([[b in members for b in range(256)] for members in _CLASSES.values()], dtype=np.int64)
_SYMBOLS = set(b"#*$%&|<>!")


def shape_of(text: str) -> list[float]:
    """Shares that tell prose from junk, each between 0 and about 1; empty without words."""
    data = text.encode()
    words = data.split()
    if not words:
        return []
    counts = _MEMBERS @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    shares = np.minimum(1.0, 10 * counts / len(data))
    kinds = set(words)
    odd = sum(w[-1] in _SYMBOLS for w in words) / len(words)
    # Long texts repeat words by nature: compare with what as many words usually keep distinct.
    distinct = len(kinds) / len(words) ** 0.9
    return [*shares.tolist(), odd, min(1.5, distinct), min(2.0, len(data) / len(words) / 10), np.log1p(len(words)) / 10]


def shapes(docs: DataFrame, key: str, host: Column, path: Column, text: str) -> DataFrame:
    """(key, host, path, shape)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shape_of(t.as_py()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(found, pa.list_(pa.float64()))], names=["key", "host", "path", "shape"]
            )

    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path"))]
    source = docs.select(F.col(key).alias("key"), *named, text_or_empty(text).alias("text"))
    return source.mapInArrow(run, source.drop("text").schema.add("shape", T.ArrayType(T.DoubleType())))


def fit(shaped: DataFrame, limit: int = MAX_LABELLED) -> np.ndarray | None:
    """Weights (intercept first) of a ridge-penalised logistic model, by Newton steps on a bounded sample."""
    labelled = shaped.filter("label IS NOT NULL AND size(shape) > 0").select("key", "shape", "label").distinct()
    # Rows by the leading bits of their hash; as many whole bins as the limit allows.
    bin_ = F.shiftrightunsigned(F.xxhash64("key"), 64 - _BIN_BITS)
    counts = {row["bin"]: row["count"] for row in labelled.groupBy(bin_.alias("bin")).count().collect()}
    upto = np.cumsum([counts.get(i, 0) for i in range(2**_BIN_BITS)])
    sample = labelled.filter(bin_ < int(np.searchsorted(upto, limit, side="right"))).toPandas()
    sample = sample.sort_values(["key", "label"], kind="stable")
    if sample["label"].nunique() < 2:
        return None
    x = np.column_stack([np.ones(len(sample)), np.array(sample["shape"].tolist())])
    y = sample["label"].to_numpy(dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) / len(y) - _RIDGE * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + _RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return np.round(w, 9)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> Column:
    """Prior strength by moments, from (n, rate, toward) per group.

    What the rates of groups scatter beyond binomial chance is their own spread
    v; a beta prior of strength m (1 - m) / v - 1 has it. Its bounds keep sites
    without any spread, or with one site, from extremes.
    """
    chance = F.sum(F.col("toward") * (1 - F.col("toward")))
    scatter = F.sum(F.col("n") * F.pow(F.col("rate") - F.col("toward"), 2)) - chance
    own = F.greatest(scatter / F.sum("n"), F.lit(1e-9))
    mean = F.sum(F.col("n") * F.col("toward") * (1 - F.col("toward"))) / F.sum("n")
    return F.least(F.greatest(mean / own - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))


def site_rates(judged: DataFrame) -> DataFrame:
    """(host, path, rate): the shrunk rate of good documents of each path, from (host, path, good)."""
    paths = cut(judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")))
    total = paths.agg(F.sum("good") / F.sum("n")).first()[0] or 0.5
    mean = F.lit(min(max(total, 1e-6), 1 - 1e-6))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("rate", F.col("good") / F.col("n")).withColumn("toward", mean)
    strength = hosts.agg(_strength(hosts)).first()[0] or STRENGTHS[1]
    host_rates = hosts.select("host", ((F.col("good") + strength * F.col("toward")) / (F.col("n") + strength)).alias("toward"))
    within = cut(join_on_hot_keys(paths, host_rates, ["host"]).withColumn("rate", F.col("good") / F.col("n")))
    strength = within.agg(_strength(within)).first()[0] or STRENGTHS[1]
    return within.select("host", "path", ((F.col("good") + strength * F.col("toward")) / (F.col("n") + strength)).alias("rate"))


def quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """(key, evidence, site_rate, p_good, kept) of every document; ``labels``: (key, quality)."""
    known = labels.filter("quality IS NOT NULL").groupBy(F.col(key).alias("key")).agg(F.max("quality").cast("double").alias("label"))
    shaped = cut(shapes(docs, key, host, path, text).join(known, "key", "left"))
    weights = fit(shaped)
    seen = F.size("shape") > 0
    if weights is None:
        logit, base = F.lit(0.0), 0.0
    else:
        terms = [F.col("shape")[i] * float(w) for i, w in enumerate(weights[1:])]
        logit = F.when(seen, sum(terms, F.lit(float(weights[0]))))
        base = _base_logit(shaped)
    evidence = F.coalesce(logit - base, F.lit(0.0))
    # Rounded, so that sums per site do not depend on their order.
    alone = F.round(1 / (1 + F.exp(-(evidence + base))), 6).cast("decimal(9,6)")
    judged = shaped.select("key", "host", "path", evidence.alias("evidence"), F.coalesce(F.col("label").cast("decimal(9,6)"), alone).alias("good"))
    rates = site_rates(judged).select("host", "path", F.col("rate").cast("double").alias("rate"))
    joined = join_on_hot_keys(judged, rates, ["host", "path"])
    bounded = F.least(F.greatest(F.col("rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    p = 1 / (1 + F.exp(-(F.col("evidence") + _logit(bounded))))
    return joined.select(
        F.col("key").alias(key),
        F.round("evidence", 6).alias("evidence"),
        F.round("rate", 6).alias("site_rate"),
        F.round(p, 6).alias("p_good"),
        (F.round(p, 6) >= keep).alias("kept"),
    )


def _base_logit(shaped: DataFrame) -> float:
    """The log-odds of good among all labelled documents: the prior inside the model's output."""
    good, n = shaped.filter("label IS NOT NULL AND size(shape) > 0").agg(F.sum("label"), F.count(F.lit(1))).first()
    return float(np.log((good + 0.5) / (n - good + 0.5)))
