"""The quality classifier: held-out accuracy, shrinkage by hand, odd rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tripflow.llm import quality_classifier as classifier

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    seen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    got = classifier.quality(docs, seen, F.col("source"), F.concat_ws("/", "source", "lang"))
    held = got.join(labels.join(seen, "doc_id", "left_anti"), "doc_id").toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert len(bad) > 15 and good.kept.mean() > 0.99 and bad.kept.mean() < 0.1


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [("big", "big/a", g) for g in [1.0] * 95 + [0.0] * 5] + [("bad", "bad/a", 0.0)] * 80
    rows += [("big", "big/new", 0.0), ("lone", "lone/x", 0.0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["host", "path", "good"]))
    rates = {r.path: float(r.rate) for r in classifier.site_rates(df).collect()}
    assert rates["bad/a"] < 0.1 < rates["lone/x"] < rates["big/new"] < rates["big/a"]
    total = sum(r[2] for r in rows) / len(rows)
    assert rates["lone/x"] < total


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (None, 0)]])
def test_without_labels_the_prior_decides(spark, labels):
    docs = spark.createDataFrame([(1, "some words here", "s", "p"), (2, None, None, None)], "doc_id long, text string, host string, path string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = classifier.quality(docs, known, F.col("host"), F.col("path")).collect()
    assert len(got) == 2 and all(r.evidence == 0 for r in got)


def test_odd_rows(spark):
    good = "Plain words follow each other, and a sentence ends. Another begins here with more words."
    bad = "THIS!! IS!! BAD!! ### $$$ !!! %%% BUY!! NOW!!"
    rows = [(i, good + f" {i}", "h", "p", 5.0) for i in range(30)] + [(100 + i, bad + f" {i}", "h", "p", 5.0) for i in range(10)]
    rows += [(500, None, None, None, 1.0), (501, "", "h", "p", 1.0), (502, "x" * 300_000, "h", "p", 1.0), (0, good + " 0", "h", "p", 5.0), (None, bad, "h", "p", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, evidence double")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(7)], "doc_id long, quality int")
    got = classifier.quality(docs, labels, F.col("host"), F.col("path"))
    assert got.columns == ["doc_id", "evidence", "site_rate", "p_good", "kept"]
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert got.count() == len(rows)
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(10)) and not kept[None]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.quality(docs, labels, F.col("host"), F.col("host")).count() == 0
