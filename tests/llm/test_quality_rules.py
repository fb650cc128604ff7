"""Counts, Kneser-Ney probabilities and bands against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tripflow.llm import quality_rules as rules
from tripflow.llm.queries import op8_quality_rules

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in op8_quality_rules(spark, SF_DIR).collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang").collect()


def test_counts_equal_plain_counts(rows, docs):
    assert len(rows) == len(docs)
    for d in docs:
        r, want = rows[d.doc_id], brute.rules(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_the_model_itself_equals_a_plain_model(spark, docs):
    texts = [d.text for d in docs if d.lang == "es"][:60]
    df = spark.createDataFrame([(t, "es") for t in texts], "text string, lang string")
    folds = [r[0] for r in df.select(rules._fold_name(F.col("text"), "lang")).collect()]
    counts = rules.cut(rules.gram_counts(df))
    orders = rules.kneser_ney(counts)
    for fold in ("0es", "1es"):
        prob = brute.kneser_ney([t for t, f in zip(texts, folds) if f == fold], rules.ORDER)
        for frame in orders:
            for r in frame.filter(F.col("name") == fold).collect():
                assert abs(r.p - prob(r.gram[-1], r.gram[:-1])) < 1e-12
    # Grams are judged by the other fold, also those it does not have.
    for r in rules.cross_fitted(counts, orders).filter("name = '0es'").collect():
        assert abs(r.log_p - math.log(prob(r.gram[-1], r.gram[:-1]))) < 1e-9


def test_clean_documents_stay_and_gibberish_goes(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("etaoinsh", k=rng.randrange(2, 8))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(300, 400))), "xx") for i in range(400)]
    docs += [(1000, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) + (" " if i % 5 == 0 else "") for i in range(400)), "xx"),
             (1001, " ".join("qzjxkvw"[i % 7] * (3 + i % 5) for i in range(120)), "xx"), (1002, None, None), (1003, "", "xx")]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(400))
    assert not got[1000].kept and not got[1000].base_failed
    assert (got[1002].n_words, got[1002].log_ppl, got[1002].kept) == (0, None, False)


def test_repeats_long_texts_and_extra_columns(spark):
    text = "one two three four five six seven eight nine " * 3000
    docs = [(1, text, "a", 9), (1, text, "a", 9), (None, "a b c d e f g h a b c d e f g h", "a", 9), (3, "x" * 100_000, None, 9)]
    got = rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string, n_words int")).collect()
    assert sorted((r.n_words, r.n_repeat_words) for r in got) == [(1, 0), (16, 16), (27000, 27000), (27000, 27000)]


def test_empty_table(spark):
    assert rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
