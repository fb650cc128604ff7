"""Running grams, exact lookups and the shares of labelled documents that the bands reject."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tripflow.llm import quality_rules as rules
from tripflow.llm.queries import op8_quality_rules

SF_DIR = "/root/testdata/sf0.01"


def plain_running(texts, folds):
    """run_ppl of every text by a plain model of the other fold."""
    width, found = rules.ORDER, []
    probs = {f: brute.kneser_ney([t for t, g in zip(texts, folds) if g == f], width) for f in (0, 1)}
    for text, fold in zip(texts, folds):
        run, prob = brute.running(text, width), probs[1 - fold]
        logs = [-math.log(prob(run[i], run[i - width + 1 : i])) for i in range(width - 1, len(run))]
        n = max(1, round(len(logs) / rules.WINDOW))
        cuts = [k * len(logs) // n for k in range(n + 1)]
        found.append(float(np.median([sum(logs[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:])])))
    return found


def plain_kept(values, words, failed):
    """The verdicts on texts of one language, given their run_ppl."""
    bins = sorted(int(np.floor(v / rules.BIN)) for v, f in zip(values, failed) if not f)

    def quantile(q):
        return next((b + 0.5) * rules.BIN for i, b in enumerate(bins) if bins.count(b) + bins.index(b) >= q * len(bins))

    low, middle, high = quantile(0.25), quantile(0.5), quantile(0.75)
    # One language alone is drawn toward itself.
    below, above = max(middle - low, rules.LEAST), max(high - middle, rules.LEAST)
    kept = []
    for v, n, f in zip(values, words, failed):
        wider = math.sqrt(1 + rules.SHORT_WORDS / max(n, 1))
        kept.append(not f and middle - rules.REACH_BELOW * wider * below <= v <= middle + rules.REACH_ABOVE * wider * above)
    return kept


@pytest.fixture(scope="module")
def texts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").filter("lang = 'es' AND text IS NOT NULL").select("text").limit(40)
    return [r.text for r in docs.collect()]


def judged(spark, texts):
    df = spark.createDataFrame([(i, t, "es") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    return {r.doc_id: r for r in rules.quality_rules(df).collect()}


def test_perplexity_and_verdicts_equal_a_plain_model(spark, texts):
    df = spark.createDataFrame([(t, "es") for t in texts], "text string, lang string")
    folds = [int(r[0][0]) for r in df.select(rules._fold_name(F.col("text"), "lang")).collect()]
    want, got = plain_running(texts, folds), judged(spark, texts)
    assert all(abs(got[i].run_ppl - w) < 1e-7 for i, w in enumerate(want))
    words, failed = [got[i].n_words for i in range(len(texts))], [got[i].base_failed for i in range(len(texts))]
    assert [got[i].kept for i in range(len(texts))] == plain_kept(want, words, failed)


def test_copies_do_not_vouch_for_each_other(spark, texts):
    strange = " ".join(f"zq{i:x}jx" for i in range(200))
    got = judged(spark, texts + [strange] * 6)
    assert not any(got[i].kept for i in range(len(texts), len(texts) + 6))


def test_a_language_with_one_text_is_left_to_the_base_rules(spark, texts):
    rows = [(i, t, "es") for i, t in enumerate(texts)] + [(900, texts[0], "one"), (901, None, "none"), (902, "a few words", None)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[900].run_ppl is None and got[900].kept and not got[901].kept and not got[902].kept


def test_shuffled_words_are_told_from_their_text(spark):
    rng = random.Random(3)
    chain = [f"{''.join(rng.choices('etaoinshrdlu', k=5))}" for _ in range(120)]
    texts = []
    for _ in range(300):
        at = rng.randrange(120)
        texts.append(" ".join(chain[(at + k) % 120] for k in range(100)))
    mixed = chain[:100]
    rng.shuffle(mixed)
    texts.append(" ".join(mixed))
    got = judged(spark, texts)
    assert all(got[i].kept for i in range(300)) and not got[300].kept and not got[300].base_failed


def test_grams_outside_the_near_arrays_give_the_same(spark, texts, monkeypatch):
    whole = judged(spark, texts)
    for near in (0, 700):
        monkeypatch.setattr(rules, "NEAR", near)
        assert judged(spark, texts) == whole


def test_arrays_are_searched_by_ranges():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(9, dtype=np.uint64)]))
    values = rng.integers(1, 1000, len(keys))
    asked = np.concatenate([keys[::2], keys[::3] + np.uint64(1), rng.integers(0, 2**64, 1000, dtype=np.uint64)])
    table = dict(zip(keys.tolist(), values.tolist()))
    got, hit = rules.Scorer((keys, values)).find(asked)
    assert got.tolist() == [table.get(h, 0) for h in asked.tolist()] and hit.tolist() == [h in table for h in asked.tolist()]
    assert not rules.Scorer((keys[:0], values[:0])).find(asked)[1].any()


def test_a_small_language_has_a_band(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinsh", k=rng.randrange(2, 8))) for _ in range(200)]
    docs = [(i, " ".join(rng.choices(words, k=300)), "aa" if i < 200 else "bb") for i in range(212)]
    docs.append((999, " ".join("".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(200)), "bb"))
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert all(r.lower is not None and r.upper is not None for r in got.values())
    assert not got[999].base_failed and not got[999].kept


def test_labelled_junk_goes_and_good_documents_stay(spark):
    sf_dir = "/root/testdata/sf0.1"
    # The half of the documents that the reach of the bands was not chosen on.
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter("doc_id * 2654435761 % 1000 >= 500")
    rows = op8_quality_rules(spark, sf_dir).filter("NOT base_failed").join(labels, "doc_id").collect()
    bad, good = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(bad) > 100 and bad.count(False) / len(bad) > 0.38
    assert good.count(True) / len(good) > 0.96
