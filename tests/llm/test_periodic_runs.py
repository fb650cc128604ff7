"""Periodic runs against trying every period."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tripflow.llm import periodic_runs
from tripflow.llm.queries import op12_periodic_runs

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def numbers(word):
    return np.array([ord(c) for c in word], dtype=np.int64)


@pytest.mark.parametrize("min_length", [4, 6, 12])
def test_runs_of_random_and_structured_words(min_length):
    rng = random.Random(min_length)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    words = [fibonacci[-1], "a" * 100, "ab" * 60 + "a", "abaababaab" * 5 + "c" + "abc" * 20, ""]
    words += ["".join(rng.choices("ab" if k % 2 else "abc", k=rng.randrange(1, 120))) for k in range(300)]
    for _ in range(200):
        root = "".join(rng.choices("abc", k=rng.randrange(1, 12)))
        words.append("".join(rng.choices("abc", k=rng.randrange(9))) + (root * 12)[: rng.randrange(2, 60)] + root[:2] * rng.randrange(5))
    for word in words:
        got = [tuple(r) for r in periodic_runs.runs_in(numbers(word), min_length).tolist()]
        assert got == brute.runs(word, min_length), word


def test_common_extensions_equal_comparing():
    rng = random.Random(4)
    word = "".join(rng.choices("ab", k=150))
    tree = periodic_runs.SuffixTree(numbers(word).tolist())
    i, j = np.array([(a, b) for a in range(150) for b in range(150) if a != b]).T
    want = [next((k for k in range(150) if max(a, b) + k >= 150 or word[a + k] != word[b + k]), None) for a, b in zip(i, j)]
    assert tree.common(i, j).tolist() == want
    ranks = {tuple(word[a:]): r for a, r in enumerate(tree.ranks(False).tolist())}
    assert [ranks[x] for x in sorted(ranks)] == sorted(ranks.values())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(brute.periodic(i, t) for i, t in docs if len(t or "") < 8000)
    short = {r[0] for r in want}
    got = sorted(tuple(r) for r in op12_periodic_runs(spark, SF_DIR).select(COLUMNS).collect())
    assert len(got) == len(docs) and [r for r in got if r[0] in short] == want
    assert any(r[1] for r in want)


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    unit = [f"w{i}" for i in range(5000)]
    texts = [None, "", " \n", "one", "a " * 12, "a " * 11, "x y " * 9 + "é é é", " ".join(unit * 3), "ho \t" * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b c " * 20), (None, None), (4, "a " * 12)]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 10**5] + [(1001, texts[-1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).select(COLUMNS).collect()]
    key = lambda r: (str(r[0]), str(r))
    long = {1001, 7}
    want = [brute.periodic(*r) for r in rows if r[0] not in long]
    assert sorted([r for r in got if r[0] not in long], key=key) == sorted(want, key=key)
    assert [r[1:6] for r in got if r[0] == 1001] == [(1, 0, 100_000, 1, 100_000_000)]
    df = spark.createDataFrame([("a " * 14, 1, 2)], "text string, RUNS int, other int")
    out = periodic_runs.periodic_runs(df)
    assert out.columns == ["text", "other", "runs", "collapsed"] and out.first().collapsed == "a"


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "text string")).count() == 0
