"""Near duplicates against comparing all pairs that share a shingle."""

import random

import pytest

from tests.llm import brute
from tripflow.llm import jaccard_join
from tripflow.llm.graph import components
from tripflow.llm.queries import op3_jaccard_join

SF_DIR = "/root/testdata/sf0.001"


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.near_components(docs)
    assert found(op3_jaccard_join(spark, SF_DIR)) == want
    assert len({c for _, c in want.values()}) < len(want)


def cluster(rng, n, changes, base_words=120, first=0):
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((first + i, " ".join(words)))
    return docs


def test_chains_and_near_groups(spark):
    rng = random.Random(11)
    docs = cluster(rng, 80, 5) + cluster(rng, 40, 3, first=100) + cluster(rng, 30, 2, 30, first=200)
    # A chain: each differs a little from the one before, the ends share nothing.
    words = [f"c{i}" for i in range(60)]
    for i in range(40):
        words = words[1:] + [f"d{i}"]
        docs.append((300 + i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(jaccard_join.near_duplicates(df)) == brute.near_components(docs)


@pytest.mark.parametrize("width, percent", [(5, 80), (2, 50), (3, 100)])
def test_other_widths_and_bounds(spark, width, percent):
    rng = random.Random(width)
    docs = cluster(rng, 40, 6, 60) + cluster(rng, 20, 9, 25, first=100)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = found(jaccard_join.near_duplicates(df, width=width, percent=percent))
    assert got == brute.near_components(docs, width, percent)


def test_odd_texts(spark):
    long = " ".join(f"v{i % 977}" for i in range(30000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE TWO"), (8, "two one"),
            (9, long), (10, long + " more"), (11, "É a b"), (12, "é a b"), (13, "a b c a b c a b c"), (14, "a b c a b c")]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, node int")
    assert found(jaccard_join.near_duplicates(df)) == brute.near_components(docs)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "e f g"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7), (7, 0, 7)], key=str)


def test_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1001), (1000, 1001), (None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_rounds_do_not_inflate_estimates(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(3000)], "a long, b long")
    roots = components(path)
    assert roots.filter("root <> 0").isEmpty()
    assert int(str(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2**63
