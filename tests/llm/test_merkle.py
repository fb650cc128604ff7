"""The Merkle manifest against building the whole tree."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tripflow.llm import merkle
from tripflow.llm.queries import op13_merkle_manifest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def plain(rows):
    return sorted(map(str, rows))


def made(spark, rows, tmp_path, **options):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return op13_merkle_manifest(spark, str(tmp_path))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    want = brute.merkle([tuple(r) for r in docs.collect()])
    got = [tuple(r) for r in op13_merkle_manifest(spark, SF_DIR).select(COLUMNS).collect()]
    assert plain(got) == plain(want) and {r[-1] for r in got} == {True, False}


def test_nulls_ties_repeats_and_long_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "", "s"]), rng.choice([None, "", "-", "é", "en"]),
             rng.choice([None, 5]), rng.choice([None, "", "naïve", "x" * 300_000])) for i in range(60)]
    rows += [rows[0]] * 3 + [(7, "a", "alone", 1, "t")]
    got = [tuple(r) for r in made(spark, rows, tmp_path).select(COLUMNS).collect()]
    assert plain(got) == plain(brute.merkle(rows))


def test_empty_table_and_single_row(spark, tmp_path):
    assert made(spark, [], tmp_path / "a").count() == 0
    row = (3, "s", "l", 1, "t")
    (got,) = made(spark, [row], tmp_path / "b").select(COLUMNS).collect()
    assert [tuple(got)] == brute.merkle([row]) and got.leaf == got.subroot == got.root


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 31, 64, 65])
def test_groups_of_many_small_blocks(spark, n):
    """Blocks of four leaves, so that a group takes several rounds and ends in every way."""
    rows = [(i, "s", "hot" if i < n else f"g{i % 7}", 1, "t") for i in range(n + 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    leaf = merkle.leaf_digest([F.col(c) for c in df.columns])
    # Columns named like those of the tree pass through or are replaced.
    df = df.select("doc_id", "lang", leaf.alias("leaf"), F.lit(9).alias("at"), F.lit(8).alias("G"), F.lit(7).alias("PROOF"))
    out = merkle.manifest(df, block_levels=2)
    assert out.columns == ["doc_id", "lang", "leaf", "at", "G", "leaf_place", "proof", "subroot", "root"]
    got = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256),
                     (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    assert plain(tuple(r)[:5] for r in got) == plain(r[:5] for r in brute.merkle(rows))
