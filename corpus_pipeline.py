"""From raw documents to token ids: each stage is written as Parquet and read again by the next.

The stages, in order: the quality classifier drops what it rejects, line dedup
takes out repeated lines, the Jaccard join keeps one document of each group of
near copies, mixing repeats documents so that sources meet their weights, and byte-level BPE turns texts into ids, checked by decoding them.

Rows are told apart by their id and text together, so missing or repeated ids
harm no other row. A null text passes all stages as a document without words.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripflow.llm import bpe, jaccard_join, line_dedup, mixing, quality_classifier
from tripflow.llm.common import shared_folder, table, written
from tripflow.llm.queries import MAX_REPEATS, ranks

# Near copies: word shingles of five, four fifths or more in common.
SHINGLE_WORDS, PERCENT = 5, 80


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"


def _row() -> Column:
    """A row's name: 125 bits of hashes of its id and text, as a number that aggregates by hash."""
    parts = ["doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()]
    high, low = F.xxhash64(*parts), F.shiftrightunsigned(F.xxhash64(F.lit("~"), *parts), 2)
    wide = high.cast("decimal(19,0)") * F.lit(2**62).cast("decimal(19,0)")
    return (wide + low.cast("decimal(19,0)")).cast("decimal(38,0)").alias("__row")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    rows = docs.select("*", _row())
    labels = rows.select("__row", "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    judged = quality_classifier.quality(
        rows, labels.select("__row", "quality"), F.col("source"), F.concat_ws("/", "source", "lang"), key="__row"
    )
    rejected = judged.filter("NOT kept").select("__row").distinct()
    return rows.join(rejected, "__row", "left_anti").select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus; one that had no other words goes."""
    cut_down = line_dedup.line_dedup(docs)
    kept = cut_down.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    rows = docs.select("*", _row())
    groups = jaccard_join.near_duplicates(rows, key="__row", width=SHINGLE_WORDS, percent=PERCENT)
    named = groups.select("__row", "component_id").distinct().join(rows.select("__row", "doc_id").distinct(), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    chosen = named.groupBy("component_id").agg(first.alias("first")).select("first.__row")
    return rows.join(chosen, "__row").dropDuplicates(["__row"]).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for: a row for every epoch.

    Tokens are estimated by SQL functions, as this stage runs no Python. The budget
    is the least at which the source with the smallest weight for its size is read
    once in full, so no document is left out; the others repeat, twice at most.
    """
    rows = docs.withColumn("__tokens", mixing.text_pieces("text"))
    drawn = mixing.mixture(rows, max_repeats=MAX_REPEATS, tokens="__tokens", cover=True)
    named = rows.select(
        "*",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
        mixing.unit_name("doc_id", "text").alias("__name"),
    )
    keys = drawn.select(F.col("source").alias("__source"), F.col("name").alias("__name"), F.col("tokens").alias("__tokens"))
    return named.join(keys, ["__source", "__name", "__tokens"]).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    encoded = bpe.encode(docs, ranks(), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], checked=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", distinct_lines),
    ("jaccard_join", one_of_each_group),
    ("mixing", mixed_sources),
    ("byte_bpe", token_ids),
]

# Neither the classifier nor the tokenizer can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the folders of the stages lie in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = _folder(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
