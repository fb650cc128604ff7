"""The registered corpus queries: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripflow.llm import (
    bpe,
    chat,
    jaccard_join,
    language_id,
    line_dedup,
    merkle,
    mixing,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentence_pieces,
    topk,
)
from tripflow.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

# No source may be read more often than this in a mixture.
MAX_REPEATS = 2.0
# The tokenizer of the corpus; a file of fixed size that ships with its package.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def ranks() -> bytes:
    return bpe.read_ranks(public_tokenizers.path(RANK_FILE))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.trigram_model(texts)
    return language_id.languages(table(spark, sf_dir, "pages"), model)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs, width=3, percent=90)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks(), public_tokenizers.PATTERN, keep=["doc_id"], decoded=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _equals(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    repo = F.concat_ws("/", "source", "lang")
    found = secret_scan.secrets(docs, owner=F.col("source"), repo=repo)
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE))
    counts = [
        F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _equals(i))).cast("long").alias(f"n_{kind.name}")
        for i, kind in enumerate(secret_scan.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(
        table(spark, sf_dir, "documents"),
        table(spark, sf_dir, "labels"),
        host=F.col("source"),
        path=F.concat_ws("/", "source", "lang"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Fixed by the contract: a conversation of control strings.
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said)
    )
    made = chat.examples(given.union(extra))
    read = made.select(
        "conv_id",
        "example",
        F.length("formatted").alias("chars"),
        chat.trainable_text().alias("trained"),
        F.when(F.col("last"), chat.read_turns(F.col("formatted"))).alias("turns"),
    ).select(
        "conv_id",
        "chars",
        F.struct("example", "trained").alias("loss"),
        F.size("turns").alias("n"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
    )
    trained = F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["trained"]), "")
    return read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        trained.alias("trained"),
        F.sum("chars").alias("formatted_chars"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality_rules(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lang",
        "log_ppl",
        "run_ppl",
        "lower",
        "upper",
    )


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        F.col("key").alias("doc_id"), "source", "epoch", "copy", "token_start", F.col("tokens").alias("n_tokens")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = sentence_pieces.checked_model(public_tokenizers.path(PIECE_FILE))
    encoded = sentence_pieces.encode(docs, model, keep=["doc_id"], decoded=True)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _made_periodic(doc_id: Column, text: Column) -> Column:
    """Fixed by the contract: a tenth of the texts repeat a stretch of words to their end.

    ``words`` has to be a column of the rows: the words of those texts, else null.
    """
    g, n = F.floor(F.crc32(doc_id.cast("string")) / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeated = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get(F.col("words"), (a + (i - a) % p).cast("int"))))
    return F.when(n > 0, F.array_join(repeated, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.withColumn("words", F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, split))
    given = chosen.select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = periodic_runs.periodic_runs(given).withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.p")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1)

    def leaf(n_chars: Column) -> Column:
        return merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])

    rows = docs.select(
        "doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), F.when(more.isNotNull(), F.unhex(leaf(more))).alias("tampered")
    )
    claimed = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    return (
        merkle.manifest(rows)
        .withColumn("folded_root", merkle.folded(claimed, F.col("proof")))
        .select(
            "doc_id",
            "leaf",
            "subroot",
            "root",
            F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )


QUERIES: dict[str, Query] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_language_id": op2_language_id,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_chat_format": op7_chat_format,
    "op8_quality_rules": op8_quality_rules,
    "op9_temperature_mixing": op9_temperature_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
