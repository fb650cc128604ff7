"""Secrets in texts, weighed by who owns copies of them.

Three kinds of secrets are found by their form alone. Beyond them, any long
token of mixed characters is a candidate: its hash is counted over the distinct
repositories and owners of the whole corpus. Widely copied values are examples
out of manuals; a live-looking value that stays with few owners is reported as
a secret of kind ``owned``. Values travel as hashes only.

Null text is empty. Null owners and repositories are one unknown owner and
repository. Repeated rows stay rows of their own and count as one copy. Spans
are code points, end exclusive. A span list is folded in its row, so a text
with many thousands of secrets costs the square of their number. An empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tripflow.llm.common import cut, text_or_empty
from tripflow.operators.skew import join_on_hot_keys


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    value_group: int
    min_chars: int


# Fixed by the contract. A run of `+` or of `{n,}` finds the same matches where
# a failing match cannot hide a later one: for the last two kinds.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
OWNED = Kind("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
KINDS = (*BASE, OWNED)

# Above so many distinct owners or repositories a value counts as a copied example.
MAX_OWNERS = 2
MAX_REPOS = 3
# Live-looking: letters and digits, no placeholder words, no character four times running.
_LETTER, _DIGIT = r"[A-Za-z]", r"[0-9]"
_PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your[_-]|placeholder|(.)\1{3}|01234|12345|abcdef"

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,looks_live:boolean>>"


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """All passing matches of a kind, placed by the lengths of the gaps between matches."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value_group))
    gaps = F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits))
    parts = F.zip_with(F.arrays_zip(gaps.alias("g"), hits.alias("h")), values, lambda gh, v: F.struct(
        F.length(gh["g"]).cast("bigint").alias("gap"), F.length(gh["h"]).cast("bigint").alias("size"), v.alias("value")
    ))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + part["gap"]
        live = part["value"].rlike(_LETTER) & part["value"].rlike(_DIGIT) & ~part["value"].rlike(_PLACEHOLDER)
        span = F.struct(
            begin.alias("start"),
            F.lit(number).alias("kind"),
            (begin + part["size"]).alias("end"),
            F.sha2(part["value"], 256).alias("hash"),
            live.alias("looks_live"),
        )
        passes = F.length(part["value"]) >= kind.min_chars
        return F.struct(
            (begin + part["size"]).alias("at"),
            F.when(passes, F.concat(done["spans"], F.array(span)).cast(_SPAN)).otherwise(done["spans"]).alias("spans"),
        )

    found = F.aggregate(parts, start, step, lambda done: done["spans"])
    return F.when(text.rlike(kind.pattern), found).otherwise(F.array().cast(_SPAN))


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos): one row per value and owner's repository before any count."""
    per_owner = spans.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def secrets(docs: DataFrame, owner: Column, repo: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) per row: spans sorted by start, then kind, each with its owners and verdict.

    ``live`` says whether a value looks live and stays with few owners. Spans of
    kind ``owned`` are there only if they are live and no other span meets them.
    """
    body = text_or_empty(text)
    rows = cut(
        docs.select(
            F.col(key).alias("key"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
            body.alias("text"),
        ).select(
            F.monotonically_increasing_id().alias("row"),
            "key",
            "owner",
            "repo",
            *[_spans(F.col("text"), i, kind).alias(kind.name) for i, kind in enumerate(KINDS)],
        ).select("row", "key", "owner", "repo", _free_of_base().alias("found"))
    )
    spans = rows.select("row", "owner", "repo", F.explode("found").alias("span")).select("row", "owner", "repo", "span.*")
    weighed = join_on_hot_keys(spans, ownership(spans), ["hash"])
    few = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= MAX_REPOS)
    judged = weighed.withColumn("live", F.col("looks_live") & few).filter(F.col("live") | (F.col("kind") < len(BASE)))
    kept = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("spans")
    )
    none = F.array().cast(kept.schema["spans"].dataType)
    return rows.select("row", "key").join(kept, "row", "left").select(
        F.col("key").alias(key), F.coalesce("spans", none).alias("spans")
    )


def _free_of_base() -> Column:
    """All base spans, and those candidates that meet none of them."""
    base = F.concat(*[F.col(kind.name) for kind in BASE])
    meets = lambda c: F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    likely = F.filter(F.col(OWNED.name), lambda c: c["looks_live"] & ~meets(c))
    return F.concat(base, likely)


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")
