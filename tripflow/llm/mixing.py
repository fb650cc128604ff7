"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent,
normalised. Exponent 1 keeps the shares, 0 makes all sources equal. The
exponent is bisected until the weights have a wanted entropy, or until no
source repeats more often than allowed. The token budget then goes to the
sources by weight: whole epochs of a source first, then a part of a last one.

Each epoch is a permutation of its own: documents fall into blocks, blocks are
permuted, documents are permuted within their block. A source of n documents
has about sqrt(n) blocks of about sqrt(n) documents, so running sums of tokens
see the square root of even the largest source.

Null sources are one source. Documents without tokens fill no budget and come along in
whole epochs. Rows equal in id, source and tokens are one unit that stays
together; rows without an id go by their text. A last epoch stops before the
document that would exceed the budget. An empty table gives no rows, and a
source without tokens has weight 0. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tripflow.llm.common import cut, text_or_empty
from tripflow.operators.skew import join_on_hot_keys

# Exponents are multiples of 2**-STEPS; each job looks HALVINGS steps ahead.
STEPS, HALVINGS = 12, 4
SEED = 17
PIECE = r" ?\p{IsLatin}{1,4}| ?\p{L}| ?\p{N}{1,2}| ?[^\s\p{L}\p{N}]{1,2}|\s+"


def text_tokens(text: str = "text") -> Column:
    """A cheap estimate: four bytes a token."""
    return F.ceil(F.octet_length(text_or_empty(text)) / 4)


def text_pieces(text: str = "text") -> Column:
    """A closer estimate, by SQL functions alone: the pieces of a text that BPE mostly makes tokens of.

    Up to four Latin letters, any other letter, up to two digits or signs, each
    with a space before it, or a run of white space. Every character is in a piece,
    so the text with a sign in place of each piece is as long as it has pieces.
    """
    return F.length(F.regexp_replace(text_or_empty(text), PIECE, "#"))


def unit_name(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.md5(text_or_empty(text)))


def units(docs: DataFrame, key: str, source: str, tokens: Column, text: str = "text") -> DataFrame:
    """(key, source, name, tokens, rows): rows that cannot be told apart, with their number."""
    return docs.groupBy(
        F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), unit_name(key, text).alias("name"), tokens.alias("tokens")
    ).agg(F.count(F.lit(1)).alias("rows"))


def source_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("tokens") * F.col("rows")).alias("source_tokens"))


def _measured(sizes: DataFrame, total: int, budget: int | None, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """(sum of powers, entropy, most repeats, budget) of each exponent, by one aggregation over the sources.

    Without a budget it is the least that reads every source once.
    """
    share = F.col("source_tokens") / F.lit(float(total))
    columns = []
    for e in exponents:
        power = F.pow(share, F.lit(e))
        columns += [F.sum(power), F.sum(power * F.log(power)), F.max(power / share), F.min(power / share)]
    row: Row = sizes.filter("source_tokens > 0").agg(*columns).first()
    found = []
    for i in range(len(exponents)):
        z, inner, most, least = row[4 * i : 4 * i + 4]
        spent = total * z / least if budget is None else budget
        # H = ln Z - sum(u ln u) / Z; a source repeats weight * budget / tokens times.
        found.append((z, math.log(z) - inner / z, most / z * spent / total, spent))
    return found


def solve_exponent(sizes: DataFrame, total: int, budget: int | None, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The flattest exponent that keeps to both limits; 0 where none is given.

    ``entropy`` (in nats) is met from above: the weights have at least it, as
    close as the steps allow. ``max_repeats`` goes first if both cannot hold.
    """

    def lowest(fits) -> int:
        low, high = 0, 2**STEPS  # the exponent 1 always fits or nothing does
        while low < high:
            width = max(1, (high - low) >> HALVINGS)
            tried = list(range(low, high, width))
            good = [fits(m) for m in _measured(sizes, total, budget, [t / 2**STEPS for t in tried])]
            at = good.index(True) if True in good else len(tried)
            low, high = (tried[at - 1] + 1 if at else tried[0]), (tried[at] if at < len(tried) else high)
        return low

    steps = 0
    if entropy is not None:
        steps = max(0, lowest(lambda m: m[1] < entropy) - 1)
    if max_repeats is not None:
        steps = max(steps, lowest(lambda m: m[2] <= max_repeats))
    return steps / 2**STEPS


def allotted(sizes: DataFrame, total: int, budget: int | None, exponent: float) -> DataFrame:
    """(source, units, weight, source_budget, epochs, rest) per source with tokens.

    Without a budget a source gets an epoch at least, also one without tokens.
    """
    z, _, _, spent = _measured(sizes, total, budget, [exponent])[0]
    weight = F.pow(F.col("source_tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(z)
    own = F.round(F.col("weight") * spent).cast("long")
    if budget is None:
        whole = {"weight": F.lit(0.0), "source_budget": F.lit(0).cast("long"), "epochs": F.lit(1).cast("long"), "rest": F.lit(0).cast("long")}
        without_tokens = sizes.filter("source_tokens = 0").withColumns(whole)
        own = F.greatest(own, F.col("source_tokens"))
    given = (
        sizes.filter("source_tokens > 0")
        .withColumn("weight", weight)
        .withColumn("source_budget", own)
        .withColumn("epochs", F.expr("source_budget DIV source_tokens"))
        .withColumn("rest", F.expr("source_budget % source_tokens"))
    )
    return given.unionByName(without_tokens) if budget is None else given


def _order(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts]))


def permuted(parts: DataFrame, shares: DataFrame, seed: int = SEED) -> DataFrame:
    """Units in every epoch their source's budget pays for, with their place in tokens.

    (key, source, name, tokens, rows, epoch, token_start): ``token_start``
    counts the tokens of the epoch before the unit.
    """
    placed = join_on_hot_keys(parts, shares.select("source", "units", "epochs", "rest"), ["source"])
    blocks = F.ceil(F.sqrt("units"))
    block = F.conv(F.substring(_order(seed, F.col("source"), F.col("name")), 1, 8), 16, 10).cast("long") % blocks
    each = placed.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).filter(
        (F.col("epoch") < F.col("epochs")) | (F.col("rest") > 0)
    )
    size = F.col("tokens") * F.col("rows")
    group = ["source", "epoch", "block"]
    inner = Window.partitionBy(*group).orderBy("mixed", "tokens", "key").rowsBetween(Window.unboundedPreceding, -1)
    inside = each.withColumn("mixed", _order(seed, F.col("epoch"), F.col("name"))).withColumn("inside", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    totals = each.groupBy(*group).agg(F.sum(size).alias("block_tokens"))
    outer = Window.partitionBy("source", "epoch").orderBy(_order(seed, F.col("epoch"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("before", F.coalesce(F.sum("block_tokens").over(outer), F.lit(0))).drop("block_tokens")
    whole = F.col("epoch") < F.col("epochs")
    return (
        join_on_hot_keys(inside, starts, group)
        .withColumn("token_start", F.col("before") + F.col("inside"))
        .filter(whole | (F.col("token_start") + size <= F.col("rest")))
        .select("key", "source", "name", "tokens", "rows", F.col("epoch").cast("int").alias("epoch"), "token_start")
    )


def mixture(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    budget: int | None = None,
    max_repeats: float | None = 2.0,
    entropy: float | None = None,
    seed: int = SEED,
    tokens: str | None = None,
    cover: bool = False,
) -> DataFrame:
    """The units of the mixture; ``budget`` in tokens is the corpus's own size where not given.

    With ``cover`` the budget is the least at which every source is read once in
    full, so no unit is left out and the others repeat.
    ``tokens`` names a column of token counts (null: none); without it they are
    estimated from bytes by `text_tokens`.
    """
    counted = F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")) if tokens else text_tokens(text)
    parts = cut(units(docs, key, source, counted, text))
    sizes = cut(source_sizes(parts))
    total = sizes.agg(F.sum("source_tokens")).first()[0] or 0
    if not total:
        empty = parts.withColumn("epoch", F.lit(0)).withColumn("token_start", F.lit(0).cast("long"))
        return empty if cover else empty.filter("false")
    if cover and budget is not None:
        raise ValueError("give a budget or cover, not both")
    budget = None if cover else total if budget is None else budget
    exponent = solve_exponent(sizes, total, budget, max_repeats, entropy)
    return permuted(parts, allotted(sizes, total, budget, exponent), seed)
