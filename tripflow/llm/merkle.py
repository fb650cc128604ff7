"""Merkle manifest of a dataset: a root digest, and for each row a proof that leads to it.

Rows are leaves of a binary tree per group, the groups' roots are leaves of one
more tree. The computation is time-forward processing: nodes are labelled by
level and place, a priority queue ordered by label brings child digests to their
parent, and a sweep in the reverse order brings each node the part of the proof
above it, down to the leaves.

The queue is external. A task holds the queue of one block, ``2**BLOCK_LEVELS``
neighbouring nodes and the levels above them; messages between blocks travel
through a shuffle by (group, block). So a round climbs that many levels, and a
large group is as many blocks as it needs. Only the digest of a block goes up and
one proof suffix comes down to it.

Null groups come first and are a group of their own; null fields have a digest
of their own. Rows with equal order keys are placed by their digests, so equal
rows are leaves of their own, interchangeable. Null order keys come first. An
empty table gives an empty manifest. Columns that carry a name of the output are
replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tripflow.llm.common import cut, without
from tripflow.operators.prefix import positions

BLOCK_LEVELS = 10
_NODE = "g string, at long, n long, digest binary"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(value: Column) -> Column:
    """A field's bytes as they are hashed: their number, a colon and the value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Hexadecimal digest of a row."""
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    side = lambda node, name: F.coalesce(node[name], F.lit(""))
    return F.aggregate(
        proof, leaf, lambda below, node: F.sha2(F.concat(side(node, "left"), below, side(node, "right")), 256)
    )


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, from the leaf to the root."""
    return F.array_join(F.transform(proof, lambda node: F.coalesce(node["left"], node["right"], F.lit(""))), "")


def _levels(n: int, most: int) -> int:
    """Levels that a block climbs in a round: all there are, if its group is one block."""
    return min(most, (n - 1).bit_length())


def _climb(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of a block's nodes, level by level up to its root.

    Nodes leave the queue in the order of their labels, so children of one
    parent leave it one after the other, and before any node of its level.
    """
    queue = [(0, place, digest) for place, digest in enumerate(digests)]
    heapify(queue)
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    while queue:
        level, place, digest = heappop(queue)
        nodes[level].append(digest)
        if level == levels:
            continue
        text = digest
        if queue and queue[0][:2] == (level, place + 1):
            sibling = heappop(queue)[2]
            nodes[level].append(sibling)
            text += sibling
        heappush(queue, (level + 1, place // 2, hashlib.sha256(text.encode()).hexdigest()))
    return nodes


def _descend(nodes: list[list[str]], above: list[dict]) -> list[list[dict]]:
    """Each leaf's proof: its siblings in the block, then those ``above`` the block.

    The queue gives the labels in reverse, so a node has its suffix before its children ask.
    """
    top = len(nodes) - 1
    queue = [(-top, 0, above)]
    proofs: list[list[dict]] = []
    while queue:
        down, place, suffix = heappop(queue)
        if not down:
            proofs.append(suffix)
            continue
        below = nodes[-down - 1]
        first, second = 2 * place, 2 * place + 1
        if second < len(below):
            heappush(queue, (down + 1, first, [{"left": None, "right": below[second]}, *suffix]))
            heappush(queue, (down + 1, second, [{"left": below[first], "right": None}, *suffix]))
        else:
            heappush(queue, (down + 1, first, [{"left": None, "right": None}, *suffix]))
    return proofs


def _block_nodes(block: pa.Table, most: int) -> list[list[str]]:
    return _climb([d.hex() for d in block.column("digest").to_pylist()], _levels(block.column("n")[0].as_py(), most))


def _block(most: int) -> Column:
    return F.shiftright("at", most).alias("block")


def _raised(nodes: DataFrame, most: int) -> DataFrame:
    """The roots of all blocks: the nodes of the next round."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n = block.column("n")[0].as_py()
        root = bytes.fromhex(_block_nodes(block, most)[-1][0])
        values = [[key[0].as_py()], [key[1].as_py()], [-(-n >> most)], [root]]
        return pa.table([pa.array(v, t) for v, t in zip(values, [pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)],
                        names=["g", "at", "n", "digest"])

    return nodes.select("g", "at", "n", "digest").groupBy("g", _block(most)).applyInArrow(run, _NODE)


def _lowered(nodes: DataFrame, suffixes: DataFrame, extra: Sequence[str], most: int) -> DataFrame:
    """``nodes`` with their proofs, given those of their blocks as (g, at, proof, subroot, root)."""
    kept = nodes.select(*dict.fromkeys(["g", "at", "n", "digest", *extra]))
    fields = [kept.schema[c] for c in ("g", "at", *extra)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    passed = ["subroot", "root"]

    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        suffix = above.column("proof")[0].as_py()
        proofs = pa.array(_descend(_block_nodes(block, most), suffix), _PROOF)
        same = [pa.array([above.column(c)[0].as_py()] * block.num_rows, pa.string()) for c in passed]
        return pa.table(
            [*[block.column(f.name) for f in fields], proofs, *same], names=[*[f.name for f in fields], "proof", *passed]
        )

    proof = "proof array<struct<left string, right string>>, subroot string, root string"
    return (
        kept.groupBy("g", _block(most))
        .cogroup(suffixes.select("g", F.col("at").alias("block"), "proof", *passed).groupBy("g", "block"))
        .applyInArrow(run, f"{schema}, {proof}")
    )


def _rounds(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The nodes at the start of each round, the last ones being the groups' roots."""
    rounds = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1 or len(rounds) == 1:
        rounds.append(cut(_raised(rounds[-1], most)))
        largest = -(-largest >> most)
    return rounds


def manifest(
    rows: DataFrame,
    leaf: str = "leaf",
    group: str = "lang",
    order: Sequence[str] = ("doc_id",),
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``rows`` with their place in the tree: ``leaf_place``, ``proof``, ``subroot``, ``root``.

    ``leaf`` is the hexadecimal digest of a row. ``proof`` has an element per
    level from the leaf up to the root: the sibling to the left or right, or
    neither for a node that is hashed alone. A task holds ``2**block_levels`` nodes
    and those above them.
    """
    added = ["leaf_place", "proof", "subroot", "root"]
    rows = without(rows, added)
    kept = rows.columns
    # Names of its own keep the rows' columns apart from the tree's.
    inner = [f"c{i}" for i in range(len(kept))]
    own = rows.select(
        *[F.col(f"`{c}`").alias(name) for c, name in zip(kept, inner, strict=True)],
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),
        F.unhex(F.col(f"`{leaf}`")).alias("digest"),
    )
    order_names = [inner[kept.index(c)] for c in order]
    others = [name for name in inner if name != inner[kept.index(leaf)]]
    leaves = cut(positions(own.select(*others, "g", "digest"), ["g"], [*order_names, "digest"], "at", "n"))
    rounds = _rounds(leaves, block_levels)
    # The second tree: the groups' roots, in the order of the groups.
    named = rounds[-1].select(F.col("g").alias("name"), "digest", F.lit("").alias("g"))
    tops = cut(positions(named, ["g"], ["name"], "at", "n"))
    top_rounds = _rounds(tops, block_levels)
    digest = F.lower(F.hex("digest"))
    start = top_rounds[-1].select(
        "g", "at", F.array().cast("array<struct<left:string,right:string>>").alias("proof"),
        F.lit("").alias("subroot"), digest.alias("root"),
    )
    lowered = start
    for i, nodes in reversed(list(enumerate(top_rounds[:-1]))):
        lowered = cut(_lowered(nodes, lowered, ["name", "digest"] if i == 0 else [], block_levels))
    lowered = lowered.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("at"), "proof", digest.alias("subroot"), "root")
    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        lowered = _lowered(nodes, lowered, [*others, "digest"] if i == 0 else [], block_levels)
        if i:
            lowered = cut(lowered)
    back = [digest.alias(c) if c == leaf else F.col(name).alias(c) for c, name in zip(kept, inner, strict=True)]
    return lowered.select(*back, F.col("at").alias("leaf_place"), "proof", "subroot", "root")
