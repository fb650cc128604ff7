"""Periodic runs of a text's words: the maximal stretches that repeat a period at least twice.

A run is found from its root. By the runs theorem the smallest period of a run is
the length of a Lyndon word that starts inside it, for the order of the words or
for its reverse. So the longest Lyndon words of all starts, for both orders, are
candidates; each is extended as far as the text goes on with the same period, to
the right by the longest common extension (LCE) of two suffixes and to the left by
that of two prefixes. An LCE is the depth of the lowest common ancestor in a
suffix tree, one of the words and one of the words in reverse (Ukkonen's
construction), read off an Euler tour in constant time by range minima. Suffix
ranks for the Lyndon words come from the same tree.

Only stretches that can hold a run get trees: with ``min_length`` 2k, every word of
a run lies in a sequence of k words that the text holds twice. Words outside such
sequences are cut away first, with sequences told apart by hash (a collision lets
more words through). A text without a repeated sequence has no tree at all.

Spark partitions the texts and nothing is shuffled; a task holds the trees of one
stretch, so memory grows with the longest repetitive text, not with the corpus.
Null and empty texts and texts without words have no run and stay without words.
Repeated rows give repeated results, an empty table gives an empty one. Columns
that carry a name of the output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tripflow.llm.common import text_or_empty, without

MIN_LENGTH = 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Rows of one output batch, so that results of long texts leave the worker in time.
_ROWS_OUT = 64


def numbered(words: list) -> np.ndarray:
    """Words as numbers; equal words have equal numbers."""
    known = dict.fromkeys(words)
    known = dict(zip(known, range(len(known)), strict=True))
    return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


class SuffixTree:
    """Ukkonen's suffix tree of a number sequence, with a closing symbol smaller than all.

    ``start`` and ``end`` are the edge into a node; an edge into a leaf has no
    end. Edges are found in one dictionary by node and first symbol.
    """

    def __init__(self, symbols: list[int]):
        text = [s + 1 for s in symbols] + [0]
        self.size, self.base = len(text), max(text) + 1
        base = self.base
        open_end = 1 << 60
        start, end, link, children = [0], [0], [0], {}
        node = edge = length = waiting = 0  # active point and suffixes not yet in the tree
        for i, symbol in enumerate(text):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = children.get(key)
                if child is None:
                    children[key] = len(start)
                    start.append(i)
                    end.append(open_end)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    span = (end[child] if end[child] < i + 1 else i + 1) - start[child]
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    if text[start[child] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    fork = len(start)
                    start.append(start[child])
                    end.append(start[child] + length)
                    link.append(0)
                    children[key] = fork
                    children[fork * base + symbol] = fork + 1
                    start.append(i)
                    end.append(open_end)
                    link.append(0)
                    start[child] += length
                    children[fork * base + text[start[child]]] = child
                    if last:
                        link[last] = fork
                    last = fork
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start = np.array(start, dtype=np.int64)
        self.end = np.minimum(np.array(end, dtype=np.int64), self.size)
        keys = np.fromiter(children, dtype=np.int64, count=len(children))
        order = np.argsort(keys)
        self.parents = keys[order] // base
        self.kids = np.fromiter(children.values(), dtype=np.int64, count=len(children))[order]
        self._tour()

    def _tour(self) -> None:
        """Euler tour: depths in the order of the visits, and the first visit of each suffix's leaf."""
        n = len(self.start)
        spans = (self.end - self.start).tolist()
        bounds = np.searchsorted(self.parents, np.arange(n + 1)).tolist()
        kids = self.kids.tolist()
        visits, leaf_at, leaves = [0], [0] * self.size, []
        stack = [(bounds[0], bounds[1], 0)]
        while stack:
            at, stop, depth = stack.pop()
            if at == stop:
                if stack:
                    visits.append(stack[-1][2])
                continue
            stack.append((at + 1, stop, depth))
            kid = kids[at]
            below = depth + spans[kid]
            if bounds[kid] == bounds[kid + 1]:
                suffix = self.size - below
                leaf_at[suffix] = len(visits)
                leaves.append(suffix)
                visits.append(below)
                visits.append(depth)
            else:
                visits.append(below)
                stack.append((bounds[kid], bounds[kid + 1], below))
        self.leaf_at = np.array(leaf_at, dtype=np.int64)
        self.leaves = np.array(leaves, dtype=np.int64)
        self.minima = [np.array(visits, dtype=np.int32)]
        width = 1
        while 2 * width <= len(visits):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, for different i and j."""
        one, other = self.leaf_at[i], self.leaf_at[j]
        low, high = np.minimum(one, other), np.maximum(one, other)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out

    def ranks(self, reverse: bool) -> np.ndarray:
        """Rank of each suffix; in reverse order of symbols, with a suffix still before what it begins."""
        order = self._leaves_reversed() if reverse else self.leaves
        rank = np.empty(self.size, dtype=np.int64)
        rank[order] = np.arange(self.size)
        return rank[:-1]

    def _leaves_reversed(self) -> np.ndarray:
        """Leaves in tree order with each node's edges reversed but for the closing symbol, which stays first."""
        bounds = np.searchsorted(self.parents, np.arange(len(self.start) + 1))
        first, stop = bounds[self.parents], bounds[self.parents + 1]
        closing = self.start[self.kids] == self.size - 1
        kept = np.zeros(len(self.start), dtype=np.int64)
        kept[self.parents[closing]] = 1
        turned = np.where(closing, first, first + kept[self.parents] + stop - 1 - np.arange(len(self.kids)))
        kids = np.empty_like(self.kids)
        kids[turned] = self.kids
        kids, limits, spans = kids.tolist(), bounds.tolist(), (self.end - self.start).tolist()
        out, stack = [], [(0, 0)]
        while stack:
            node, depth = stack.pop()
            low, high = limits[node], limits[node + 1]
            if low == high:
                out.append(self.size - depth)
            else:
                stack.extend([(kid, depth + spans[kid]) for kid in kids[low:high][::-1]])
        return np.array(out, dtype=np.int64)


def lyndon_lengths(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each start: up to the next suffix of smaller rank."""
    ranks = rank.tolist()
    n = len(ranks)
    ends, stack = [n] * n, []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            ends[stack.pop()] = i
        stack.append(i)
    return np.array(ends, dtype=np.int64) - np.arange(n)


def runs_of(symbols: np.ndarray, min_length: int) -> np.ndarray:
    """(start, length, period) rows of all runs of at least ``min_length`` symbols, by start and period."""
    n = len(symbols)
    if n < max(2, min_length):
        return np.empty((0, 3), dtype=np.int64)
    forward, backward = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    found = []
    for reverse in (False, True):
        period = lyndon_lengths(forward.ranks(reverse))
        i = np.arange(n)
        j = i + period
        right, left = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(j < n)
        right[inside] = forward.common(i[inside], j[inside])
        # Symbols before i and before j, from there backwards.
        inside = np.flatnonzero((i > 0) & (j <= n))
        left[inside] = backward.common(n - i[inside], n - j[inside])
        start, length = i - left, left + period + right
        fits = length >= np.maximum(min_length, 2 * period)
        found.append(np.stack([start, length, period], axis=1)[fits])
    return np.unique(np.concatenate(found), axis=0)


def repeated_stretches(symbols: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[start, end) of the words that lie in a sequence of ``width`` words found twice or more."""
    n = len(symbols) - width + 1
    if n < 2:
        return []
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        mixed = (mixed ^ symbols[k : n + k].astype(np.uint64)) * _ODD
        mixed ^= mixed >> np.uint64(32)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return []
    held = np.zeros(n, dtype=np.int64)
    held[order[1:][same]] = 1
    held[order[:-1][same]] = 1
    change = np.zeros(len(symbols) + 1, dtype=np.int64)
    change[:n] += held
    change[width:] -= held[: len(symbols) + 1 - width]
    covered = np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int64), [0]])
    edges = np.flatnonzero(np.diff(covered))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs_in(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) rows of the runs of a text, by start and period."""
    found = []
    for start, end in repeated_stretches(symbols, min_length // 2):
        runs = runs_of(numbered(symbols[start:end].tolist()), min_length)
        found.append(runs + [start, 0, 0])
    rows = np.concatenate(found) if found else np.empty((0, 3), dtype=np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words less those that a run holds behind its first period, joined by spaces."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change)[:-1] > 0
    return b" ".join([words[i] for i in np.flatnonzero(~dropped).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed``.

    ``runs`` has (start, length, period) in words, by start and period: every
    stretch of ``min_length`` words or more, twice its smallest period or more,
    that cannot be made longer. ``collapsed`` is the text's words joined by
    single spaces, without those behind the first period of any run.
    """
    if min_length < 4 or min_length % 2:
        raise ValueError("min_length must be even and 4 at least")
    kept = without(docs, ["runs", "collapsed"]).columns
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text).cast("binary").alias("__text"))
    passed = source.drop("__text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(begin, _ROWS_OUT)
                found, collapsed = [], []
                for data in part.column(part.num_columns - 1).to_pylist():
                    words = data.split()
                    runs = runs_in(numbered(words), min_length)
                    found.append(runs)
                    collapsed.append(_collapsed(words, runs))
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                rows = np.concatenate(found)
                fields = [pa.array(rows[:, c].copy()) for c in range(3)]
                structs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets), structs)
                texts = pa.array(collapsed, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, texts], names=[*kept, "runs", "collapsed"])

    one = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
    return source.mapInArrow(run, passed.add("runs", ArrayType(one)).add("collapsed", "string"))
