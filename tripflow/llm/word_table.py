"""Token ids of texts that a tokenizer may cut into words, each distinct word encoded once."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches [start, start + size) of ``values``, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """``data`` in binary values of so many elements each."""
    place = offsets(counts * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(data))])


class WordTable:
    """Ids of distinct words on end, and where each word's ids lie.

    The table starts anew when it outgrows its bounds. They bound memory only:
    ids never depend on them.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int]]], words: int = 300_000, chars: int = 1 << 24):
        self.encode, self.most_words, self.most_chars = encode, words, chars
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.starts, self.sizes, self.chars = array("i"), array("q"), array("q"), 0

    def __call__(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids per text) of texts given as words."""
        if len(self.place) > self.most_words or self.chars > self.most_chars:
            self._clear()
        words = [word for of_text in split for word in of_text]
        new = [word for word in dict.fromkeys(words) if word not in self.place]
        if new:
            for word, ids in zip(new, self.encode(new), strict=True):
                self.place[word] = len(self.starts)
                self.starts.append(len(self.ids))
                self.sizes.append(len(ids))
                self.ids.extend(ids)
                self.chars += len(word)
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        if not words:
            return np.empty(0, dtype=np.int32), np.zeros(len(split), dtype=np.int64)
        # Views of the arrays; they are gone before the arrays grow again.
        table = np.frombuffer(self.ids, dtype=np.int32) if self.ids else np.empty(0, dtype=np.int32)
        starts, sizes = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.sizes, dtype=np.int64)
        size = sizes[at]
        ids = gathered(table, starts[at], size)
        upto = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)
