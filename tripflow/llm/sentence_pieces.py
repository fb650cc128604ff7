"""SentencePiece: texts to token ids and back.

Where no piece of a model goes on behind a white-space marker that follows
something else, texts may be cut before the first marker of each such group:
nothing ever merges across. Each distinct marked word is then segmented once
and kept in a table with its ids, and the ids of a text are gathered from the
table by the positions of its words. Models for which that would not give the
library's ids are refused (`checked_model`).

Spark partitions the texts and nothing is shuffled: a worker's table serves all
texts of its tasks and starts anew when it outgrows its bounds, so distinct words
are segmented once per worker at most while they stay in use.

A null text is an empty text: no ids, empty when decoded. Repeated rows give
repeated results, an empty table an empty one. Columns that already carry a name
of the output are replaced. Null ids are empty; unknown ids are an error.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tripflow.llm.common import byte_slices, text_or_empty, without
from tripflow.llm.word_table import WordTable, offsets

MARKER = "▁"
_MARKED = re.compile(r" +[^ ]*")


@lru_cache(maxsize=2)
def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def checked_model(path: str) -> bytes:
    """A model file whose texts may be cut before white-space markers; an error for others.

    Pieces must not hold a marker behind another character, and normalisation must
    put a marker before the text, turn spaces into markers and change nothing else.
    """
    model = Path(path).read_bytes()
    pieces = _processor(model)
    if any(re.search(f"[^{MARKER}]{MARKER}", pieces.id_to_piece(i)) for i in range(pieces.get_piece_size())):
        raise ValueError("the model has pieces that cross white-space markers")
    points = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for probe in ["".join(points), " a  b ", "\t\n a \r\n"]:
        if pieces.normalize(probe) != MARKER + probe.replace(" ", MARKER):
            raise ValueError("the model changes texts before it cuts them into pieces")
    if pieces.encode(MARKER) != pieces.encode(" "):
        raise ValueError("the model tells markers from spaces")
    return model


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; further ones are spaces.

    The library puts a marker before every text, so it gives a word back its own.
    """
    if not text:
        return []
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [word[1:] for word in _MARKED.findall(" " + text)]
    return text.split(" ")


class Encoder:
    """Token ids of texts by a table of distinct marked words."""

    def __init__(self, model: bytes):
        self.pieces = _processor(model)
        self.table = WordTable(self._segment)

    def _segment(self, words: list[str]) -> list[list[int]]:
        found = self.pieces.encode(words, out_type=int, num_threads=1)
        # A marker alone would be an empty text to the library.
        return [ids if word else [self.pieces.piece_to_id(MARKER)] for word, ids in zip(words, found, strict=True)]

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids per text)."""
        return self.table([marked_words(text) for text in texts])


def _per_text(ids: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    ends = np.cumsum(counts).tolist()
    flat = ids.tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode(
    docs: DataFrame, model: bytes, text: str = "text", keep: Sequence[str] | None = None, decoded: bool = False
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``n_tokens`` and ``ids``.

    With ``decoded`` the ids are decoded in the same pass, so that one worker
    holds the model once.
    """
    added = ["n_tokens", "ids", *(["decoded"] if decoded else [])]
    kept = [c for c in without(docs, added).columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in byte_slices(batches):
            ids, counts = encoder([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
            new = [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets(counts)), pa.array(ids))]
            if decoded:
                texts = encoder.pieces.decode(_per_text(ids, counts), num_threads=1) if len(counts) else []
                new.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*kept, *added])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text).alias("__text"))
    schema = source.drop("__text").schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType()))
    return source.mapInArrow(run, schema.add("decoded", "string") if decoded else schema)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids, as the library gives it."""
    kept = without(encoded, ["decoded"]).columns
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _processor(shared.value)
        for part in byte_slices(batches):
            lists = [x or [] for x in part.column(part.num_columns - 1).to_pylist()]
            texts = pa.array(pieces.decode(lists, num_threads=1) if lists else [], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*kept, "decoded"])

    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(ids).alias("__ids"))
    return source.mapInArrow(run, source.drop("__ids").schema.add("decoded", "string"))
