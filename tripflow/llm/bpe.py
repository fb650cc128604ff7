"""Byte-level BPE: texts to token ids with character offsets, and back to bytes.

The merges come from a rank file. The `tokenizers` library runs inside Arrow
batches; Spark partitions the texts and nothing is shuffled.

A null text is an empty text: no ids, no offsets, empty bytes. Long texts are
cut only where a match of the pattern ends anyway, so ids do not depend on any
chunking. Repeated rows give repeated results, an empty table an empty one.
Columns that already carry a name of the output are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tripflow.llm.common import byte_slices, text_or_empty, without
from tripflow.llm.word_table import WordTable, binaries, gathered

# Python's \S leaves out every character the patterns may take for white space.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_SPACES_MEET = re.compile(r"\s ")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for code points from 256 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> bytes:
    """A rank file: one base64 token and its rank per line. Vocabularies are of fixed size."""
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def _vocabulary(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str):
    """A `tokenizers` BPE with the merges the ranks imply.

    Any two known parts whose join is a token may merge, at the token's rank.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    known, shown = _vocabulary(ranks), byte_characters()

    def name(token: bytes) -> str:
        return "".join([shown[b] for b in token])

    merges = []
    for token in sorted(known, key=known.get):
        for k in range(1, len(token)):
            if token[:k] in known and token[k:] in known:
                merges.append((name(token[:k]), name(token[k:])))
    model = models.BPE(vocab={name(t): i for t, i in known.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made


def words_of(text: str) -> list[str]:
    """Cut before each space that follows something else: a match always ends there."""
    if _SPACES_MEET.search(text):
        return _BEFORE_SPACE.split(text)
    first, *rest = text.split(" ")
    words = [first] if first else []
    words += [" " + word for word in rest]
    return words


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: bytes, pattern: str):
        model = tokenizer(ranks, pattern)
        self.table = WordTable(lambda words: [e.ids for e in model.encode_batch_fast(words, add_special_tokens=False)])

    def on_end(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids per text)."""
        return self.table([words_of(text) for text in texts])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.on_end(texts)
        return [part.astype("<u4").tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@lru_cache(maxsize=2)
def _byte_table(ranks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens on end, where each id's bytes start, their number)."""
    known = _vocabulary(ranks)
    tokens = [b""] * (max(known.values(), default=-1) + 1)
    for token, i in known.items():
        tokens[i] = token
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _decoded(ids: np.ndarray, counts: np.ndarray, ranks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, number of bytes per text)."""
    data, starts, sizes = _byte_table(ranks)
    ends = np.concatenate([[0], np.cumsum(sizes[ids])])
    return gathered(data, starts[ids], sizes[ids]), np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


def character_starts(text: str, ids: bytes, sizes: np.ndarray) -> bytes:
    """For each token the code point its first byte belongs to, packed like the ids.

    A token that begins inside a character starts at that character.
    """
    tokens = np.frombuffer(ids, dtype="<u4")
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    first_byte = np.cumsum(sizes[tokens]) - sizes[tokens]
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return character[first_byte].astype("<u4").tobytes()


def encode(
    docs: DataFrame,
    ranks: bytes,
    pattern: str,
    text: str = "text",
    offsets: bool = False,
    keep: Sequence[str] | None = None,
    decoded: bool = False,
    checked: bool = False,
    ids: bool = True,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``n_tokens`` and ``ids``.

    ``ids`` is binary: little-endian unsigned 32-bit integers, one per token.
    Special tokens are ordinary text. On request come ``char_starts``, packed
    alike; ``decoded``, the bytes of the ids; and ``round_trip``, whether those
    are the text's. One pass does it all, so a core holds one vocabulary. Without
    ``ids`` texts are only counted.
    """
    added = {"n_tokens": "long"} | ({"ids": "binary"} if ids else {})
    asked = {"char_starts": ("binary", offsets), "decoded": ("binary", decoded), "round_trip": ("boolean", checked)}
    added |= {name: kind for name, (kind, wanted) in asked.items() if wanted}
    kept = [c for c in without(docs, list(added)).columns if keep is None or c in keep]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for part in byte_slices(batches):
            texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
            found, counts = encoder.on_end(texts)
            new = [pa.array(counts, pa.int64()), *([binaries(found.astype("<u4"), counts)] if ids else [])]
            if offsets:
                sizes = _byte_table(shared.value)[2]
                parts = np.split(found, np.cumsum(counts)[:-1])
                starts = [character_starts(t, i.astype("<u4").tobytes(), sizes) for t, i in zip(texts, parts, strict=True)]
                new.append(pa.array(starts, pa.binary()))
            if decoded or checked:
                data = binaries(*_decoded(found, counts, shared.value))
                same = pc.equal(data, pa.array(texts, pa.string()).cast(pa.binary()))
                new += [data] * decoded + [same] * checked
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=[*kept, *added])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(text).alias("__text"))
    schema = source.drop("__text").schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids, joined before any text is made of them.

    A character split over tokens is whole again once its bytes are joined. Ids
    cut inside a character leave its bytes as they are; `decoded_text` reads
    such bytes as U+FFFD. Null ids are empty; an unknown id is an error.
    """
    kept = without(encoded, ["decoded", "decoded_text"]).columns
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches):
            packed = [b or b"" for b in part.column(part.num_columns - 1).to_pylist()]
            ids, counts = np.frombuffer(b"".join(packed), dtype="<u4"), np.array([len(b) // 4 for b in packed])
            data = binaries(*_decoded(ids, counts, shared.value))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], data], names=[*kept, "decoded"])

    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(ids).alias("__ids"))
    return source.mapInArrow(run, source.drop("__ids").schema.add("decoded", "binary"))


def decoded_text(column: str = "decoded") -> Column:
    """The text of decoded bytes; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col(column).cast("string"))
