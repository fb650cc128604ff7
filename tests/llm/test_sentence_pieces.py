"""SentencePiece ids and decoded texts against the library on whole texts."""

import random
import sys

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tests.llm import brute
from tripflow.llm import sentence_pieces
from tripflow.llm.queries import PIECE_FILE, op11_sentence_pieces

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_FILE))


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.checked_model(public_tokenizers.path(PIECE_FILE))


def ids_of(encoder, texts):
    ids, counts = encoder(texts)
    return sentence_pieces._per_text(ids, counts)


def test_every_code_point_in_context(library, model):
    encoder = sentence_pieces.Encoder(model)
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 50000):
        texts = [f"a{c}b {c} {c}{c}" for c in points[at : at + 50000]]
        assert ids_of(encoder, texts) == library.encode(texts, num_threads=1)


def test_random_spaces_markers_and_control_strings(library, model):
    rng = random.Random(5)
    parts = [" ", "  ", "   ", "\n", "\t", "\r\n", "\u2581", "\u3000", "\xa0", "a", "the", "==", "é", "日本", "😀",
             "1", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "Hello", "."]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(20000)]
    texts += [c * n for c in "a \u2581=é\n" for n in range(200)]
    assert ids_of(sentence_pieces.Encoder(model), texts) == library.encode(texts, num_threads=1)


def test_a_full_table_starts_anew(library, model):
    encoder = sentence_pieces.Encoder(model)
    encoder.table.most_words = 3
    for _ in range(3):
        texts = ["one two three four five", "six  seven "]
        assert ids_of(encoder, texts) == library.encode(texts)
        assert len(encoder.table.place) == 8


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in docs:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert sorted(map(tuple, op11_sentence_pieces(spark, SF_DIR).collect())) == sorted(want)


def test_nulls_repeats_long_texts_and_clashing_names(spark, library, model):
    long = "x" * 200_000 + " " + "ab  cd\n" * 100_000
    rows = [(1, None, "mine"), (1, None, "mine"), (None, "", "mine"), (2, long, None), (3, " naïve\u2581 😀 ", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = sentence_pieces.decode(sentence_pieces.encode(docs, model), model)
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    got = out.collect()
    assert len(got) == 5
    for r in got:
        assert r.ids == library.encode(r.text or "") and r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids)
    both = sentence_pieces.encode(docs, model, keep=["doc_id"], decoded=True)
    assert both.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(map(str, both.collect())) == sorted(str(r) for r in out.select(both.columns).collect())


def test_null_ids_and_empty_table(spark, model):
    assert sentence_pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), model).first().decoded == ""
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentence_pieces.decode(sentence_pieces.encode(empty, model), model).count() == 0


def test_a_model_whose_pieces_cross_markers_is_refused(model, monkeypatch):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "of\u2581the"

    monkeypatch.setattr(sentence_pieces, "_processor", lambda _: Crossing())
    with pytest.raises(ValueError, match="cross"):
        sentence_pieces.checked_model(public_tokenizers.path(PIECE_FILE))
