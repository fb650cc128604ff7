"""The pipeline's stages on given and on odd documents."""

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from tests.llm import brute
from tripflow.llm import bpe
from tripflow.llm.queries import ranks

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows of every stage, each written and read again."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_schemas_and_counts(stages):
    first = stages["documents"]
    for name, _ in pipeline.STAGES[:-1]:
        assert sorted(stages[name].dtypes) == sorted(first.dtypes)
    assert 0 < stages["quality_classifier"].count() < first.count()


def test_bad_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = set(texts(stages["quality_classifier"]))
    for i in texts(stages["documents"]):
        if i in labels:
            assert (i in kept) == (labels[i] == 1)


def test_line_dedup_equals_brute_force(stages):
    want = {i: t for i, t in brute.line_dedup(texts(stages["quality_classifier"]).items()).items()}
    before, got = texts(stages["quality_classifier"]), texts(stages["line_dedup"])
    assert got == {i: t for i, t in want.items() if t == before[i] or brute.WORD.search(t)}
    assert all(r.n_chars == len(r.text) for r in stages["line_dedup"].collect() if r.text)


def test_one_of_each_group_equals_brute_force(stages):
    groups = brute.near_components(texts(stages["line_dedup"]).items(), pipeline.SHINGLE_WORDS, pipeline.PERCENT)
    assert set(texts(stages["jaccard_join"])) == {i for i, (_, c) in groups.items() if i == c}


def test_mixing_repeats_whole_documents(stages):
    kept, drawn = texts(stages["jaccard_join"]), stages["mixing"].collect()
    assert drawn and all(kept[r.doc_id] == r.text for r in drawn)
    assert len(drawn) > len({r.doc_id for r in drawn})
    # The budget covers every document.
    assert {r.doc_id for r in drawn} == set(kept)


def test_mixing_runs_no_python(spark, stages, monkeypatch):
    from pyspark.sql import DataFrame

    def refused(*_, **__):
        raise AssertionError("Python in the tasks")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(stages["jaccard_join"]), name, refused)
    drawn = pipeline.mixed_sources(spark, stages["jaccard_join"], SF_DIR)
    assert isinstance(drawn, DataFrame) and drawn.count() == stages["mixing"].count()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_estimated_tokens_are_close_to_counted_ones(spark, stages):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._vocabulary(ranks()), special_tokens={})
    rows = stages["jaccard_join"].select("source", "text", pipeline.mixing.text_pieces("text").alias("n")).collect()
    counted = {}, {}
    for r in rows:
        for sums, n in zip(counted, (r.n, len(plain.encode_ordinary(r.text or ""))), strict=True):
            sums[r.source] = sums.get(r.source, 0) + n
    shares = [{k: n / sum(sums.values()) for k, n in sums.items()} for sums in counted]
    assert all(abs(shares[0][k] / share - 1) < 0.05 for k, share in shares[1].items())


@pytest.mark.parametrize("text, pieces", [(None, 0), ("", 0), ("abcdefghi", 3), ("ab  12345, \u00e9\u4e2d\n\n", 9), ("\u00a0\u2003a", 2)])
def test_pieces_cover_every_character(spark, text, pieces):
    (row,) = spark.createDataFrame([(text,)], "text string").select(pipeline.mixing.text_pieces("text")).collect()
    assert row[0] == pieces


def test_ids_equal_tiktoken(stages):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._vocabulary(ranks()), special_tokens={})
    want = {i: plain.encode_ordinary(t or "") for i, t in texts(stages["mixing"]).items()}
    for r in stages["byte_bpe"].collect():
        assert r.round_trip and r.n_tokens == len(want[r.doc_id])
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == want[r.doc_id]


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    columns = sorted(stages["byte_bpe"].columns)
    want = sorted(map(str, stages["byte_bpe"].select(columns).collect()))
    assert sorted(map(str, pipeline.run(spark, SF_DIR).select(columns).collect())) == want


def test_odd_documents(spark, tmp_path):
    good = "Plain words follow each other here, number {} of them, and a sentence ends with a stop."
    rows = [(i, good.format(f"w{i * 7919} x{i * 104729} y{i}"), "en", "s", None, "own") for i in range(12)]
    rows += [(3, rows[3][1], "en", "s", 5, "own"), (None, None, None, None, None, None), (None, "Some words without an id stand here, all alone.", None, None, None, None), (50, "", "en", "s", 0, "own")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    # Nothing here is bad or a copy, and mixing leaves nothing out.
    assert {r.doc_id for r in got} == {r[0] for r in rows} and all(r.round_trip for r in got)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
