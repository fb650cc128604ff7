"""Line dedup against comparing every line with all earlier ones."""

import hashlib
import random

from tests.llm import brute
from tripflow.llm import line_dedup
from tripflow.llm.queries import op10_line_dedup

SF_DIR = "/root/testdata/sf0.001"


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in brute.line_dedup(docs).items()}
    got = op10_line_dedup(spark, SF_DIR).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == want
    assert sum(r.n_dropped for r in got) > 0


def test_edits_of_all_kinds(spark):
    rng = random.Random(2)
    lines = ["".join(rng.choices("ab c", k=rng.randrange(8, 16))) for _ in range(300)]
    for _ in range(300):
        x = list(rng.choice(lines))
        at = rng.randrange(len(x))
        edit = rng.randrange(4)
        if edit == 0:
            x[at] = rng.choice("abcé😀")
        elif edit == 1:
            x.insert(at, rng.choice("abcé😀"))
        elif edit == 2:
            del x[at]
        lines.append("".join(x))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[10 * i : 10 * i + 10])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert got == brute.line_dedup(docs)


def test_odd_texts_repeats_and_clashing_names(spark):
    line = "the same line again"
    long = "z" * 50_000
    rows = [(1, None), (2, ""), (3, f"{line}\n\nshort\nshort\n{line}"), (4, f"{line}!\n{long}"), (4, f"{line}!\n{long}"),
            (6, f"{long}y\nx\n"), (None, f"{line}\nonly here stands this"), (7, "only here stands this\n")]
    df = spark.createDataFrame([(i, t, "own", "k") for i, t in rows], "doc_id long, text string, n_lines string, variant string")
    got = line_dedup.line_dedup(df)
    assert got.columns == ["doc_id", "text", "variant", "n_lines", "n_dropped"]
    want = [(1, None, 0, 0), (2, "", 1, 0), (3, f"{line}\n\nshort\nshort", 5, 1), (4, long, 2, 1), (4, long, 2, 1),
            (6, "x\n", 3, 1), (None, "", 2, 2), (7, "only here stands this\n", 2, 0)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in got.collect())


def test_empty_table(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
