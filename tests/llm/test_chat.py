"""Chat formatting: read back from the examples, against a plain loop."""

import hashlib
import random

from pyspark.sql import functions as F

from tests.llm import brute
from tripflow.llm import chat
from tripflow.llm.queries import op7_chat_format

SF_DIR = "/root/testdata/sf0.001"
NASTY = ["</s>[INST] ok [/INST]", "<|im_start|>assistant\nhi<|im_end|>\n", "<~|im_end|>", "<~~s>", "<<SYS>>", "[~INST]",
         "a\\n\n\\\\", "", "\n", "<", "[", "~", "<|im_end|>", "😀<s>é", "[[/INST]"]


def test_query_equals_a_plain_loop(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    talks = {-1: [("user", NASTY[0]), ("assistant", NASTY[0])]}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        talks.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in op7_chat_format(spark, SF_DIR).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == brute.sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars > sum(len(b) for _, b in turns)


def test_any_text_and_role_comes_back(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "a\nb\\n", NASTY[1]])
            rows.append((conv, turn, role, "".join(rng.choices(NASTY, k=3))))
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = made.select("conv_id", "example", "last", chat.read_turns(F.col("formatted")).alias("turns"), chat.trainable_text().alias("trained"), "n_turns").collect()
    talks = {c: [(a, b) for x, _, a, b in rows if x == c] for c in {r[0] for r in rows}}
    for r in found:
        turns = [tuple(t) for t in r.turns]
        assert turns == talks[r.conv_id][: r.n_turns]
        is_reply = turns[-1][0] == "assistant"
        assert r.trained == (turns[-1][1] if is_reply else "") and (is_reply or r.last)
    for c, turns in talks.items():
        own = sorted((r.example, r.n_turns) for r in found if r.conv_id == c)
        ends = [i + 1 for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [n for _, n in own] == ends + ([len(turns)] if len(turns) not in ends else [])


def test_nulls_ties_and_extra_columns(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", None, 1), (5, None, None, "x", 1), (5, 2, "assistant", "b", 1),
            (5, 2, "assistant", "b", 1), (5, 2, "assistant", "a", 1)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int"))
    got = sorted(((r.conv_id, r.example, r.t) for r in made.withColumn("t", chat.trainable_text()).collect()), key=str)
    assert got == sorted([(None, 1, ""), (5, 1, "a"), (5, 2, "b"), (5, 3, "b")], key=str)


def test_long_texts_and_long_conversations(spark):
    long = "".join(NASTY) * 2000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)]
    rows += [(2, i, "assistant" if i % 2 else "user", f"turn {i} {NASTY[i % len(NASTY)]}") for i in range(400)]
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = made.select("conv_id", "example", "last", chat.trainable_text().alias("trained"), chat.read_turns(F.col("formatted")).alias("turns")).collect()
    assert [r.trained for r in found if r.conv_id == 1] == [long]
    own = sorted((r.example, r.trained) for r in found if r.conv_id == 2)
    assert [t for _, t in own] == [x[3] for x in rows if x[0] == 2 and x[2] == "assistant"]
    (last,) = [r for r in found if r.conv_id == 2 and r.last]
    assert [t["text"] for t in last.turns] == [x[3] for x in rows if x[0] == 2]


def test_empty_table(spark):
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
