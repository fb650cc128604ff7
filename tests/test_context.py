"""Token-bounded context against row-by-row brute force, and text edge cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripflow.functions import text as txt
from tripflow.functions.times import interval_label
from tripflow.operators import context

LOG = "agent_id long, idx long, time timestamp_ntz, tags array<string>, text string"
START = datetime(2024, 1, 1)


def entry(agent, idx, text, tag="note"):
    return (agent, idx, START + timedelta(minutes=idx), [tag] if tag else None, text)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG).repartition(5)


def random_log(seed):
    rng = random.Random(seed)
    rows = []
    for agent, size in ((1, 400), (2, 60), (3, 9), (4, 1), (5, 25)):
        for idx in range(size):
            tag = rng.choice(["note", "note", None, "ScenarioUnderstanding", ""])
            length = rng.choice([0, 3, 10, 18, 30, 60, 200, 900])
            rows.append(entry(agent, idx, None if length == 3 else "x" * length, tag))
    rows.append(entry(6, 0, "only records", "SelfUnderstanding"))
    return rows


def plain_logs(rows):
    logs = {}
    for agent, idx, _, tags, text in sorted(rows, key=lambda r: (r[0], r[1])):
        if not tags or tags[0] not in context.MARKERS:
            logs.setdefault(agent, []).append((idx, round(len(text or "") / 4)))
    return logs


def suffixes(log):
    total, out = 0, []
    for idx, tokens in reversed(log):
        total += tokens
        out.append((idx, tokens, total))
    return out[::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_sums_and_budget_equal_brute_force(spark, seed):
    rows = random_log(seed)
    log = frame(spark, rows)
    want = {(a, *s) for a, l in plain_logs(rows).items() for s in suffixes(l)}
    got = context.token_suffix_sum(log).select("agent_id", "idx", "tokens", "suffix_tokens")
    assert {tuple(r) for r in got.collect()} == want
    kept = context.token_budget(log, 300, 2).select("agent_id", "idx").collect()
    assert {tuple(r) for r in kept} == {(a, i) for a, i, t, s in want if s <= 300 and t > 2}


@pytest.mark.parametrize("budget", [600, 40, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_adaptive_tail_equals_brute_force(spark, seed, budget):
    rows = random_log(seed)
    want = set()
    for agent, log in plain_logs(rows).items():
        fit = sum(s <= budget and t > 5 for _, t, s in suffixes(log))
        keep = sorted([fit, 10, int(len(log) * 0.1)])[1]
        want |= {(agent, i) for i, _ in [x for x in log if x[1] > 5][-keep:]}
    got = context.adaptive_tail(frame(spark, rows), budget=budget)
    assert {tuple(r) for r in got.select("agent_id", "idx").collect()} == want


def test_a_last_row_over_budget_leaves_nothing_and_tail_zero_keeps_all(spark):
    rows = [entry(1, 0, "x" * 40), entry(1, 1, "y" * 40000)]
    log = frame(spark, rows)
    assert context.token_budget(log).count() == 0
    assert context.adaptive_tail(log).count() == 2


def test_empty_log_gives_no_rows(spark):
    log = frame(spark, [])
    for job in (context.token_budget, context.adaptive_tail, context.latest_by_tag, context.last_entries):
        assert job(log).count() == 0
    assert context.context_text(context.token_budget(log)).count() == 0


def test_context_text_and_span_follow_the_log_order(spark):
    rows = [entry(1, i, f"message number {i}") for i in (11, 2, 30)]
    got = context.context_text(context.token_budget(frame(spark, rows))).first()
    assert got.context.split("\n") == [
        "[2024-01-01 00:02:00] message number 2",
        "[2024-01-01 00:11:00] message number 11",
        "[2024-01-01 00:30:00] message number 30",
    ]
    span = context.context_span(frame(spark, rows)).first()
    assert (got.time_start, got.time_end) == (span.time_start, span.time_end) == (
        START + timedelta(minutes=2), START + timedelta(minutes=30))


def test_latest_by_tag_needs_the_marker_in_any_case(spark):
    rows = [
        entry(1, 0, "old <SCENARIO>", "ScenarioUnderstanding"),
        entry(1, 1, "new <Scenario>", "ScenarioUnderstanding"),
        entry(1, 2, "no marker", "ScenarioUnderstanding"),
        entry(1, 3, "<scenario> under another tag", "note"),
        entry(1, 4, None, "ScenarioUnderstanding"),
    ]
    assert [tuple(r) for r in context.latest_by_tag(frame(spark, rows)).collect()] == [
        (1, "ScenarioUnderstanding", 1, "new <Scenario>")]


def test_tags_may_be_text(spark):
    rows = [(1, 0, START, "('ScenarioUnderstanding', 'a')", "<scenario> x"), (1, 1, START, None, "y" * 40)]
    log = spark.createDataFrame(rows, LOG.replace("array<string>", "string"))
    assert context.latest_by_tag(log).first().tag == "ScenarioUnderstanding"
    assert [r.idx for r in context.token_budget(log).collect()] == [1]
    (row,) = context.understanding_context(log, ["ScenarioUnderstanding"]).collect()
    assert (row.previous, row.time_start) == ("<scenario> x", START)


def test_a_log_that_one_agent_dominates(spark):
    rows = [entry(1, i, "x" * 40) for i in range(3000)] + [entry(a, 0, "x" * 40) for a in range(2, 900)]
    log = frame(spark, rows)
    kept = context.token_budget(log, 250, 2)
    assert kept.filter("agent_id = 1").count() == 25 and kept.count() == 25 + 898
    tail = context.adaptive_tail(log, 250)
    assert tail.filter("agent_id = 1").count() == 25


def test_last_entries(spark):
    rows = [entry(1, i, "t") for i in range(8)] + [entry(2, 0, "t")]
    got = {(r.agent_id, r.idx, r.rank) for r in context.last_entries(frame(spark, rows)).collect()}
    assert got == {(1, 7 - k, k + 1) for k in range(5)} | {(2, 0, 1)}


def test_written_token_counts_are_used_as_they_are(spark):
    log = frame(spark, [entry(1, 0, "x" * 40)])
    assert context.tagged(log.withColumn("tokens", F.lit(99))).first().tokens == 99


@pytest.mark.parametrize("length", [0, 1, 2, 3, 6, 10, 14, 17])
def test_token_estimate(spark, length):
    got = spark.range(1).select(txt.token_estimate(F.lit("é" * length))).first()[0]
    assert got == round(length / 4)


@pytest.mark.parametrize(
    "tags, tag",
    [("('A', 'x')", "A"), ("A", "A"), (None, ""), ("", ""), ("('A',)", "A"), ("(A, B)", "A")],
)
def test_tag_text(spark, tags, tag):
    df = spark.createDataFrame([(tags,)], "t string")
    assert df.select(txt.clean_tag(F.col("t"))).first()[0] == tag


@pytest.mark.parametrize(
    "record, want",
    [
        ("[S] [1 Jan - 2 Jan]: <b> body ", "Based on observations in the timeframe 1 Jan - 2 Jan\n<b> body"),
        ("no parts at all", "no parts at all"),
        ("[only one]: body", "[only one]: body"),
        ("[S] [a]: one ]: two", "Based on observations in the timeframe a\none"),
        (None, None),
    ],
)
def test_labelled_records(spark, record, want):
    df = spark.createDataFrame([(record,)], "t string")
    assert df.select(txt.split_record(F.col("t"))).first()[0] == want


def test_section_prefix_is_taken_out(spark):
    title, prefix = context.SECTIONS[1]
    assert prefix.endswith("\n: ")
    log = spark.createDataFrame(
        [(1, 0, datetime(2024, 1, 1), ["SelfUnderstanding"], ": <selfunderstanding> calm", )],
        "agent_id long, idx long, time timestamp_ntz, tags array<string>, text string",
    )
    config = spark.createDataFrame(
        [(1, "ann", "Overarching motivation: go", "Current time: noon", {})],
        "agent_id long, name string, motivation string, report string, extras map<string,string>",
    )
    now = F.lit(datetime(2024, 1, 1, 12)).cast("timestamp_ntz")
    (row,) = context.agent_context(log, config, now).collect()
    assert row.context == "# <selfunderstanding> calm"


def test_a_null_tag_column_keeps_its_rows(spark):
    log = spark.createDataFrame(
        [(1, 0, datetime(2024, 1, 1), None, "some text", None)],
        "agent_id long, idx long, time timestamp_ntz, tags array<string>, text string, tag string",
    )
    assert context.messages(log).count() == 1


def test_text_after_a_label(spark):
    df = spark.createDataFrame([("x Current time:  noon ",), ("none",)], "t string")
    got = [r[0] for r in df.select(txt.after_label(F.col("t"), "Current time: ")).collect()]
    assert got == ["noon", None]


@pytest.mark.parametrize("hours", [4, 20])
def test_interval_label(spark, hours):
    end = datetime(2024, 3, 5, 12, 30, 1)
    start = end - timedelta(hours=hours)
    if hours == 4:
        want = start.strftime("%d %b %Y [%H:%M:%S  ") + end.strftime("- %H:%M:%S]: ")
    else:
        want = start.strftime("[%d %b %Y %H:%M:%S  ") + end.strftime("- %d %b %Y  %H:%M:%S]: ")
    df = spark.createDataFrame([(start, end)], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(interval_label(F.col("a"), F.col("b"))).first()[0] == want


NUMBERS = ["1", " 2.5 ", "1_0", "1__0", "_1", "1e3", ".5", "5.", "-3", "+4", "1d", "2f", "0x1", "", "abc",
           "inf", "-Infinity", "1e", "1.2.3", "12 apples"]


@pytest.mark.parametrize("raw", NUMBERS)
def test_numbers_are_read_as_python_reads_them(spark, raw):
    try:
        want = float(raw)
    except ValueError:
        want = 0.0
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(txt.number_or_zero(F.col("t"))).first()[0] == want


def test_answers(spark):
    rows = [
        (1, "Ann", "FREE", "takes the bus </a> more", None),
        (2, "Ann", "CHOICE", "1", ["no", "yes"]),
        (3, "Ann", "CHOICE", "7", ["no", "yes"]),
        (4, "Ann", "FLOAT", "nope", None),
        (5, "Ann", "FREE", None, None),
    ]
    df = spark.createDataFrame(
        rows, "id long, name string, output_type string, raw string, options array<string>"
    )
    got = {r.id: (r.answer_text, r.answer_number) for r in context.normalise_answers(df).collect()}
    assert got == {1: ("Ann takes the bus ", None), 2: ("yes", None), 3: (None, None),
                   4: (None, 0.0), 5: (None, None)}


def test_agent_context_leaves_absent_sections_out(spark):
    rows = [
        entry(1, 0, "[ScenarioUnderstanding] [a - b]: <Scenario> x", "ScenarioUnderstanding"),
        entry(1, 1, "a message long enough to stay ```"),
    ]
    config = spark.createDataFrame(
        [
            (1, "ann", "Overarching motivation:  win ", "Current time: noon ", {}),
            (2, "bob", "none", None, {"initial_endowment": "5"}),
        ],
        "agent_id long, name string, motivation string, report string, extras map<string,string>",
    )
    now = F.lit("2024-01-02 03:00:00").cast("timestamp_ntz")
    got = {r.agent_id: r for r in context.agent_context(frame(spark, rows), config, now).collect()}
    assert got[1].context == (
        "# Scenario Understanding\nBased on observations in the timeframe a - b\n<Scenario> x\n\n"
        "# Most Recent Observations\n[2024-01-01 00:01:00] a message long enough to stay \n"
    )
    assert (got[1].agent_name, got[1].motivation, got[1].current_time) == ("Ann", "win", "noon")
    assert got[1].endowment == "No information provided"
    assert (got[2].motivation, got[2].current_time) == (None, None)
    assert (got[2].context, got[2].endowment, got[2].time_start) == ("", "5", None)
