"""Token-bounded context from large message logs, for all agents at once.

A log has agent_id, idx (position in the agent's log, unique, any spacing),
time, tags (array) and text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from tripflow.functions.text import (
    after_label,
    clean_tag,
    contains_ignore_case,
    first_tag,
    number_or_zero,
    section,
    split_record,
    token_estimate,
)
from tripflow.functions.times import interval_label, stamp
from tripflow.operators import prefix
from tripflow.operators.skew import join_on_hot_keys
from tripflow.operators.topn import top_per_group

# Tags of derived records, each with the marker its text must hold.
MARKERS = {
    "ScenarioUnderstanding": "<scenario>",
    "ParticipantUnderstanding": "<participant>",
    "SelfUnderstanding": "<selfunderstanding>",
    "ThoughtProcessForAction": "ThoughtProcessForAction",
}
UNDERSTANDINGS = ("ScenarioUnderstanding", "ParticipantUnderstanding", "SelfUnderstanding")
# Section titles, and what is taken out of a section where a record repeats it.
SECTIONS = (
    ("# Scenario Understanding", "Scenario Understanding\n: "),
    ("# Participant Understanding", "Participants Understanding\n: "),
    ("# Self Understanding", "Self Understanding\n: "),
    ("# Guidance from Trusted Advisor", "Guidance from Trusted Advisor\n: "),
)
RECENT_TITLE = "# Most Recent Observations"
NO_ENDOWMENT = "No information provided"


def tagged(log: DataFrame) -> DataFrame:
    """Log rows with their first tag and token estimate.

    Tags may be an array or tuple-like text. Columns a log already has are kept:
    writing ``tagged(log)`` once spares later jobs from reading the texts to
    count them.
    """
    is_text = isinstance(log.schema["tags"].dataType, StringType)
    tag = clean_tag(F.col("tags")) if is_text else first_tag(F.col("tags"))
    derived = {"tag": tag, "tokens": token_estimate(F.col("text"))}
    return log.withColumns({k: v for k, v in derived.items() if k not in log.columns})


def messages(log: DataFrame) -> DataFrame:
    """Rows that are no derived records; rows without a tag stay."""
    return tagged(log).filter(~F.coalesce("tag", F.lit("")).isin(*MARKERS))


def _dealt(log: DataFrame) -> DataFrame:
    """Positions and token counts of all messages, in ranges of (agent, position)."""
    return prefix.dealt(messages(log).select("agent_id", "idx", "tokens"), ["agent_id"], ["idx"])


def token_suffix_sum(log: DataFrame) -> DataFrame:
    """Tokens of each message and all later ones of its agent.

    A log is summed in ranges of its own positions, whatever their spacing:
    totals per range first, then the running sum inside a range on top of the
    totals after it. A single agent may own most rows.
    """
    return prefix.suffix_sums(_dealt(log), ["agent_id"], {"suffix_tokens": F.col("tokens")}).select(
        "agent_id", "idx", "tokens", "suffix_tokens"
    )


def _from_position(log: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Messages from their agent's position ``from_idx`` on; all where it is null.

    One position per agent decides, so texts need no window: they stay where
    they are if the positions are few, and a hot agent's rows are split if not.
    """
    near = F.col("from_idx").isNull() | (F.col("idx") >= F.col("from_idx"))
    return join_on_hot_keys(messages(log), cutoffs, ["agent_id"]).filter(near).drop("from_idx")


def token_budget(log: DataFrame, budget: int = 2500, min_tokens: int = 2) -> DataFrame:
    """The newest messages that fit the budget together; short ones count but are left out.

    The sums run over positions and token counts alone.
    """
    fitting = token_suffix_sum(log).filter(F.col("suffix_tokens") <= budget)
    cutoffs = fitting.groupBy("agent_id").agg(F.min("idx").alias("from_idx"))
    return _from_position(log, cutoffs).filter(F.col("tokens") > min_tokens).select(*tagged(log).columns)


def adaptive_tail(
    log: DataFrame, budget: int = 600, cap: int = 10, share: float = 0.1, min_tokens: int = 5
) -> DataFrame:
    """The newest long messages, as many as the median of three numbers.

    The numbers are: long messages fitting the budget, ``cap``, and ``share``
    of all messages rounded down. A median of 0 keeps every long message.

    Which messages those are is found on positions and token counts alone.
    """
    is_long = F.col("tokens") > min_tokens
    sums = {"suffix_tokens": F.col("tokens"), "back": is_long.cast("long")}
    numbered = prefix.suffix_sums(_dealt(log), ["agent_id"], sums)
    counts = numbered.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("suffix_tokens") <= budget) & is_long).alias("fit")
    )
    fit, part = F.col("fit"), F.floor(F.col("n") * F.lit(share))
    middle = fit + cap + part - F.greatest(fit, F.lit(cap), part) - F.least(fit, F.lit(cap), part)
    kept = counts.select("agent_id", middle.alias("keep"))
    cutoffs = (
        join_on_hot_keys(numbered.filter(is_long), kept, ["agent_id"])
        .groupBy("agent_id")
        .agg(F.min(F.when((F.col("keep") > 0) & (F.col("back") <= F.col("keep")), F.col("idx"))).alias("from_idx"))
    )
    return _from_position(log, cutoffs).filter(is_long).select(*tagged(log).columns)


def context_line() -> Column:
    return F.concat(
        F.lit("["), stamp(F.col("time")), F.lit("] "), F.coalesce("text", F.lit(""))
    )


def context_span(selected: DataFrame) -> DataFrame:
    """First and last time of each agent's selected messages."""
    return selected.groupBy("agent_id").agg(
        F.min_by("time", "idx").alias("time_start"), F.max_by("time", "idx").alias("time_end")
    )


def context_text(selected: DataFrame) -> DataFrame:
    """Selected messages of each agent as '[time] text' lines in log order.

    Meant for the bounded selections above: the text of one agent is one value.
    """
    return (
        selected.select("agent_id", "idx", "time", context_line().alias("line"))
        .groupBy("agent_id")
        .agg(
            F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY idx)").alias("context"),
            F.min_by("time", "idx").alias("time_start"),
            F.max_by("time", "idx").alias("time_end"),
        )
    )


def latest_by_tag(log: DataFrame, markers: Mapping[str, str] = MARKERS) -> DataFrame:
    """The newest record per agent and tag whose text holds the tag's marker."""
    wanted = F.lit(False)
    for tag, marker in markers.items():
        wanted = wanted | (
            (F.col("tag") == tag) & contains_ignore_case(F.col("text"), marker)
        )
    return (
        tagged(log)
        .filter(wanted)
        .groupBy("agent_id", "tag")
        .agg(F.max("idx").alias("idx"), F.max_by("text", "idx").alias("text"))
    )


def last_entries(log: DataFrame, n: int = 5) -> DataFrame:
    """The n newest rows of each agent; rank 1 is the newest."""
    return top_per_group(log, ["agent_id"], [F.desc("idx")], n)


def understanding_context(
    log: DataFrame,
    tags: Sequence[str] = UNDERSTANDINGS,
    budget: int = 2500,
) -> DataFrame:
    """Per agent and kind of record: the newest such record, the messages within budget, their span.

    The messages are selected once for all kinds. Agents without a message in
    the budget get no row.
    """
    previous = latest_by_tag(log, {tag: MARKERS[tag] for tag in tags}).select(
        "agent_id", "tag", F.col("text").alias("previous")
    )
    recent = context_text(token_budget(log, budget))
    kinds = F.explode(F.array(*[F.lit(tag) for tag in tags])).alias("tag")
    return recent.select("*", kinds).join(previous, ["agent_id", "tag"], "left")


def agent_context(
    log: DataFrame,
    config: DataFrame,
    now: Column,
    window: str = "4 hours",
    budget: int = 600,
) -> DataFrame:
    """One context per agent: latest records, recent messages and configuration.

    ``config`` has agent_id, name, motivation, report (labelled texts) and extras
    (map); every configured agent gets a row. Sections without content are left
    out.
    """
    records = (
        latest_by_tag(log)
        .groupBy("agent_id")
        .agg(*[F.max(F.when(F.col("tag") == tag, F.col("text"))).alias(tag) for tag in MARKERS])
    )
    recent = context_text(adaptive_tail(log, budget=budget))
    start = now - F.expr(f"INTERVAL {window}")
    known = [*[split_record(F.col(tag)) for tag in UNDERSTANDINGS], F.col("ThoughtProcessForAction")]
    body = F.concat_ws(
        "\n\n",
        *[
            F.replace(section(title, text), F.lit(prefix), F.lit(""))
            for (title, prefix), text in zip(SECTIONS, known, strict=True)
        ],
        section(RECENT_TITLE, F.col("context")),
    )
    endowment = F.coalesce(F.col("extras")["initial_endowment"], F.lit(NO_ENDOWMENT))
    return (
        config.join(records, "agent_id", "left")
        .join(recent, "agent_id", "left")
        .select(
            "agent_id",
            F.initcap("name").alias("agent_name"),
            after_label(F.col("motivation"), "Overarching motivation: ").alias("motivation"),
            after_label(F.col("report"), "Current time: ").alias("current_time"),
            endowment.alias("endowment"),
            "time_start",
            "time_end",
            interval_label(start, now).alias("interval_label"),
            F.replace(body, F.lit("```"), F.lit("\n")).alias("context"),
        )
    )


def normalise_answers(answers: DataFrame) -> DataFrame:
    """Raw answers by kind: FREE text up to '<', CHOICE by 0-based index, FLOAT or 0.0.

    ``answers`` has id, name, output_type, raw and options. A choice out of
    range has no text.
    """
    kind, raw = F.col("output_type"), F.col("raw")
    choice = F.get(F.col("options"), raw.try_cast("int"))
    free = F.concat(F.col("name"), F.lit(" "), F.substring_index(raw, "<", 1))
    return answers.select(
        "id",
        "output_type",
        F.when(kind == "FREE", free).when(kind == "CHOICE", choice).alias("answer_text"),
        F.when(kind == "FLOAT", number_or_zero(raw)).alias("answer_number"),
    )
