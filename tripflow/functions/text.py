"""Message text: token estimates, tags, labelled records and model answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded half to even; NULL text counts 0."""
    return F.bround(F.length(F.coalesce(text, F.lit(""))) / F.lit(4.0), 0).cast("long")


def clean_tag(tags: Column) -> Column:
    """First tag of tuple-like text such as \"('A', 'x')\"; NULL gives ''."""
    outer = F.regexp_replace(tags, r"^[()]+|[()]+$", "")
    first = F.regexp_replace(F.substring_index(outer, ",", 1), r"^[' ()]+|[' ()]+$", "")
    return F.coalesce(first, F.lit(""))


def first_tag(tags: Column) -> Column:
    """First tag of an array of tags; NULL or empty gives ''."""
    return F.coalesce(F.get(tags, F.lit(0)), F.lit(""))


def contains_ignore_case(text: Column, marker: str) -> Column:
    return F.lower(text).contains(marker.lower())


def after_label(text: Column, label: str) -> Column:
    """Trimmed text between the first and the second occurrence of a label."""
    return F.trim(F.get(F.split(text, _literal(label)), F.lit(1)))


# Fixed value: what introduces the time frame of a record.
FRAME_LABEL = "Based on observations in the timeframe "


def split_record(text: Column) -> Column:
    """'[tag] [frame]: body' as 'Based on observations in the timeframe ...' + body.

    A record without both parts comes back unchanged.
    """
    parts = F.split(text, _literal("]: "))
    frame = F.get(F.split(F.trim(F.get(parts, F.lit(0))), _literal("] [")), F.lit(1))
    body = F.trim(F.get(parts, F.lit(1)))
    labelled = F.concat(
        F.lit(FRAME_LABEL), frame, F.lit("\n"), body
    )
    return F.coalesce(labelled, text)


def section(title: str, body: Column) -> Column:
    """A titled block, NULL when there is no body."""
    return F.concat(F.lit(title + "\n"), body)


# Number texts that Python's float() accepts.
NUMBER_PATTERN = (
    r"^\s*[+-]?("
    r"[0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?([eE][+-]?[0-9](_?[0-9])*)?"
    r"|\.[0-9](_?[0-9])*([eE][+-]?[0-9](_?[0-9])*)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)


def number_or_zero(text: Column) -> Column:
    """The text as a double, 0.0 when it is not a number."""
    number = F.when(
        text.rlike(NUMBER_PATTERN), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")
    )
    return F.coalesce(number, F.lit(0.0))


def _literal(text: str) -> str:
    """A fixed text as a regular expression."""
    return "\\Q" + text + "\\E"
