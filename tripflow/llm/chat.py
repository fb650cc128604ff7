"""Chat formatting: every assistant turn becomes an example of its own.

An example holds all turns before a reply and the reply itself, and only the
reply's text may be trained on. Turns behind the last reply, or of a
conversation without one, form a last example without trainable text, so the
examples of a conversation hold all of it.

Examples grow with the square of a conversation's turns; that is what prefix
expansion means. All other work is linear, and a conversation is the largest
group anything is gathered by.

Null roles and texts are empty, a null turn comes first. Equal turn numbers are
ordered by role, then text; repeated rows stay repeated turns. Rows without a
conv_id are one conversation. An empty table gives no examples. Only the four
named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn. Control strings of this and other templates are escaped in texts."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    trained: str = "assistant"
    # Strings that tokenizers of common chat models read as control tokens.
    controls: tuple[str, ...] = (
        "<|im_start|>",
        "<|im_end|>",
        "<|endoftext|>",
        "<s>",
        "</s>",
        "[INST]",
        "[/INST]",
        "<<SYS>>",
        "<</SYS>>",
    )

    def _rest(self) -> str:
        return "|".join(rf"\Q{c[1:]}\E" for c in sorted(self.controls, key=len, reverse=True))

    def escape(self, text: Column) -> Column:
        """One more tilde after the first character of anything that reads as a control string."""
        return F.regexp_replace(text, rf"([<\[])(~*)(?={self._rest()})", "$1$2~")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(~*)~(?={self._rest()})", "$1$2")

    def escape_role(self, role: Column) -> Column:
        """A role stays on its line."""
        return self.escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))

    def unescape_role(self, role: Column) -> Column:
        plain = F.regexp_replace(self.unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        return F.replace(plain, F.lit("\\\\"), F.lit("\\"))


def examples(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end, last).

    ``formatted`` up to code point ``loss_start`` is context; from there to
    ``loss_end`` (exclusive) is the text to train on.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    tail = f"{template.end}\n"
    told = (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn(
            "said",
            F.transform("turns", lambda t: F.struct(
                (t["role"] == template.trained).alias("trained"),
                F.concat(F.lit(template.start), template.escape_role(t["role"]), F.lit("\n")).alias("head"),
                template.escape(t["text"]).alias("body"),
            )),
        )
        .withColumn("lines", F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit(tail))))
        .withColumn("all", F.size("said"))
        .withColumn("replies", F.filter(F.sequence(F.lit(1), F.col("all")), lambda i: F.element_at("said", i)["trained"]))
        .withColumn("ends", F.when(F.try_element_at("replies", F.lit(-1)) == F.col("all"), F.col("replies"))
                    .otherwise(F.concat("replies", F.array("all"))))
    )
    one = told.select("conv_id", "said", "lines", "all", F.posexplode("ends").alias("example", "upto"))
    reply = F.element_at("said", F.col("upto"))
    formatted = F.array_join(F.slice("lines", 1, F.col("upto")), "")
    stop = F.length("formatted") - len(tail)
    return (
        one.withColumn("formatted", formatted)
        .withColumn("reply", reply)
        .select(
            "conv_id",
            (F.col("example") + 1).alias("example"),
            F.col("upto").alias("n_turns"),
            "formatted",
            F.when(F.col("reply.trained"), stop - F.length("reply.body")).otherwise(F.length("formatted")).alias("loss_start"),
            F.when(F.col("reply.trained"), stop).otherwise(F.length("formatted")).alias("loss_end"),
            (F.col("upto") == F.col("all")).alias("last"),
        )
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, rf"\Q{template.end}\E\n"), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.substring(b, len(template.start) + 1, 2**31 - 1))
    return F.transform(bodies, lambda b: F.struct(
        template.unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        template.unescape(F.substring(b, F.instr(b, "\n") + 1, 2**31 - 1)).alias("text"),
    ))


def trainable_text(template: Template = Template()) -> Column:
    """The text under the loss mask of an example, unescaped."""
    size = F.col("loss_end") - F.col("loss_start")
    return template.unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, size))
