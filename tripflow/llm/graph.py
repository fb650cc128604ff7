"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tripflow.llm.common import cut, discard
from tripflow.operators.skew import join_on_hot_keys


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it reaches.

    Each round a node takes the smallest label around it, then the label of its
    label. Labels only fall; the rounds end when none falls any more. Each
    round's labels are written, so a lost executor costs one round at most, and
    the labels before them are deleted.
    Edges that repeat, loop or have a null end change nothing.
    """
    links = edges.filter("a <> b").select("a", "b")
    both = cut(links.union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("root")))
    while True:
        around = (
            join_on_hot_keys(both.withColumnRenamed("b", "node"), labels, ["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        lower = labels.join(around, "node").select("node", F.least("root", "near").alias("next"), "root")
        tops = labels.select(F.col("node").alias("next"), F.col("root").alias("top"))
        moved = cut(
            join_on_hot_keys(lower, tops, ["next"]).select(
                "node", F.least("next", "top").alias("new"), (F.least("next", "top") < F.col("root")).alias("fell")
            )
        )
        discard(labels)
        labels = moved.withColumnsRenamed({"new": "root"}).drop("fell")
        labels.cut_folder = moved.cut_folder
        if moved.filter("fell").isEmpty():
            discard(both)
            return labels
