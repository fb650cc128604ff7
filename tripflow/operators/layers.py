"""Map layers as feature tables: geometry, style and label of everything drawn."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripflow.functions.geo import LINE_POINTS, OD_COLUMNS
from tripflow.functions.style import (
    TOP_ROUTE_COLOUR,
    auto_or,
    decimals,
    known_mode,
    mode_colour,
    palette_colour,
    power_size,
    thousands,
)
from tripflow.operators.routes import stitched
from tripflow.operators.topn import in_order, top_per_group

FEATURE = (
    f"struct<kind:string,coords:{LINE_POINTS},colour:string,size:double,"
    "opacity:double,dash:string,tooltip:string,popup:string>"
)


def _point(lat: str, lng: str) -> Column:
    return F.struct(F.col(lat).alias("lat"), F.col(lng).alias("lng"))


def _feature(
    kind: str,
    coords: Column,
    colour: Column | str,
    size: Column | float,
    opacity: Column | float,
    dash: Column | None = None,
    tooltip: Column | None = None,
    popup: Column | None = None,
) -> Column:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    return F.struct(
        F.lit(kind).alias("kind"),
        coords.alias("coords"),
        column(colour).alias("colour"),
        column(size).cast("double").alias("size"),
        column(opacity).cast("double").alias("opacity"),
        column(dash).cast("string").alias("dash"),
        column(tooltip).cast("string").alias("tooltip"),
        column(popup).cast("string").alias("popup"),
    ).cast(FEATURE)


# The wording of tooltips and popups, a line or part each.
FLOW_TOOLTIP = ("trips: {trips}", "rank: #{rank}")
ROUTE_TOOLTIP = ("#{rank}: {trips} trips ({mode})",)
ROUTE_POPUP = (
    "Rank #{rank} Route",
    "Dataset: {dataset}",
    "Mode: {mode}",
    "Trip Count: {trips}",
    "Avg Distance: {distance} mi",
    "Avg Duration: {duration} min",
    "Distance Range: {least} - {most} mi",
)
ROUTE_END = ("{word}: Rank #{rank}",)
ORIGIN_POPUP = ("Origin: {mode} trips",)
COUNT_POPUP = ("Mode: {mode}", "Trips: {trips}")
NETWORK_TOOLTIP = ("{label} | {mode} | trips: {trips} (same route) | ~{distance}mi, {duration}min{form}",)
ON_ROAD, STRAIGHT = " (Continuous Route)", " (Direct Line - No Network Data)"


def _filled(wording: Sequence[str], **values: Column) -> list[Column]:
    """The parts of a wording with their values; a part without one of its values is NULL."""

    def part(text: str) -> Column:
        pieces = [(F.lit(fixed) if fixed else None, values[name] if name else None) for fixed, name, _, _ in Formatter().parse(text)]
        return F.concat(*[piece for pair in pieces for piece in pair if piece is not None])

    return [part(text) for text in wording]


def _explode(df: DataFrame, *features: Column) -> DataFrame:
    """One row per feature that is present; ``rank`` keeps the drawing order."""
    present = F.filter(F.array(*features), lambda f: f.isNotNull())
    return df.select("dataset", "mode", "rank", F.inline(present))


def sampling_order(columns: Sequence[str], seed: int) -> list[Column]:
    """A repeatable shuffle of rows by their keys, the keys settling ties."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    text = F.concat_ws("|", *parts, F.lit(str(seed)))
    return [F.md5(text), *in_order(columns)]


def origin_sample(flows: DataFrame, n: int = 2000, seed: int = 0) -> DataFrame:
    """At most n flows per dataset and mode, the same ones for the same seed."""
    labelled = flows.withColumn("mode", known_mode(F.col("mode"))).drop("rank")
    order = sampling_order(OD_COLUMNS, seed)
    # The first 48 bits of the digest, as a number in the same order.
    key = F.conv(F.substring(order[0], 1, 12), 16, 10).cast("long")
    return top_per_group(labelled, ["dataset", "mode"], order, n, "pick", keys=[key])


def mode_colours(ranked_modes: DataFrame) -> DataFrame:
    """Palette colour of each (dataset, mode) by its ``position`` column."""
    return ranked_modes.withColumn("colour", palette_colour(F.col("position")))


def colours_by_name(flows: DataFrame) -> DataFrame:
    """Modes coloured in name order, the unknown mode first as NULL sorts first."""
    spot = Window.partitionBy("dataset").orderBy(F.asc_nulls_first("mode"))
    modes = flows.select("dataset", "mode").distinct().withColumn(
        "position", F.row_number().over(spot)
    )
    return mode_colours(modes).select(
        "dataset", known_mode(F.col("mode")).alias("mode"), F.col("position").cast("long"), "colour"
    )


def colours_by_size(patterns: DataFrame) -> DataFrame:
    """Modes coloured by their largest count, as first met in a list sorted by count."""
    spot = Window.partitionBy("dataset").orderBy(F.desc("largest"), F.asc_nulls_first("mode"))
    modes = (
        patterns.groupBy("dataset", "mode")
        .agg(F.max("trip_count").alias("largest"))
        .withColumn("position", F.row_number().over(spot))
    )
    return mode_colours(modes).select(
        "dataset", known_mode(F.col("mode")).alias("mode"), F.col("position").cast("long"), "colour"
    )


def flow_features(top: DataFrame, sample: int = 2000, seed: int = 0) -> DataFrame:
    """Lines and sampled origin markers of ranked top flows, in one pass over them.

    Colour positions are ranks of the mode inside the dataset; the input is the
    bounded result of ``top_flows``.
    """
    spot = Window.partitionBy("dataset").orderBy(F.asc_nulls_first("mode"))
    pick = Window.partitionBy("dataset", "mode").orderBy(*sampling_order(OD_COLUMNS, seed))
    styled = (
        top.withColumn("colour", palette_colour(F.dense_rank().over(spot)))
        .withColumn("pick", F.row_number().over(pick))
        .withColumn("mode", known_mode(F.col("mode")))
    )
    tooltip = F.concat_ws(
        " | ",
        "dataset",
        "mode",
        *_filled(FLOW_TOOLTIP, trips=F.col("trip_count").cast("string"), rank=F.col("rank").cast("string")),
    )
    line = _feature(
        "flow",
        F.array(_point("start_lat", "start_lng"), _point("end_lat", "end_lng")),
        F.col("colour"),
        power_size(1.0, F.col("trip_count"), 0.30),
        0.6,
        tooltip=tooltip,
    )
    marker = _feature("origin", F.array(_point("start_lat", "start_lng")), F.col("colour"), 2.0, 0.5)
    return _explode(styled, line, F.when(F.col("pick") <= sample, marker))


def fixed_colour_features(top: DataFrame) -> DataFrame:
    """Thin lines of the largest flows in the fixed colour of their mode."""
    line = _feature(
        "od_line",
        F.array(_point("start_lat", "start_lng"), _point("end_lat", "end_lng")),
        mode_colour(F.col("mode")),
        2.0,
        0.6,
    )
    return _explode(top.withColumn("mode", known_mode(F.col("mode"))), line)


def top_route_features(frequent: DataFrame, top_n: int = 10) -> DataFrame:
    """The first routes of each dataset as a line with a start and an end marker."""
    routes = frequent.filter(F.col("rank") <= top_n).withColumn("mode", known_mode(F.col("mode")))
    rank = F.col("rank").cast("string")
    count = thousands(F.col("trip_count"))
    popup = F.concat_ws(
        "\n",
        *_filled(
            ROUTE_POPUP,
            rank=rank,
            dataset=F.col("dataset"),
            mode=F.col("mode"),
            trips=count,
            distance=decimals(F.col("avg_distance_miles"), 1),
            duration=decimals(F.col("avg_duration_min"), 1),
            least=decimals(F.col("min_distance_miles"), 1),
            most=decimals(F.col("max_distance_miles"), 1),
        ),
    )
    start, end = _point("start_lat", "start_lng"), _point("end_lat", "end_lng")
    line = _feature(
        "top_route",
        F.array(start, end),
        TOP_ROUTE_COLOUR,
        F.lit(6.0) + (F.lit(top_n) - (F.col("rank") - 1)) * F.lit(0.5),
        0.9,
        tooltip=_filled(ROUTE_TOOLTIP, rank=rank, trips=count, mode=F.col("mode"))[0],
        popup=popup,
    )

    def end_marker(kind: str, spot: Column, colour: str, word: str) -> Column:
        label = _filled(ROUTE_END, word=F.lit(word), rank=rank)[0]
        return _feature(kind, F.array(spot), colour, 8.0, 0.7, popup=label)

    return _explode(
        routes,
        line,
        end_marker("top_route_start", start, "green", "Start"),
        end_marker("top_route_end", end, "red", "End"),
    )


def network_features(
    patterns: DataFrame, label: str, sample: int = 500, seed: int = 0, eps: float = 0.0005
) -> DataFrame:
    """Route patterns as stitched lines, dashed straight ones where no line results.

    Colour positions come from one row per dataset and mode; origin markers from
    an exact sample per mode.
    """
    colours = colours_by_size(patterns).drop("position")
    keys = [*OD_COLUMNS, "trajectory_segments"]
    labelled = patterns.withColumn("mode", known_mode(F.col("mode")))
    picked = (
        top_per_group(
            labelled, ["dataset", "mode"], sampling_order(keys, seed), sample, "rank"
        )
        .join(colours, ["dataset", "mode"])
    )
    origins = _explode(
        picked,
        _feature(
            "network_origin",
            F.array(_point("start_lat", "start_lng")),
            F.col("colour"),
            3.0,
            0.6,
            popup=_filled(ORIGIN_POPUP, mode=F.col("mode"))[0],
        ),
    )
    lines = stitched(labelled, eps).join(colours, ["dataset", "mode"])
    on_road = F.size("points") > 1
    tooltip = _filled(
        NETWORK_TOOLTIP,
        label=F.lit(label),
        mode=F.col("mode"),
        trips=F.col("trip_count").cast("string"),
        distance=decimals(F.col("avg_distance_miles"), 0),
        duration=decimals(F.col("avg_duration_min"), 0),
        form=F.when(on_road, F.lit(ON_ROAD)).otherwise(F.lit(STRAIGHT)),
    )[0]
    straight = F.array(_point("start_lat", "start_lng"), _point("end_lat", "end_lng"))
    line = _feature(
        "network_route",
        F.when(on_road, F.col("points")).otherwise(straight),
        F.col("colour"),
        power_size(2.0, F.col("trip_count"), 0.40),
        F.when(on_road, F.lit(0.8)).otherwise(F.lit(0.6)),
        dash=F.when(~on_road, F.lit("5, 10")),
        tooltip=tooltip,
    )
    return _explode(lines.withColumn("rank", F.lit(None).cast("long")), line).unionByName(origins)


def origin_features(counts: DataFrame, classed: bool = True) -> DataFrame:
    """Origin points as circles; car modes apart from the rest, or one mode apart."""
    point = F.array(F.struct(F.col("y").alias("lat"), F.col("x").alias("lng")))
    if classed:
        circle = _feature(
            "origin_count",
            point,
            auto_or(F.col("mode"), "blue", "green"),
            power_size(2.0, F.col("trip_count"), 0.2),
            0.6,
            popup=F.concat_ws(
                "\n",
                "dataset",
                *_filled(COUNT_POPUP, mode=known_mode(F.col("mode")), trips=F.col("trip_count").cast("string")),
            ),
        )
    else:
        circle = _feature(
            "origin_point",
            point,
            auto_or(F.col("mode"), "blue", "red", ("PRIVATE_AUTO",)),
            power_size(0.0, F.col("trip_count"), 0.3),
            0.5,
        )
    # The colour reads the mode, so the label replaces it afterwards.
    return _explode(counts, circle).withColumn("mode", known_mode(F.col("mode")))
