"""Coordinates, bounding boxes and WKT text as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, functions as F

OD_COLUMNS = ("start_lat", "start_lng", "end_lat", "end_lng")
LINE_POINTS = "array<struct<lat:double,lng:double>>"


class Box(NamedTuple):
    """Inclusive latitude / longitude limits."""

    lat_min: float
    lat_max: float
    lng_min: float
    lng_max: float


# The two regions of the region-to-region study.
ORIGIN_BOX = Box(37.98, 38.02, -121.73, -121.67)
DESTINATION_BOX = Box(37.39, 37.47, -122.18, -122.10)
WORLD_BOX = Box(-90.0, 90.0, -180.0, 180.0)


def in_box(lat: str, lng: str, box: Box) -> Column:
    return F.col(lat).between(F.lit(box.lat_min), F.lit(box.lat_max)) & F.col(lng).between(
        F.lit(box.lng_min), F.lit(box.lng_max)
    )


def valid_start() -> Column:
    return in_box("start_lat", "start_lng", WORLD_BOX)


def valid_od() -> Column:
    """Both ends lie inside WGS84 limits; NULL and NaN fail."""
    return valid_start() & in_box("end_lat", "end_lng", WORLD_BOX)


def point_wkt(lat: Column, lng: Column) -> Column:
    """Longitude comes first in WKT."""
    return F.concat(F.lit("POINT("), lng.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def point_xy(wkt: Column) -> tuple[Column, Column]:
    """(x, y) of a POINT text, NULL when the text is no point."""
    pattern = r"^\s*POINT\s*\(\s*(\S+)\s+(\S+?)\s*\)\s*$"
    return tuple(
        F.regexp_extract(wkt, pattern, group).try_cast("double").alias(name)
        for group, name in ((1, "x"), (2, "y"))
    )


def _line_points(segment: Column) -> Column:
    """Points of one LINESTRING text; vertices that are not two numbers are left out."""
    inner = F.regexp_replace(segment, r"LINESTRING\s*\(|\)", "")
    pairs = F.transform(
        F.split(inner, r",\s*"),
        lambda pair: F.split(F.trim(pair), r"\s+"),
    )
    points = F.transform(
        F.filter(pairs, lambda p: F.size(p) == 2),
        lambda p: F.struct(
            p[1].try_cast("double").alias("lat"), p[0].try_cast("double").alias("lng")
        ),
    )
    return F.filter(points, lambda p: p.lat.isNotNull() & p.lng.isNotNull())


def trajectory_lines(trajectory: Column) -> Column:
    """A '|'-joined trajectory as an array of lines, other geometry types ignored."""
    parts = F.filter(F.split(trajectory, r"\|"), lambda s: s.contains("LINESTRING"))
    return F.coalesce(F.transform(parts, _line_points), F.array().cast(f"array<{LINE_POINTS}>"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _touch(last: Column, first: Column, eps: float) -> Column:
    near = (F.abs(last.lat - first.lat) < eps) & (F.abs(last.lng - first.lng) < eps)
    return F.coalesce(near, F.lit(False))


def _last(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def _rest_if(drop: Column, line: Column) -> Column:
    return F.when(drop, F.slice(line, F.lit(2), F.size(line) - 1)).otherwise(line)


def stitch(lines: Column, eps: float = 0.0005) -> Column:
    """One line from many, dropping a first vertex that repeats the last one kept.

    A line of two vertices or more ends with its own last one whatever is
    dropped, so each line needs only the one before it and all are joined in one
    go. A line of one vertex may shrink to nothing and pass on the vertex before
    it; rows with such lines are walked through with one flag per line. Either
    way a vertex is copied once.
    """

    def at_once(kept: Column) -> Column:
        return F.flatten(
            F.transform(
                kept,
                lambda line, i: _rest_if(_touch(_last(F.get(kept, i - 1)), F.get(line, F.lit(0)), eps), line),
            )
        )

    def walked(kept: Column) -> Column:
        def step(state: Column, line: Column) -> Column:
            drop = _touch(state.last, F.get(line, F.lit(0)), eps)
            last = F.when(drop & (F.size(line) == 1), state.last).otherwise(_last(line))
            return F.struct(last.alias("last"), F.concat(state.drops, F.array(drop)).alias("drops"))

        start = F.struct(
            F.lit(None).cast("struct<lat:double,lng:double>").alias("last"),
            F.array().cast("array<boolean>").alias("drops"),
        )
        drops = F.aggregate(kept, start, step, lambda state: state.drops)
        return F.flatten(F.zip_with(kept, drops, lambda line, drop: _rest_if(drop, line)))

    def joined(kept: Column) -> Column:
        return F.when(F.exists(kept, lambda line: F.size(line) == 1), walked(kept)).otherwise(at_once(kept))

    return _bound(F.filter(lines, lambda line: F.size(line) > 0), joined)


def points_text(points: Column) -> Column:
    """'lat lng;lat lng' in micro-degrees, for text outputs and comparisons."""

    def micro(c: Column) -> Column:
        return F.round(c * F.lit(1e6), 0).cast("long").cast("string")

    return F.array_join(
        F.transform(points, lambda p: F.concat(micro(p.lat), F.lit(" "), micro(p.lng))), ";"
    )
