"""Colours, line weights and label texts of the map layers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripflow.functions.numbers import round_places

# Palette cycled over the modes of a dataset.
PALETTE = (
    "#1f77b4", "#2ca02c", "#9467bd", "#ff7f0e", "#d62728",
    "#17becf", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22",
)

# One colour per known travel mode.
MODE_COLOURS = {
    "BIKING": "pink",
    "PRIVATE_AUTO": "blue",
    "CARPOOL": "green",
    "ON_DEMAND_AUTO": "purple",
    "WALKING": "orange",
    "COMMERCIAL": "red",
    "PUBLIC_TRANSIT": "yellow",
    "OTHER_TRAVEL_MODE": "grey",
}
# Fixed value.
DEFAULT_COLOUR = "gray"

# Modes drawn as cars on the origin map.
AUTO_MODES = ("PRIVATE_AUTO", "CARPOOL", "ON_DEMAND_AUTO")

# Fixed values.
TOP_ROUTE_COLOUR = "#d32f2f"
UNKNOWN_MODE = "UNKNOWN"


def known_mode(mode: Column) -> Column:
    return F.coalesce(mode, F.lit(UNKNOWN_MODE))


def palette_colour(position: Column) -> Column:
    """Colour of the 1-based position, starting over after the last one."""
    colours = F.array(*[F.lit(c) for c in PALETTE])
    return F.get(colours, F.pmod(position - 1, F.lit(len(PALETTE))).cast("int"))


def mode_colour(mode: Column) -> Column:
    pairs = [F.lit(x) for pair in MODE_COLOURS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[mode], F.lit(DEFAULT_COLOUR))


def auto_or(mode: Column, auto_colour: str, other_colour: str, autos=AUTO_MODES) -> Column:
    return F.when(mode.isin(*autos), F.lit(auto_colour)).otherwise(F.lit(other_colour))


def power_size(base: float, count: Column, exponent: float) -> Column:
    """base + count ** exponent, at 6 decimals."""
    return round_places(F.lit(base) + F.pow(count.cast("double"), F.lit(exponent)), 6)


def thousands(count: Column) -> Column:
    return F.format_string("%,d", count)


def decimals(value: Column, digits: int) -> Column:
    """Fixed decimals, ties judged on the exact binary value; NULL reads 'n/a'."""
    plain = F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    return F.coalesce(plain, F.lit("n/a"))
