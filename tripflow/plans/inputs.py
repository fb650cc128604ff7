"""Trips, segments, schedules, requests, logs and answers derived from the given tables.

The given tables hold no trips, so each input is a projection of one of them:
a scan stays a scan, and no derived input needs a shuffle of its own. The same
rules as SQL are in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripflow.operators.schedule import Agency, FixedOffer

# Parameters of the derived inputs.
LINE_MODES = (
    "PRIVATE_AUTO", "WALKING", "BIKING", "PUBLIC_TRANSIT", "CARPOOL", "ON_DEMAND_AUTO", "COMMERCIAL",
)
PLACES = ("Harbor", "Airport", "Market", "College", "Viewpoint", "Island")
RAIL = Agency(
    name="rail",
    mode="rail",
    stops={
        "Harbor": "click",
        "Airport": "error",
        "Market": "purchase",
        "College": "signup",
        "Viewpoint": "view",
    },
    fares={("click", "error"): 6.4, ("purchase", "view"): 3.9},
    default_fare=4.5,
    missing_dest="zero",
)
BUS = Agency(
    name="bus",
    mode="bus",
    stops={"Harbor": "click", "Market": "purchase", "Viewpoint": "view"},
    fares={("click", "purchase"): 3.0},
    default_fare=2.5,
    missing_dest="drop",
    with_trip=False,
)
FIXED_OFFERS = (
    FixedOffer("air", 35, 140.0, "shuttle_plane"),
    FixedOffer("ride", 75, 48.0, "shared_car"),
)
CONVERSATIONS_PER_AGENT = 25
POSITIONS_PER_CONVERSATION = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _div(a: str, b: int) -> Column:
    return F.expr(f"{a} div {b}")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per line item: 4 datasets, 9 modes (one NULL), a grid of ends."""
    line = table(spark, sf_dir, "lineitem")
    quantity, number, part, supp = (
        F.col(c) for c in ("l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    )
    weekend = F.dayofweek("l_shipdate").isin(1, 7)
    quarter = F.quarter("l_shipdate")
    links = F.transform(
        F.sequence(F.lit(0), number - 1),
        lambda i: F.when((part % 40 + i) % 11 == 0, -1 - i.cast("long")).otherwise(
            part % 40 * 3 + i * 37
        ),
    )
    return line.select(
        F.concat(
            F.when(quarter <= 2, "Q2").otherwise("Q4"),
            F.when(weekend, " Saturday").otherwise(" Thursday"),
        ).alias("dataset"),
        F.col("l_orderkey").alias("person_id"),
        F.when(quantity == 50, "OTHER_TRAVEL_MODE")
        .when(quantity == 49, None)
        .otherwise(_pick(LINE_MODES, number - 1))
        .alias("mode"),
        F.when(F.col("l_orderkey") % 97 == 0, 999.0)
        .otherwise((3795 + supp % 10).cast("double") / 100)
        .alias("start_lat"),
        ((-12173 + _div("l_suppkey", 10) % 3 * 4).cast("double") / 100).alias("start_lng"),
        ((3737 + part % 5 * 3).cast("double") / 100).alias("end_lat"),
        ((-12220 + _div("l_partkey", 5) % 4 * 4).cast("double") / 100).alias("end_lng"),
        (quantity - 1).alias("distance_miles"),
        F.when(F.col("l_tax") == 0, 0.0)
        .otherwise(quantity * 1.5 + number)
        .alias("duration_minutes"),
        F.when(number == 6, F.array().cast("array<long>"))
        .when(number < 6, links)
        .alias("network_link_ids"),
        F.concat(F.lit("T"), (supp % 10).cast("string")).alias("origin_census_tract"),
        F.concat(F.lit("T"), (part % 10).cast("string")).alias("destination_census_tract"),
        number.alias("passengers"),
        F.when(weekend, "weekend").otherwise("weekday").alias("day_type"),
        F.concat(F.lit("Q"), quarter.cast("string")).alias("quarter"),
    )


def trip_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name of the trip table behind each dataset label found in the trips."""
    label = F.split("dataset", " ")
    return trips(spark, sf_dir).select("dataset").distinct().select(
        F.concat(
            F.lit("bay_2024_"), label[0], F.lit("_"), F.lower(label[1]), F.lit("_trip")
        ).alias("table_name")
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of both seasons; some are missing and some appear twice in one season."""
    seasons = F.when(
        F.col("o_orderkey") % 17 == 0, F.array(F.lit("Q2"), F.lit("Q4"), F.lit("Q2"))
    ).otherwise(F.array(F.lit("Q2"), F.lit("Q4")))
    return (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderkey") % 13 != 0)
        .select(F.explode(seasons).alias("season"), F.col("o_orderkey").alias("person_id"))
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point lines where link k ends at the start of link k + 37; some repeat."""

    def vertex(key: Column) -> Column:
        digits = [F.lpad((key % m + 10).cast("string"), 2, "0") for m in (90, 70)]
        return F.concat(F.lit("-122."), digits[0], F.lit(" 37."), digits[1])

    key = F.col("p_partkey")
    line = F.concat(F.lit("LINESTRING("), vertex(key), F.lit(", "), vertex(key + 37), F.lit(")"))
    copies = F.when(key % 29 == 0, F.array(F.lit("Q2"), F.lit("Q4"), F.lit("Q4"))).otherwise(
        F.array(F.lit("Q2"), F.lit("Q4"))
    )
    return table(spark, sf_dir, "part").select(
        F.explode(copies).alias("season"),
        key.cast("string").alias("stableEdgeId"),
        F.when(F.col("p_size") % 10 != 0, line).alias("geometry"),
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of trips at stops for two agencies; some times are unreadable or past 24 h."""
    clock = F.date_format("ts", "HH:mm:ss")
    late = F.concat((F.hour("ts") + 24).cast("string"), F.substring(clock, 3, 6))
    text = (
        F.when(F.col("event_id") % 50 == 7, F.substring(clock, 1, 5))
        .when(F.col("event_id") % 53 == 5, late)
        .otherwise(clock)
    )
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 == 0, "bus").otherwise("rail").alias("agency"),
        F.concat(
            F.col("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string")
        ).alias("trip_id"),
        F.col("event_type").alias("stop_id"),
        F.col("event_id").alias("stop_sequence"),
        text.alias("arrival_time"),
        text.alias("departure_time"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message per order; most ask for a trip between two places."""
    origin = _pick(PLACES, F.col("o_orderkey") % 6)
    destination = _pick(PLACES, (F.col("o_orderkey") + 1 + F.col("o_custkey") % 5) % 6)
    word = F.when(F.col("o_orderkey") % 19 == 0, "ACCEPT").otherwise("REQUEST")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        origin.alias("origin"),
        destination.alias("destination"),
        F.expr("timestampadd(SECOND, CAST(o_custkey * 61 % 86400 AS int), o_orderdate)").alias(
            "requested_at"
        ),
        F.concat(word, F.lit(": From "), origin, F.lit(" to "), destination).alias("message"),
    )


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent per 25 conversations; first turns are derived records."""
    first = F.col("turn") == 0
    kind = F.col("conv_id") % 4
    tag = (
        F.when(first & (kind == 0), "ScenarioUnderstanding")
        .when(first & (kind == 1), "ParticipantUnderstanding")
        .when(first & (kind == 2), "SelfUnderstanding")
        .when(first & (kind == 3), "ThoughtProcessForAction")
        .when(F.col("role") != "system", F.col("role"))
    )
    opening = (
        F.when(F.col("conv_id") % 12 == 0, F.lit("[x] no marker: "))
        .when(kind == 0, F.lit("[ScenarioUnderstanding] [01 Jan 2024 08:00 - 12:00]: <Scenario> "))
        .when(kind == 1, F.lit("<Participant> "))
        .when(kind == 2, F.lit("[SelfUnderstanding] [now]: <SelfUnderstanding> "))
        .otherwise(F.lit("ThoughtProcessForAction ``` "))
    )
    position = (
        F.col("conv_id") % CONVERSATIONS_PER_AGENT * POSITIONS_PER_CONVERSATION + F.col("turn")
    )
    return table(spark, sf_dir, "conversations").select(
        _div("conv_id", CONVERSATIONS_PER_AGENT).alias("agent_id"),
        position.alias("idx"),
        F.expr(
            f"timestampadd(MINUTE, CAST(conv_id % {CONVERSATIONS_PER_AGENT} * "
            f"{POSITIONS_PER_CONVERSATION} + turn AS int), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
        ).alias("time"),
        F.when(tag.isNotNull(), F.array(tag, F.lit("source"))).alias("tags"),
        F.when(first, F.concat(opening, "text")).otherwise(F.col("text")).alias("text"),
    )


def agent_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration per agent; every third one lacks the endowment."""
    agent = F.col("agent_id")
    return (
        table(spark, sf_dir, "conversations")
        .select(_div("conv_id", CONVERSATIONS_PER_AGENT).alias("agent_id"))
        .distinct()
        .select(
            "agent_id",
            F.concat(F.lit("agent"), agent.cast("string")).alias("name"),
            F.concat(F.lit("Overarching motivation:  goal "), agent.cast("string")).alias("motivation"),
            F.concat(F.lit("Day\nCurrent time: "), (agent % 24).cast("string"), F.lit(":30 ")).alias("report"),
            F.when(
                agent % 3 != 0,
                F.create_map(F.lit("initial_endowment"), (agent * 10).cast("string")),
            )
            .otherwise(F.create_map().cast("map<string,string>"))
            .alias("extras"),
        )
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers of three kinds from events; some numbers and choices are bad."""
    event = F.col("event_id")
    kind = event % 3
    value = F.col("value")
    number = (
        F.when(event % 7 == 0, F.lit("about ten"))
        .when(event % 11 == 0, F.concat(F.floor(value).cast("string"), F.lit("f")))
        .when(event % 13 == 0, F.concat(F.lit("1_0"), F.floor(value).cast("string")))
        .otherwise(F.concat(F.lit(" "), F.floor(value * 4).cast("string"), F.lit("e-2 ")))
    )
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        F.lit("Agent").alias("name"),
        F.when(kind == 0, "FREE").when(kind == 1, "CHOICE").otherwise("FLOAT").alias("output_type"),
        F.when(kind == 0, F.concat(F.col("event_type"), F.lit(" <b>"), F.col("props")))
        .when(kind == 1, (F.col("user_id") % 4).cast("string"))
        .otherwise(number)
        .alias("raw"),
        F.array(F.lit("accept"), F.lit("reject"), F.col("event_type")).alias("options"),
    )
