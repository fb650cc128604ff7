"""Schedule lookup in bulk: next departure, travel time, fare and the best offer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tripflow.functions.times import hms_to_seconds, seconds_of_day, stamp, whole_minutes
from tripflow.operators.skew import join_on_hot_keys

REQUEST_PREFIX = "REQUEST"


@dataclass(frozen=True)
class Agency:
    """One carrier's place names, fares and offer rules.

    ``missing_dest`` says what a trip that never calls at the destination is
    worth: 'zero' minutes, or 'drop' the offer.
    """

    name: str
    mode: str
    stops: Mapping[str, str]
    fares: Mapping[tuple[str, str], float] = field(default_factory=dict)
    default_fare: float = 5.0
    missing_dest: str = "zero"
    with_trip: bool = True


@dataclass(frozen=True)
class FixedOffer:
    """A carrier that answers every request alike."""

    agency: str
    eta_min: int
    cost: float
    mode: str


def _rows(spark: SparkSession, rows: Sequence[Mapping[str, object]], schema: str) -> DataFrame:
    """Parameter rows as a relation whose size the optimizer can see."""
    values = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])
    return spark.range(1).select(F.inline(values.cast(f"array<struct<{schema}>>")))


def stop_map(spark: SparkSession, agencies: Sequence[Agency]) -> DataFrame:
    rows = [
        {"agency": a.name, "place": place, "stop_id": stop}
        for a in agencies
        for place, stop in a.stops.items()
    ]
    return _rows(spark, rows, "agency:string,place:string,stop_id:string")


def fare_table(spark: SparkSession, agencies: Sequence[Agency]) -> DataFrame:
    rows = [
        {"agency": a.name, "from_stop": pair[0], "to_stop": pair[1], "fare": fare}
        for a in agencies
        for pair, fare in a.fares.items()
    ]
    schema = "agency:string,from_stop:string,to_stop:string,fare:double"
    if not rows:
        return spark.createDataFrame([], schema)
    return _rows(spark, rows, schema)


@dataclass(frozen=True)
class AgencyTables:
    """The carriers as tables, for feeds of more agencies than a plan can spell out.

    ``stops``: (agency, place, stop_id); ``fares``: (agency, from_stop, to_stop,
    fare); ``rules``: (agency, mode, default_fare, missing_dest, with_trip).
    """

    stops: DataFrame
    fares: DataFrame
    rules: DataFrame


def rule_table(spark: SparkSession, agencies: Sequence[Agency]) -> DataFrame:
    names = ("mode", "default_fare", "missing_dest", "with_trip")
    rows = [{"agency": a.name} | {n: getattr(a, n) for n in names} for a in agencies]
    return _rows(
        spark, rows, "agency:string,mode:string,default_fare:double,missing_dest:string,with_trip:boolean"
    )


def agency_tables(spark: SparkSession, agencies: Sequence[Agency]) -> AgencyTables:
    return AgencyTables(stop_map(spark, agencies), fare_table(spark, agencies), rule_table(spark, agencies))


def per_agency(agencies: Sequence[Agency], attribute: str) -> Column:
    """An agency attribute looked up by the ``agency`` column."""
    pairs = [F.lit(x) for a in agencies for x in (a.name, getattr(a, attribute))]
    return F.create_map(*pairs)[F.col("agency")]


def is_request(message: str = "message") -> Column:
    return F.col(message).startswith(REQUEST_PREFIX)


def schedule_seconds(stop_times: DataFrame) -> DataFrame:
    """Schedule rows with departure and arrival as seconds after midnight."""
    return stop_times.withColumn(
        "dep_secs", hms_to_seconds(F.col("departure_time"))
    ).withColumn("arr_secs", hms_to_seconds(F.col("arrival_time")))


def places_to_stops(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """One row per request and agency that serves both places."""
    origins = stops.select("agency", F.col("place").alias("origin"), F.col("stop_id").alias("origin_stop"))
    ends = stops.select("agency", F.col("place").alias("destination"), F.col("stop_id").alias("dest_stop"))
    return requests.join(origins, "origin").join(ends, ["agency", "destination"])


def first_departures(moments: DataFrame, seconds: DataFrame) -> DataFrame:
    """Forward as-of: the earliest departure at or after each (agency, stop, second).

    ``moments`` holds each second asked for once per stop, and departures come
    in as the distinct seconds at which something leaves, so a stop brings no
    more rows to its window than there are seconds in a service day and a day of
    asks, whatever the number of requests or trips, and each row is a few
    numbers. Only for seconds that answer something is the first trip looked
    up. Seconds run downwards so that the frame only ever grows.
    """
    leaving = seconds.filter(F.col("dep_secs").isNotNull()).withColumnRenamed("stop_id", "origin_stop")
    departures = leaving.select("agency", "origin_stop", F.col("dep_secs").alias("now_secs")).distinct()
    both = moments.select(
        "agency", "origin_stop", F.col("now_secs").cast("long").alias("now_secs"), F.lit(None).cast("long").alias("dep_secs")
    ).unionByName(departures.withColumn("dep_secs", F.col("now_secs")))
    running = (
        Window.partitionBy("agency", "origin_stop")
        .orderBy(F.desc("now_secs"), F.col("dep_secs").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = (
        both.withColumn("next", F.last("dep_secs", ignorenulls=True).over(running))
        .filter(F.col("dep_secs").isNull() & F.col("next").isNotNull())
        .select("agency", "origin_stop", "now_secs", F.col("next").alias("dep_secs"))
    )
    place = ["agency", "origin_stop", "dep_secs"]
    used = answered.select(*place).distinct()
    trips = join_on_hot_keys(leaving.select(*place, "trip_id"), used, place)
    first_trips = trips.groupBy(*place).agg(F.min("trip_id").alias("trip_id"))
    return join_on_hot_keys(answered, first_trips, place)


def first_calls(seconds: DataFrame) -> DataFrame:
    """When each trip first calls at each stop: by stop sequence, absent ones last, then by time."""
    sequence = F.coalesce(F.col("stop_sequence").cast("decimal(11,0)"), F.lit(2**31).cast("decimal(11,0)"))
    # One number to order by, which aggregates by hash: twenty digits for the seconds.
    order = sequence * F.lit(Decimal(10**19)).cast("decimal(20,0)") + F.coalesce("arr_secs", F.lit(2**63 - 1))
    return seconds.groupBy("trip_id", F.col("stop_id").alias("dest_stop"), "agency").agg(
        F.min_by("arr_secs", order.cast("decimal(38,0)")).alias("arr_at"), F.lit(True).alias("calls_there")
    )


def next_departure(
    asks: DataFrame,
    stop_times: DataFrame,
    missing_dest: str | Column = "zero",
    require_after: bool = False,
) -> DataFrame:
    """Next departure, arrival and whole minutes of travel for each ask.

    ``asks`` needs agency, origin_stop, dest_stop and now_secs, which may lie
    past midnight like departures do; asks without an answer disappear. Each
    distinct question is answered once: first its moment at a stop, then its
    destination. Answers are joined back at the end, so a stop or second that a
    third of all asks share costs one row until that join.
    """
    seconds = schedule_seconds(stop_times)
    moment = ["agency", "origin_stop", "now_secs"]
    asked = asks.withColumn("now_secs", F.col("now_secs").cast("long"))
    policy = missing_dest if isinstance(missing_dest, Column) else F.lit(missing_dest)
    questions = asked.select(*moment, "dest_stop", policy.alias("missing")).distinct()
    departed = join_on_hot_keys(
        questions, first_departures(questions.select(*moment).distinct(), seconds), moment
    )
    arrival = F.when(F.col("calls_there"), F.col("arr_at")).when(
        F.col("missing") == "zero", F.col("dep_secs")
    )
    answers = (
        join_on_hot_keys(departed, first_calls(seconds), ["trip_id", "dest_stop", "agency"], "left")
        .withColumn("arr_secs", arrival)
        .filter(F.col("arr_secs").isNotNull())
    )
    if require_after:
        answers = answers.filter(F.col("arr_secs") >= F.col("dep_secs"))
    answers = answers.select(
        *moment,
        "dest_stop",
        "trip_id",
        "dep_secs",
        "arr_secs",
        whole_minutes(F.col("arr_secs") - F.col("dep_secs")).alias("eta_min"),
    )
    return join_on_hot_keys(asked, answers, ["agency", "origin_stop", "dest_stop", "now_secs"])


def with_fares(trips: DataFrame, fares: DataFrame, default_fare: Column) -> DataFrame:
    """Fare of the stop pair, the agency's default where none is listed."""
    pairs = fares.withColumnsRenamed({"from_stop": "origin_stop", "to_stop": "dest_stop"})
    return trips.join(pairs, ["agency", "origin_stop", "dest_stop"], "left").withColumn(
        "cost", F.coalesce("fare", default_fare)
    ).drop("fare")


def asks_of(requests: DataFrame, stops: DataFrame) -> DataFrame:
    """Request messages as asks with stop ids and the second of the day."""
    open_requests = requests.filter(is_request()).withColumn(
        "now_secs", seconds_of_day(F.col("requested_at"))
    )
    return places_to_stops(open_requests, stops)


def schedule_offers(
    requests: DataFrame,
    stop_times: DataFrame,
    agencies: Sequence[Agency] | AgencyTables,
    require_after: bool = False,
) -> DataFrame:
    """Offers of scheduled carriers for request_id, origin, destination, requested_at, message."""
    if not isinstance(agencies, AgencyTables):
        agencies = agency_tables(requests.sparkSession, agencies)
    asks = asks_of(requests, agencies.stops).join(agencies.rules, "agency")
    trips = next_departure(asks, stop_times, F.col("missing_dest"), require_after)
    priced = with_fares(trips, agencies.fares, F.col("default_fare"))
    detailed = F.col("with_trip")
    return priced.select(
        "request_id",
        "agency",
        "eta_min",
        "cost",
        "mode",
        F.when(detailed, F.col("origin")).alias("origin"),
        F.when(detailed, F.col("destination")).alias("destination"),
        F.when(detailed, stamp(F.col("requested_at"))).alias("departure_time"),
    )


def fixed_offers(requests: DataFrame, offers: Sequence[FixedOffer]) -> DataFrame:
    """The same offers for every request message."""
    each = F.array(
        *[
            F.struct(
                F.lit(o.agency).alias("agency"),
                F.lit(o.eta_min).cast("long").alias("eta_min"),
                F.lit(float(o.cost)).alias("cost"),
                F.lit(o.mode).alias("mode"),
            )
            for o in offers
        ]
    )
    return requests.filter(is_request()).select("request_id", F.inline(each))


def stack_offers(*offers: DataFrame) -> DataFrame:
    """Offers with different fields in one table, absent fields NULL."""
    stacked = offers[0]
    for more in offers[1:]:
        stacked = stacked.unionByName(more, allowMissingColumns=True)
    return stacked


def best_offer(
    offers: DataFrame, order: Sequence[str] = ("eta_min", "cost", "agency")
) -> DataFrame:
    """The first offer of each request by the given criteria; absent values come last.

    Each task keeps one offer per request before the shuffle, and sorts by the
    request number alone.
    """
    rest = [c for c in offers.columns if c != "request_id" and c not in order]
    ranked = F.struct(
        *[x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))], *rest
    )
    return (
        offers.groupBy("request_id")
        .agg(F.min(ranked).alias("best"))
        .select("request_id", *[F.col(f"best.{c}") for c in offers.columns if c != "request_id"])
    )
