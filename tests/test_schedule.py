"""Next departures, fares and offers on hand-made rows and against brute force."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripflow.functions.times import hms_to_seconds, whole_minutes
from tripflow.operators import schedule
from tripflow.operators.schedule import Agency, FixedOffer

STOP_TIMES = (
    "agency string, trip_id string, stop_id string, stop_sequence int, "
    "arrival_time string, departure_time string"
)
ASKS = "request_id long, agency string, origin_stop string, dest_stop string, now_secs int"
REQUESTS = "request_id long, origin string, destination string, requested_at timestamp_ntz, message string"


def call(trip, stop, time, seq=1, agency="rail", arrival=None):
    return (agency, trip, stop, seq, arrival or time, time)


def answers(spark, calls, asks, **options):
    times = spark.createDataFrame(calls, STOP_TIMES)
    rows = spark.createDataFrame(asks, ASKS)
    return {r.request_id: r for r in schedule.next_departure(rows, times, **options).collect()}


@pytest.mark.parametrize(
    "text, seconds",
    [("08:05:09", 29109), ("25:10:00", 90600), (" 8:05:00", 29100), ("8:05", None),
     ("aa:bb:cc", None), ("", None), (None, None), ("1:2:3:4", None),
     ("700000:00:00", 2_520_000_000), ("9223372036854775807:00:00", None),
     ("99999999999999999999:00:00", None)],
)
def test_clock_text(spark, text, seconds):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(hms_to_seconds(F.col("t"))).first()[0] == seconds


@pytest.mark.parametrize("minutes, whole", [(2.5, 2), (3.5, 4), (-0.5, 0), (-2.5, -2), (2.6, 3)])
def test_minutes_round_half_to_even(spark, minutes, whole):
    assert spark.range(1).select(whole_minutes(F.lit(int(minutes * 60)))).first()[0] == whole


def test_departure_at_the_same_second_counts_and_ties_take_the_lower_trip(spark):
    calls = [call("b", "A", "08:00:00"), call("a", "A", "08:00:00"), call("c", "A", "07:59:59")]
    got = answers(spark, calls, [(1, "rail", "A", "Z", 28800)])
    assert (got[1].trip_id, got[1].dep_secs, got[1].eta_min) == ("a", 28800, 0)


def test_no_departure_left_and_unknown_stop_give_no_answer(spark):
    calls = [call("a", "A", "08:00:00"), call("b", "A", "bad")]
    asks = [(1, "rail", "A", "Z", 28801), (2, "rail", "X", "A", 0), (3, "bus", "A", "Z", 0)]
    assert answers(spark, calls, asks) == {}


def test_departures_past_midnight(spark):
    calls = [call("late", "A", "26:00:00"), call("later", "A", "27:00:00")]
    got = answers(spark, calls, [(1, "rail", "A", "Z", 86399)])
    assert (got[1].trip_id, got[1].dep_secs) == ("late", 93600)


def test_asks_past_midnight(spark):
    calls = [call("late", "A", "26:00:00"), call("later", "A", "28:00:00")]
    asks = [(i, "rail", "A", "Z", s) for i, s in enumerate([86399, 86400, 90000, 95000, 100800, 100801])]
    got = {k: v.trip_id for k, v in answers(spark, calls, asks).items()}
    assert got == {0: "late", 1: "late", 2: "late", 3: "later", 4: "later"}


def test_arrival_is_the_first_call_of_the_trip_at_the_destination(spark):
    calls = [
        call("a", "A", "08:00:00", 1), call("a", "B", "08:30:00", 5), call("a", "B", "08:20:00", 3),
    ]
    assert answers(spark, calls, [(1, "rail", "A", "B", 0)])[1].eta_min == 20


def test_arrival_without_stop_sequence_is_the_earliest_call(spark):
    calls = [call("a", "A", "08:00:00", 1), call("a", "B", "08:30:00", None), call("a", "B", "08:20:00", None),
             call("a", "C", "09:30:00", 7), call("a", "C", "09:10:00", 7), call("a", "C", "09:00:00", None)]
    got = answers(spark, calls, [(1, "rail", "A", "B", 0), (2, "rail", "A", "C", 0)])
    assert (got[1].eta_min, got[2].eta_min) == (20, 70)


def test_missing_destination_policies_and_order_check(spark):
    calls = [call("a", "A", "08:00:00", 2), call("a", "B", "07:00:00", 1)]
    asks = [(1, "rail", "A", "Z", 0), (2, "rail", "A", "B", 0)]
    assert {k: v.eta_min for k, v in answers(spark, calls, asks).items()} == {1: 0, 2: -60}
    assert set(answers(spark, calls, asks, missing_dest="drop")) == {2}
    assert set(answers(spark, calls, asks, require_after=True)) == {1}


def test_unreadable_arrival_gives_no_answer(spark):
    calls = [call("a", "A", "08:00:00", 1), call("a", "B", "08:10:00", 2, arrival="soon")]
    assert answers(spark, calls, [(1, "rail", "A", "B", 0)]) == {}


def test_next_departure_equals_brute_force(spark):
    rng = random.Random(7)
    calls = []
    for t in range(120):
        clock = rng.randrange(0, 90000)
        for seq, stop in enumerate(rng.sample("ABCD", 3)):
            text = f"{clock // 3600:02d}:{clock // 60 % 60:02d}:{clock % 60:02d}"
            calls.append((rng.choice(["rail", "bus"]), f"t{t:03d}", stop, seq, text, text))
            clock += rng.randrange(60, 2000)
    # A third of the asks share one moment.
    asks = [
        (i, "rail", "A", "B", 40000) if i % 3 == 0 else
        (i, rng.choice(["rail", "bus"]), rng.choice("ABCD"), rng.choice("ABCD"), rng.randrange(86400))
        for i in range(600)
    ]

    def seconds(text):
        h, m, s = map(int, text.split(":"))
        return h * 3600 + m * 60 + s

    want = {}
    for rid, agency, origin, dest, now in asks:
        later = [(seconds(c[5]), c[1]) for c in calls
                 if c[0] == agency and c[2] == origin and seconds(c[5]) >= now]
        if later:
            dep, trip = min(later)
            there = [c for c in calls if c[0] == agency and c[1] == trip and c[2] == dest]
            arr = seconds(min(there, key=lambda c: c[3])[4]) if there else dep
            want[rid] = (trip, dep, round((arr - dep) / 60))
    got = {k: (v.trip_id, v.dep_secs, v.eta_min) for k, v in answers(spark, calls, asks).items()}
    assert got == want and len(want) > 300


RAIL = Agency("rail", "train", {"X": "A", "Y": "B"}, {("A", "B"): 8.6}, 5.0, "zero")
BUS = Agency("bus", "coach", {"X": "A", "Y": "B"}, {}, 2.5, "drop", with_trip=False)


def requests(spark):
    at = datetime(2024, 1, 1, 7, 30)
    return spark.createDataFrame(
        [
            (1, "X", "Y", at, "REQUEST: From X to Y"),
            (2, "X", "Nowhere", at, "REQUEST: From X to Nowhere"),
            (3, "X", "Y", at, "THANKS"),
            (4, "Y", "X", at, "REQUEST: From Y to X"),
        ],
        REQUESTS,
    )


def test_offers_of_several_agencies(spark):
    times = spark.createDataFrame(
        [
            call("a", "A", "08:00:00", 1), call("a", "B", "08:30:00", 2),
            call("b", "A", "08:00:00", 1, "bus"), call("b", "B", "08:45:00", 2, "bus"),
        ],
        STOP_TIMES,
    )
    asked = requests(spark)
    scheduled = schedule.schedule_offers(asked, times, [RAIL, BUS])
    everything = schedule.stack_offers(
        scheduled, schedule.fixed_offers(asked, [FixedOffer("air", 40, 120, "plane")])
    )
    rows = {(r.request_id, r.agency): r for r in everything.collect()}
    carriers = ("rail", "bus", "air")
    assert set(rows) == {(r, a) for r in (1, 4) for a in carriers} | {(2, "air")}
    assert (rows[1, "rail"].eta_min, rows[1, "rail"].cost, rows[1, "rail"].departure_time) == (
        30, 8.6, "2024-01-01 07:30:00")
    assert (rows[1, "bus"].eta_min, rows[1, "bus"].cost, rows[1, "bus"].origin) == (45, 2.5, None)
    # Without an order check a trip that called there before gives negative minutes.
    assert (rows[4, "rail"].eta_min, rows[4, "rail"].cost) == (-30, 5.0)
    best = {r.request_id: r.agency for r in schedule.best_offer(everything).collect()}
    assert best == {1: "rail", 2: "air", 4: "bus"}
    cheap = schedule.best_offer(everything, ("cost", "eta_min", "agency")).collect()
    assert {r.request_id: r.agency for r in cheap} == {1: "bus", 2: "air", 4: "bus"}


def test_offers_from_agency_tables(spark):
    times = spark.createDataFrame([call("a", "A", "08:00:00", 1), call("a", "B", "08:30:00", 2)], STOP_TIMES)
    tables = schedule.agency_tables(spark, [RAIL, BUS])
    one = schedule.schedule_offers(requests(spark), times, tables).collect()
    assert sorted(one) == sorted(schedule.schedule_offers(requests(spark), times, [RAIL, BUS]).collect()) and one


def test_best_offer_ranks_absent_values_last(spark):
    df = spark.createDataFrame(
        [(1, "a", None, 1.0), (1, "b", 90, 5.0)], "request_id long, agency string, eta_min long, cost double"
    )
    assert schedule.best_offer(df).first().agency == "b"


def test_agency_without_fares_uses_its_default(spark):
    assert schedule.fare_table(spark, [BUS]).count() == 0
