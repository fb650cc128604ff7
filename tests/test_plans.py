"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from tripflow.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_single_task_python_or_cross_join(spark, name):
    text = plan(spark, name)
    for unwanted in ("SinglePartition", "PythonUDF", "BatchEvalPython", "MapInPandas",
                     "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


@pytest.mark.parametrize("name", ["top_flows_per_mode", "flow_rank", "top_od_500", "last_entries"])
def test_top_rows_are_cut_before_each_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") == 4


@pytest.mark.parametrize(
    "name, columns",
    [
        ("mode_popularity", {"l_linenumber", "l_quantity", "l_tax", "l_shipdate"}),
        ("tract_flows", {"l_suppkey", "l_partkey", "l_shipdate"}),
        # Of the log dealt by position only the sums' columns are stored and read.
        ("token_suffix_sum", {"agent_id", "idx", "tokens", "__part", "__place"}),
        ("last_entries", {"conv_id", "turn", "role", "text"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(spark, name))
    assert schemas and all({f.split(":")[0] for f in s.split(",")} <= columns for s in schemas)


def test_route_patterns_explode_lists_without_ends(spark):
    exploded = [x for x in plan(spark, "route_patterns").splitlines() if "Generate posexplode" in x]
    assert exploded and not any("start_lat" in x or "distance_miles" in x for x in exploded)


def test_no_aggregate_carries_sketches_per_route(spark):
    text = plan(spark, "mode_statistics")
    sketches = [x for x in text.splitlines() if "percentile_approx" in x and "keys=" in x]
    assert sketches and not any("start_lat" in x for x in sketches)


def test_windows_over_departures_see_numbers_of_distinct_seconds(spark):
    text = plan(spark, "next_departure")
    window = text[text.index("Window [last("):]
    above_scan = window[: window.index("FileScan")]
    assert "dest_stop" not in above_scan.split("Union")[0]
    assert "collect_set" not in text and "array<" not in above_scan.split("Union")[0]


def test_missing_trajectories_build_no_texts(spark):
    text = plan(spark, "missing_trajectory")
    assert "listagg" not in text


def test_statistics_rank_no_flows(spark):
    for name in ("flow_stats", "dataset_report"):
        assert "start_lat" not in "".join(x for x in plan(spark, name).splitlines() if "Window" in x)
