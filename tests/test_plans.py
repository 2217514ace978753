"""Physical plans: no all-pairs joins, pruned scans, spread windows, Python only where declared."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lanewise.catalog import QUERIES
from lanewise.catalog import tables as t
from lanewise.operators import filters, joins, windows
from lanewise.sources import observations

USES_PYTHON = {
    "fc_08_train_logit", "fc_08_test_split", "fc_10_rollout_logit", "fc_14_evaluate_streets",
    "fc_14_evaluation_detail", "fc_17_next_two_hours", "fc_17_two_hour_summary", "fc_18_model_registry",
}

# A window over the hours of the feed's one route, over the distinct routes of one city, and over the
# days of one family.
ONE_SMALL_GROUP = {
    "src_04_interstate_hourly", "fc_07_linear_samples", "fc_07_linear", "fc_07_linear_certificate", "fc_07_linear_backtest",
}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if name not in USES_PYTHON:
        assert "InPandas" not in plan and "PythonUDF" not in plan and "EvalPython" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line) and name not in ONE_SMALL_GROUP:
            assert not any("SinglePartition" in below for below in lines[i + 1 : i + 4])


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("obs") / "ds")
    observations.write_observations(t.obs(spark, sf), root)
    return root


def test_slice_reaches_the_scan(spark, stored):
    plan = plan_of(
        observations.load_slice(spark, stored, "Metro", "Z2", ["click"], "2024-01-05", "2024-01-10")
    )
    partition = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan).group(1)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert "City" in partition and "Zone" in partition
    assert "GreaterThanOrEqual(DateTime" in pushed and "LessThan(DateTime" in pushed
    assert "RouteId" in pushed
    assert "Exchange" not in plan


def test_only_needed_columns_are_read(spark, stored):
    counts = observations.read_observations(spark, stored).groupBy("RouteId").agg(F.sum("Vehicles"))
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(counts)).group(1)
    assert schema == "RouteId:string,Vehicles:double"


def test_asof_windows_are_split_by_hour(spark, sf):
    obs = t.obs(spark, sf)
    left = obs.select("RouteId", "DateTime", F.col("Vehicles").alias("PredictedVehicles"))
    plan = plan_of(joins.asof_nearest(left, obs))
    assert re.search(r"Exchange hashpartitioning\(RouteId#\d+, _bucket#\d+", plan)


def test_windows_are_split_by_block(spark, sf):
    plan = plan_of(windows.sequence_windows(t.hourly(spark, sf)))
    assert re.search(r"Exchange hashpartitioning\(RouteId#\d+, _block#\d+L?", plan)


def test_backtest_scans_stored_hours_only(spark):
    plan = plan_of(QUERIES["fc_13_backtest_top_models"](spark, "/root/testdata/sf0.001"))
    assert "events.parquet" not in plan and "FileScan parquet" in plan


def test_one_route_with_most_rows_is_spread(spark):
    """A route with nearly all rows: windows of raw rows hold one block each, whatever its size."""
    n = 20000
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(n).select(
        F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("street_name"),
        (start + F.make_dt_interval(mins=(F.col("id") * 7 % 200000).cast("int"))).alias("DateTime"),
        F.col("id"), (F.col("id") % 2).alias("is_congested"),
    )
    samples = windows.value_windows(rows, 5, order=["DateTime", "id"], block_rows=500)
    assert samples.count() == n - 2 * 5
    plan = plan_of(samples)
    assert re.search(r"hashpartitioning\(street_name#\d+, _block#\d+", plan_of(samples))


def test_one_hot_day_is_numbered_by_all_tasks(spark):
    """All rows in one minute of one street: ranges split it, and the numbers have no gap."""
    rows = spark.range(8000).select(
        F.when(F.col("id") == 0, None).otherwise("hot").alias("street_name"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("DateTime"), (F.col("id") * 7 % 8000).alias("id"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = windows.with_ranged_position(rows, ["street_name"], ["DateTime", "id"])
        got = placed.where("street_name = 'hot'").orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["pos"] for r in got] == list(range(7999)) and {r["n"] for r in got} == {7999}
    assert [(r["pos"], r["n"]) for r in placed.where("street_name IS NULL").collect()] == [(0, 1)]
    tasks = spark.read.parquet(*placed.inputFiles()).groupBy("_task").count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 2000


def test_ranged_positions_equal_plain_ones(spark, sf):
    rows = t.los(spark, sf)
    order = ["date", "period", "event_id"]
    plain = windows.with_position(rows, ["street_name"], order)
    ranged = windows.with_ranged_position(rows, ["street_name"], order)
    columns = ["event_id", "pos", "n"]
    assert plain.select(*columns).exceptAll(ranged.select(*columns)).count() == 0
    assert ranged.count() == rows.count() > 0
    empty = windows.with_ranged_position(rows.limit(0), ["street_name"], order)
    assert empty.count() == 0


def test_recent_rows_reach_the_scan(spark, stored):
    """The least start is a value of the second scan's filter, where Spark puts it at run time."""
    obs = spark.read.parquet(stored)
    for recent in (filters.last_days(obs, 3), filters.last_month(obs)):
        scans = re.findall(r"DataFilters: \[(.*?)\], Format", plan_of(recent))
        assert any(re.search(r"DateTime#\d+ >= (scalar-subquery|Subquery)", s) for s in scans), scans


def test_asof_of_one_hot_moment(spark):
    """Many left rows at one time match through one distinct row."""
    at = dt.datetime(2024, 1, 1, 12)
    left = spark.range(5000).select(
        F.lit("r").alias("RouteId"), F.lit(at).cast("timestamp_ntz").alias("DateTime"), "id"
    )
    right = spark.createDataFrame([("r", at, 3.0)], "RouteId string, DateTime timestamp_ntz, Vehicles double")
    got = joins.asof_nearest(left, right)
    assert got.where("Vehicles = 3").count() == 5000
