"""Properties over the test tables, and comparison with pandas on random input."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.operators import congestion, joins, metrics, resample, rollups, windows
from lanewise.plans import advisor, backtest, streets
from lanewise.plans import forecast as fc


@pytest.fixture(scope="module")
def hourly(spark, sf):
    return t.hourly(spark, sf).cache()


@pytest.fixture(scope="module")
def slots(spark, sf):
    return t.slots(spark, sf).cache()


def test_window_counts(hourly):
    n = {r["RouteId"]: r["count"] for r in hourly.groupBy("RouteId").count().collect()}
    for drop_last in (False, True):
        samples = windows.sequence_windows(hourly, drop_last=drop_last)
        got = {r["RouteId"]: r["count"] for r in samples.groupBy("RouteId").count().collect()}
        assert got == {k: v - 168 - 24 + (0 if drop_last else 1) for k, v in n.items()}


@pytest.mark.parametrize("block", [1, 7, 50, 100000])
def test_block_size_does_not_change_windows(hourly, block):
    def digest(size):
        w = windows.sequence_windows(hourly, 30, 5, block_rows=size)
        return w.select(
            F.count("*"), F.sum(F.xxhash64("RouteId", "sample", "DateTime", "x", "y").cast("decimal(38,0)"))
        ).first()

    assert digest(block) == digest(64)


def test_strided_windows(hourly):
    every = windows.sequence_windows(hourly, 48, 24)
    some = windows.sequence_windows(hourly, 48, 24, stride=24)
    assert some.count() == every.where("sample % 24 = 0").count()


def test_position_by_chunks_equals_plain_position(spark, sf):
    rows = t.los(spark, sf).withColumn("DateTime", F.col("date").cast("timestamp_ntz"))
    order = ["DateTime", "event_id"]
    plain = windows.with_position(rows, ["street_name"], order)
    split = windows.with_position(rows, ["street_name"], order, chunk=F.col("date"))
    columns = ["event_id", "pos", "n"]
    assert plain.select(*columns).exceptAll(split.select(*columns)).count() == 0


def test_weekly_and_monthly_totals_equal_daily(spark, sf):
    wide = t.daily_wide(spark, sf, t.sales)
    total = wide.agg(F.sum("DailyActual")).first()[0]
    weekly = rollups.weekly_sum(wide).agg(F.sum("WeeklyActual")).first()[0]
    monthly = rollups.monthly_sum(wide).agg(F.sum("MonthlyActual")).first()[0]
    assert weekly == pytest.approx(total) == monthly


def test_forecast_shape_and_model_used(hourly):
    origins = windows.evaluation_days(hourly, 365)
    for minimum in (None, 120):
        got = fc.forecast(hourly, origins, fc.MODELS, min_history=minimum).cache()
        per_origin = got.groupBy("RouteId", "origin", "model").count()
        assert per_origin.where("count <> 24").count() == 0
        assert per_origin.count() == origins.count() * len(fc.MODELS)
        assert got.where("PredictedVehicles < 0 OR PredictedVehicles IS NULL").count() == 0
        sequence = got.where(~F.col("model").isin(*fc.FITTED))
        short = F.col("n_history") < (168 if minimum is None else minimum)
        assert sequence.where(short & (F.col("model_used") != "baseline")).count() == 0
        kinds = {r["model_used"] for r in got.select("model_used").distinct().collect()}
        assert "baseline" in kinds and "ar1" in kinds
        assert ("seasonal_naive" in kinds) == (minimum is not None)


def test_complete_history_uses_the_model(hourly):
    filled = resample.fill_hourly(hourly, "both")
    got = fc.forecast_day(filled, "2024-01-20", "profile")
    assert {r["model_used"] for r in got.collect()} == {"profile"}


def test_no_fit_sees_its_origin(hourly):
    """Changing values from an origin on leaves that origin's forecasts as they were."""
    origins = hourly.select("RouteId").distinct().withColumn(
        "origin", F.lit("2024-01-15").cast("timestamp_ntz")
    )
    changed = hourly.withColumn(
        "Vehicles", F.when(F.col("DateTime") >= "2024-01-15", F.col("Vehicles") * 9 + 1).otherwise(F.col("Vehicles"))
    )

    def run(series):
        rows = fc.forecast(series, origins, fc.MODELS, min_history=100)
        return rows.withColumn("PredictedVehicles", F.round("PredictedVehicles", 7))

    assert run(hourly).exceptAll(run(changed)).count() == 0


def test_backtest_counts_model_answers(spark, sf):
    daily = backtest.daily_metrics(t.obs(spark, sf), days=10, models=["seasonal_naive", "ar1"])
    strict = daily.where("model = 'seasonal_naive'").agg(F.sum("n_model")).first()[0]
    fitted = daily.where("model = 'ar1'").agg(F.sum(F.col("n") - F.col("n_model"))).first()[0]
    assert strict == 0 and fitted == 0


def test_rollout_stops_without_rows(spark):
    start = dt.datetime(2024, 1, 1)
    few = [("r", start + dt.timedelta(hours=i), 1.0) for i in range(100)]
    enough = [("s", start + dt.timedelta(hours=i), float(i % 24)) for i in range(24 * 8)]
    obs = spark.createDataFrame(few + enough, "RouteId string, DateTime timestamp_ntz, Vehicles double")
    got = fc.rollout(obs, n_days=9).orderBy("DateTime").collect()
    assert len(got) == 9 * 24 and {r["RouteId"] for r in got} == {"s"}
    assert all(r["PredictedVehicles"] == r["DateTime"].hour for r in got)


def test_ar1_on_a_known_process(spark):
    """A noise-free process x' = 0.5 x + 10 is continued exactly."""
    values, x = [], 100.0
    for _ in range(48):
        values.append(x)
        x = 0.5 * x + 10 + (1e-3 if len(values) % 2 else 0)
    start = dt.datetime(2024, 1, 1)
    rows = [("r", start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    hourly = spark.createDataFrame(rows, "RouteId string, DateTime timestamp_ntz, Vehicles double")
    got = fc.forecast_day(hourly, "2024-01-03", "ar1").orderBy("DateTime").collect()
    assert got[0]["model_used"] == "ar1"
    assert got[-1]["PredictedVehicles"] == pytest.approx(20.0, abs=0.01)


def test_probabilities_lie_in_the_unit_interval(slots):
    detail, summary = streets.evaluate_streets(slots, ["logit"])
    assert detail.where("Predicted_prob < 0 OR Predicted_prob > 1 OR Predicted_prob IS NULL").count() == 0
    assert summary.where("Accuracy < 0 OR Accuracy > 100").count() == 0


def test_rollout_feeds_back_labels(slots):
    flip = lambda df: df.withColumn("p", 1.0 - F.element_at("x", -1)["congested"])
    got = streets.rollout_next(slots, flip).orderBy("street_name", "step").collect()
    for i in range(0, len(got), 4):
        p = [r["p"] for r in got[i : i + 4]]
        assert p == [p[0], 1 - p[0], p[0], 1 - p[0]]


def test_street_training_status(spark):
    start = dt.datetime(2024, 1, 1)
    sizes = {"short": 26, "small": 60, "fine": 90}
    rows = [
        (s, start + dt.timedelta(minutes=30 * i), (i // 3) % 2) for s, n in sizes.items() for i in range(n)
    ]
    slots = spark.createDataFrame(rows, "street_name string, DateTime timestamp_ntz, is_congested int")
    registry = streets.train_streets(slots)[1].collect()
    assert {r["street_name"]: r["status"] for r in registry} == {
        "short": "skipped_too_short", "small": "skipped_small_test", "fine": "trained"
    }
    assert {r["street_name"]: r["acc"] is None for r in registry} == {
        "short": True, "small": True, "fine": False
    }


def test_learnable_street_is_learned(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("s", start + dt.timedelta(minutes=30 * i), (i // 4) % 2) for i in range(400)]
    slots = spark.createDataFrame(rows, "street_name string, DateTime timestamp_ntz, is_congested int")
    got = streets.train_streets(slots)[1].first()
    assert got["acc"] > 0.95 and got["f1"] > 0.95


def test_advice_covers_every_street(slots):
    got = advisor.departure_advice(slots, 0, "evening")
    assert got.count() == slots.select("street_name").distinct().count()


# pandas on random input.

def test_interpolation_equals_pandas(spark):
    rng = random.Random(3)
    rows = []
    for key in "abcd":
        for i in range(300):
            value = None if rng.random() < 0.6 else round(rng.uniform(0, 100), 2)
            rows.append((key, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), value))
    df = spark.createDataFrame(rows, "RouteId string, DateTime timestamp_ntz, Vehicles double")
    frame = pd.DataFrame(rows, columns=["RouteId", "DateTime", "Vehicles"])
    for options, how in (({"limit": 3}, {"limit": 3}), ({"both_ways": True}, {"limit_direction": "both"})):
        got = resample.interpolate(df, **options).orderBy("RouteId", "DateTime").toPandas()
        want = frame.groupby("RouteId")["Vehicles"].transform(lambda s: s.interpolate(**how))
        np.testing.assert_allclose(got["Vehicles"].astype(float), want, rtol=1e-12, equal_nan=True)


def test_grid_equals_pandas(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 2, 27, 21)
    rows = [
        (k, start + dt.timedelta(minutes=rng.randrange(60 * 24 * 5)), float(rng.randrange(100)))
        for k in "ab" for _ in range(60)
    ]
    df = spark.createDataFrame(rows, "RouteId string, DateTime timestamp_ntz, Vehicles double")
    got = resample.hourly_grid(resample.hourly_mean(df)).orderBy("RouteId", "DateTime").toPandas()
    frame = pd.DataFrame(rows, columns=["RouteId", "DateTime", "Vehicles"]).set_index("DateTime")
    want = frame.groupby("RouteId")["Vehicles"].resample("1h").mean().reset_index()
    assert list(got["DateTime"]) == list(want["DateTime"])
    np.testing.assert_allclose(got["Vehicles"].astype(float), want["Vehicles"], equal_nan=True)


def test_asof_equals_pandas(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)

    def moments(n):
        return [
            (rng.choice("xyz"), start + dt.timedelta(seconds=rng.randrange(4 * 86400))) for _ in range(n)
        ]

    left = [(k, at, float(i)) for i, (k, at) in enumerate(moments(500))]
    right = [(k, at, float(i), i) for i, (k, at) in enumerate(moments(400))]
    a = spark.createDataFrame(left, "RouteId string, DateTime timestamp_ntz, PredictedVehicles double")
    b = spark.createDataFrame(right, "RouteId string, DateTime timestamp_ntz, Vehicles double, i int")
    got = joins.asof_nearest(a, b, right_order=F.col("i")).toPandas().sort_values("PredictedVehicles")
    pa = pd.DataFrame(left, columns=["RouteId", "DateTime", "PredictedVehicles"]).sort_values("DateTime")
    pb = pd.DataFrame(right, columns=["RouteId", "DateTime", "Vehicles", "i"]).sort_values(
        ["DateTime", "i"], kind="stable"
    )
    want = pd.merge_asof(
        pa, pb, on="DateTime", by="RouteId", direction="nearest", tolerance=pd.Timedelta("30min")
    ).sort_values("PredictedVehicles")
    np.testing.assert_array_equal(got["Vehicles"].astype(float), want["Vehicles"])


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a, p = rng.normal(100, 20, 500), rng.normal(100, 25, 500)
    df = spark.createDataFrame([("k", float(x), float(y)) for x, y in zip(a, p)], "k string, Actual double, Pred double")
    got = metrics.error_metrics(df, ["k"]).first()
    assert got["rmse"] == pytest.approx(np.sqrt(np.mean((a - p) ** 2)))
    assert got["r2"] == pytest.approx(1 - np.sum((a - p) ** 2) / np.sum((a - a.mean()) ** 2))
    assert got["smape"] == pytest.approx(np.mean(2 * np.abs(a - p) / (np.abs(a) + np.abs(p))) * 100)


def test_congested_row_forms(spark):
    df = spark.createDataFrame([("a",), ("d",), ("E",), ("4",), ("3.9",), (None,)], "LOS string")
    got = [r[0] for r in df.select(congestion.is_congested_row()).collect()]
    assert got == [0.0, 1.0, 1.0, 1.0, 0.0, 0.0]
