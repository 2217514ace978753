"""The pooled regression against numpy's least squares with one indicator column per route."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import windows
from lanewise.plans import forecast as fc
from lanewise.plans import pooled

DAY = dt.datetime(2024, 3, 1)
SCHEMA = "City string, RouteId string, origin timestamp_ntz, a double, b double, c double, y double"


def _rows(seed=3, days=6):
    random = np.random.default_rng(seed)
    rows = []
    for city, route, level in [("x", "p", 5.0), ("x", "q", -40.0), ("z", "p", 900.0)]:
        for day in range(days):
            for _ in range(7):
                a, b = random.normal(level, 3), random.normal(0, 20)
                rows.append((city, route, DAY + dt.timedelta(days=day), a, b, 7.0, 2 * a - 0.5 * b + level + random.normal()))
    return rows


def _expected(rows, city, day):
    """Slopes by plain least squares on the rows of a city before a day."""
    used = [r for r in rows if r[0] == city and r[2] < day]
    routes = sorted({r[1] for r in used})
    design = np.array([[r[3], r[4], *[float(r[1] == n) for n in routes]] for r in used])
    return np.linalg.lstsq(design, np.array([r[6] for r in used]), rcond=None)[0][:2], len(used), len(routes)


def _fit(spark, rows, asked):
    table = spark.createDataFrame(rows, SCHEMA)
    origins = spark.createDataFrame(asked, "City string, RouteId string, origin timestamp_ntz")
    return pooled.fit(table, origins, ["a", "b", "c"], "y", ["City", "RouteId"], ["City"])


def test_equals_least_squares_with_indicators(spark):
    rows = _rows()
    asked = [(c, r, DAY + dt.timedelta(days=d)) for c, r in [("x", "p"), ("x", "q"), ("z", "p")] for d in (2, 5, 9)]
    fits, centres = _fit(spark, rows, asked)
    got = fits.withColumn("left", pooled.gradient(4)).collect()
    assert len(got) == 6 and centres.count() == 9
    for row in got:
        slopes, n, routes = _expected(rows, row["City"], row["origin"])
        assert (row["n_rows"], row["n_routes"]) == (n, routes)
        assert row["slopes"][:2] == pytest.approx(slopes, rel=1e-8)
        assert row["slopes"][2] == 0.0  # a constant gets no slope
        assert row["left"] < 1e-9


def test_a_repeated_feature_gets_one_slope(spark):
    rows = [(*r[:4], 3 * r[3], *r[5:]) for r in _rows()]
    fits, _ = _fit(spark, rows, [("x", "p", DAY + dt.timedelta(days=6))])
    row = fits.withColumn("left", pooled.gradient(4)).first()
    assert row["slopes"][1] == 0.0 and row["left"] < 1e-4


def test_incomplete_rows_and_unknown_routes(spark):
    """Rows with a null do not count; a day without earlier rows has no fit, a new route no means."""
    rows = _rows() + [("x", "p", DAY, None, 1.0, 7.0, 1e9), ("x", "p", DAY, 1.0, 1.0, 7.0, None)]
    asked = [("x", "p", DAY), ("x", "p", DAY + dt.timedelta(days=3)), ("x", "new", DAY + dt.timedelta(days=3))]
    fits, centres = _fit(spark, rows, asked)
    by_day = {r["origin"]: r for r in fits.collect()}
    first, third = by_day[DAY], by_day[DAY + dt.timedelta(days=3)]
    assert (first["n_rows"], first["slopes"]) == (0, None)
    assert third["slopes"][:2] == pytest.approx(_expected(_rows(), "x", third["origin"])[0], rel=1e-8)
    assert centres.where("RouteId = 'new'").first()["means"] is None


def test_empty_table(spark):
    fits, centres = _fit(spark, [], [("x", "p", DAY)])
    assert [r["slopes"] for r in fits.collect()] == [None]
    assert [r["means"] for r in centres.collect()] == [None]
    assert _fit(spark, _rows(), [])[0].count() == 0


def test_days_after_an_origin_change_nothing(spark):
    rows, cut = _rows(), DAY + dt.timedelta(days=4)
    changed = [r if r[2] < cut else (*r[:6], r[6] * 50 + 1) for r in rows]
    one, two = (_fit(spark, r, [("x", "p", cut)])[0].first() for r in (rows, changed))
    assert one == two


def test_forecast_follows_a_linear_series(spark):
    """A route that grows by one fixed step a day is continued, and a short one has the baseline."""
    start = DAY
    long = [("r", start + dt.timedelta(hours=h), 100.0 + 3.0 * (h // 24) + h % 24) for h in range(24 * 30)]
    short = [("s", start + dt.timedelta(hours=h), 1.0) for h in range(24 * 3)]
    hourly = spark.createDataFrame(long + short, "RouteId string, DateTime timestamp_ntz, Vehicles double")
    origins = windows.evaluation_days(hourly, 2)
    got = fc.forecast(hourly, origins, ["linear"]).join(
        hourly.withColumnRenamed("Vehicles", "v"), ["RouteId", "DateTime"]
    )
    assert got.where("RouteId = 'r'").agg(F.max(F.abs(F.col("v") - F.col("PredictedVehicles")))).first()[0] < 1e-6
    used = {(r["RouteId"], r["model_used"]) for r in got.select("RouteId", "model_used").distinct().collect()}
    assert used == {("r", "linear"), ("s", "baseline")}
