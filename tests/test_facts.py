"""Hand-written cases for the semantics that are easiest to get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.functions import slugs, travel
from lanewise.operators import (
    congestion,
    filters,
    joins,
    metrics,
    resample,
    rollups,
    shape,
    windows,
)
from lanewise.plans import forecast as fc

T = dt.datetime
GAPPY = [None, 1.0, None, None, None, None, 6.0, None, None, None, None, None]


def one(spark, column, **values):
    """Value of a column expression on one row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "options, expected",
    [
        ({"limit": 3}, [None, 1, 2, 3, 4, None, 6, 6, 6, 6, None, None]),
        ({"both_ways": True}, [1, 1, 2, 3, 4, 5, 6, 6, 6, 6, 6, 6]),
    ],
)
def test_interpolate(spark, options, expected):
    data = [("r", T(2024, 1, 1) + dt.timedelta(hours=i), v) for i, v in enumerate(GAPPY)]
    df = spark.createDataFrame(data, "RouteId string, DateTime timestamp_ntz, Vehicles double")
    got = resample.interpolate(df, **options).orderBy("DateTime").collect()
    assert [r["Vehicles"] for r in got] == expected


def asof(spark, left, right):
    a = spark.createDataFrame(
        [("r", t, 0.0) for t in left], "RouteId string, DateTime timestamp_ntz, PredictedVehicles double"
    )
    b = spark.createDataFrame(
        [("r", t, float(v), i) for i, (t, v) in enumerate(right)],
        "RouteId string, DateTime timestamp_ntz, Vehicles double, i int",
    )
    found = joins.asof_nearest(a, b, right_order=F.col("i")).orderBy("DateTime").collect()
    return [r["Vehicles"] for r in found]


def test_asof_tie_takes_the_earlier_and_tolerance_is_inclusive(spark):
    assert asof(spark, [T(2024, 1, 1, 1)], [(T(2024, 1, 1, 0, 30), 1), (T(2024, 1, 1, 1, 30), 2)]) == [1]


def test_asof_duplicates(spark):
    at = T(2024, 1, 1, 5)
    assert asof(spark, [at], [(at, 3), (at, 4)]) == [4]
    later = T(2024, 1, 1, 1, 30)
    assert asof(spark, [T(2024, 1, 1, 1)], [(later, 7), (later, 8)]) == [7]


def test_asof_outside_tolerance_and_across_midnight(spark):
    assert asof(spark, [T(2024, 1, 1, 9)], [(T(2024, 1, 1, 9, 31), 1)]) == [None]
    assert asof(spark, [T(2024, 1, 2, 0, 5)], [(T(2024, 1, 1, 23, 50), 1)]) == [1]


def daily(spark, values, start=dt.date(2024, 1, 7)):
    data = [("r", start + dt.timedelta(days=i), 1.0, v) for i, v in enumerate(values)]
    return spark.createDataFrame(
        data, "RouteId string, Date date, DailyActual double, Daily_m double"
    )


def test_week_of_nulls_sums_to_zero_and_runs_monday_to_sunday(spark):
    got = rollups.weekly_sum(daily(spark, [None])).first()
    assert got["Weekly_m"] == 0.0
    assert got["WeekStart"] == T(2024, 1, 1)
    assert got["WeekEnd"] == T(2024, 1, 7, 23, 59, 59, 999999)
    assert got["WeekRange"] == "2024-01-01 → 2024-01-07"


def test_half_even_rounding(spark):
    assert one(spark, F.bround(F.lit(0.25), 1)) == 0.2
    assert [one(spark, F.bround(F.lit(v), 0)) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_last_month_clamps_the_day(spark):
    df = spark.createDataFrame(
        [("r", T(2024, 3, 31, 10)), ("r", T(2024, 2, 29, 10)), ("r", T(2024, 2, 29, 9, 59))],
        "RouteId string, DateTime timestamp_ntz",
    )
    assert filters.last_month(df).count() == 2


def pairs(spark, data):
    return spark.createDataFrame(data, "k string, Actual double, Pred double")


def test_mape_modes(spark):
    df = pairs(spark, [("a", 0.0, 1.0), ("a", 2.0, 1.0)])
    skip = metrics.error_metrics(df, ["k"]).first()
    null = metrics.error_metrics(df, ["k"], mape_mode="null").first()
    assert skip["mape"] == 50.0
    assert null["mape"] is None


def test_r2_of_a_constant_actual(spark):
    df = pairs(spark, [("bad", 1.0, 1.0), ("bad", 1.0, 2.0), ("good", 1.0, 1.0), ("good", 1.0, 1.0)])
    null = {r["k"]: r["r2"] for r in metrics.error_metrics(df, ["k"]).collect()}
    sklearn = {r["k"]: r["r2"] for r in metrics.error_metrics(df, ["k"], r2_mode="sklearn").collect()}
    assert null == {"bad": None, "good": None}
    assert sklearn == {"bad": 0.0, "good": 1.0}


def test_smape_denominators(spark):
    df = pairs(spark, [("a", 0.0, 0.0), ("a", 1.0, 3.0)])
    assert metrics.error_metrics(df, ["k"]).first()["smape"] == 50.0
    assert metrics.error_metrics(df, ["k"], smape_mode="eps").first()["smape"] == pytest.approx(50.0)


def test_metrics_ignore_missing_values(spark):
    df = pairs(spark, [("a", 1.0, None), ("a", float("nan"), 2.0), ("a", 2.0, 2.0)])
    assert metrics.error_metrics(df, ["k"]).first()["n"] == 1


def slots(spark, values, pct="CongestionPct"):
    return spark.createDataFrame(
        [("s", label, v) for label, v in values], f"street_name string, TimeLabel string, {pct} double"
    )


def test_two_smallest_on_ties(spark):
    df = slots(spark, [("b", 50.0), ("a", 50.0), ("c", 50.0)])
    assert sorted(r["TimeLabel"] for r in congestion.best_slots(df).collect()) == ["a", "b"]


def test_worst_slots_need_some_congestion(spark):
    assert congestion.worst_slots(slots(spark, [("a", 0.0), ("b", 0.0)])).count() == 0
    assert congestion.worst_slots(slots(spark, [("a", 0.0), ("b", 5.0), ("c", 2.0)])).count() == 2
    passing = congestion.worst_slots(slots(spark, [("a", 70.0), ("b", 80.0), ("c", 90.0)]))
    assert passing.count() == 3


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 4.0), (None, None)], "a double, b double")
    got = [r["m"] for r in df.select(fc.mean_of_present(["a", "b"]).alias("m")).collect()]
    assert got == [2.0, 4.0, None]


@pytest.mark.parametrize(
    "rule, expected",
    [
        (slugs.slug_ascii_only, "uong_ly_thuong_kiet"),
        (slugs.slug_keep_letters, "đuong_ly_thuong_kiet"),
        (slugs.slug, "duong_ly_thuong_kiet"),
    ],
)
def test_slugs(spark, rule, expected):
    assert one(spark, rule(F.lit("Đường Lý Thường Kiệt"))) == expected


def test_slug_of_decomposed_and_odd_text(spark):
    assert one(spark, slugs.slug(F.lit("  Ðường -- số ½ é! "))) == "duong_so_e"
    assert one(spark, slugs.slug(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize("n, total", [(30, 150), (25, 125), (13, 65)])
def test_estimated_sequences(spark, n, total):
    assert one(spark, metrics.estimated_sequences(F.lit(n))) == total


def test_linear_quantile(spark):
    data = [("r", T(2024, 1, 1, h), v) for h, v in enumerate([1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(data, "RouteId string, DateTime timestamp_ntz, PredictedVehicles double")
    got = [r["TrafficLevel"] for r in rollups.with_traffic_level(df).orderBy("DateTime").collect()]
    assert got == ["Thưa thớt", "Trung bình", "Trung bình", "Rất đông"]


@pytest.mark.parametrize(
    "letters, expected", [(["D", "A"], 1), ([None, "D"], 1), ([None, None, "D"], 0), (["d"], 0)]
)
def test_majority_of_segments(spark, letters, expected):
    df = spark.createDataFrame(
        [("s", T(2024, 1, 1), x) for x in letters], "street_name string, DateTime timestamp_ntz, LOS string"
    )
    assert congestion.congested_slots(df).first()["is_congested"] == expected


def test_period_forms(spark):
    good = cal.period_timestamp(F.lit("2024-01-02"), F.lit("period_7_30"))
    assert one(spark, good) == T(2024, 1, 2, 7, 30)
    assert one(spark, cal.period_timestamp(F.lit("2024-01-02"), F.lit("morning"))) is None
    assert one(spark, cal.numbered_period_timestamp(F.lit("2024-01-02"), F.lit("3"))) == T(2024, 1, 2, 1)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-01 05:00:00", T(2024, 1, 1, 5)),
        ("2024-01-01T05:00:00+07:00", T(2023, 12, 31, 22)),
        ("2024-01-01 05:00:00Z", T(2024, 1, 1, 5)),
        ("2024-01-01", T(2024, 1, 1)),
        ("31/31/2024", None),
        ("", None),
    ],
)
def test_parse_utc_in_any_session_zone(spark, text, expected):
    for zone in ("UTC", "America/New_York", "Asia/Ho_Chi_Minh"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert one(spark, cal.parse_utc(F.lit(text))) == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hour_floor_ignores_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist on this day in the session zone.
        at = F.lit("2024-03-10 02:30:15.5").cast("timestamp_ntz")
        assert one(spark, cal.hour_floor(at)) == T(2024, 3, 10, 2)
        assert one(spark, cal.slot_floor(at)) == T(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_weekday_starts_on_monday(spark):
    assert one(spark, F.weekday(F.lit("2024-01-01").cast("date"))) == 0
    assert one(spark, cal.weekday_day_label(F.lit("2024-01-07").cast("timestamp_ntz"))) == "Chủ nhật 07/01"


def test_shift_keeps_weekday_and_time(spark):
    shifted = cal.shift_to_week_of(F.lit("2018-10-31 13:05:00").cast("timestamp_ntz"), "2025-11-18")
    assert one(spark, shifted) == T(2025, 11, 19, 13, 5)


def test_next_slots(spark):
    now = F.lit("2024-05-05 16:41:09").cast("timestamp_ntz")
    assert one(spark, cal.next_slots(now)) == [
        T(2024, 5, 5, 17), T(2024, 5, 5, 17, 30), T(2024, 5, 5, 18), T(2024, 5, 5, 18, 30)
    ]
    assert one(spark, cal.local_clock("2024-05-05 16:41:09")) == T(2024, 5, 5, 23, 41, 9)


@pytest.mark.parametrize(
    "p, level, slowdown", [(0.7, "high", "medium"), (0.4, "medium", "medium"), (0.3, "low", "low"), (0.71, "high", "high")]
)
def test_two_threshold_scales(spark, p, level, slowdown):
    assert one(spark, travel.congestion_level(F.lit(p))) == level
    assert one(spark, travel.slowdown_level(F.lit(p))) == slowdown


def test_travel_minutes_has_a_speed_floor(spark):
    assert one(spark, travel.travel_minutes(F.lit(1.5), F.lit(4.0))) == 20.0
    assert one(spark, travel.travel_minutes(F.lit(0.9), F.lit(1.0), 10.0)) == 12.0


def test_bad_input_is_dropped_not_raised(spark):
    df = spark.createDataFrame(
        [("r", "2024-01-01", "1"), ("r", "x", "1"), ("r", "2024-01-01", "n/a"), (None, "2024-01-01", "2")],
        "RouteId string, DateTime string, Vehicles string",
    )
    assert filters.clean_observations(df).count() == 1


def test_infinite_and_nan_points_do_not_widen_the_box(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (float("nan"), 50.0), (3.0, math.inf), (None, 9.0), (2.0, 1.0)], "lat double, lon double"
    )
    assert tuple(congestion.bounding_box(df).first()) == (1.0, 2.0, 1.0, 2.0)


def test_model_without_values_has_no_rows(spark):
    long = shape.sources_long(daily(spark, [None, None]), "Daily", "Date")
    assert {r["Source"] for r in long.collect()} == {"Actual"}


def test_scaler_of_a_constant_series(spark):
    df = spark.createDataFrame([("r", 5.0), ("r", 5.0)], "RouteId string, Vehicles double")
    assert tuple(windows.fit_scaler(df).first()) == (5.0, 1.0)


def test_published_street_scores_are_reproduced(spark):
    """Stored probabilities of one street and the scores published for them."""
    actual = [1, 0, 1, 1, 1, 0, 0, 1, 0, 1, 1, 1, 1]
    p = [
        0.52041787, 0.53758085, 0.5304047, 0.5053667, 0.5333758, 0.53245336, 0.54238534, 0.55560213,
        0.5336577, 0.493749, 0.4673122, 0.4623514, 0.4558435,
    ]
    df = pairs(spark, [("s", float(a), b) for a, b in zip(actual, p)])
    got = metrics.common_metrics(df, ["k"], "Actual", "Pred", "binary_prob").first()
    assert got["MSE"] == pytest.approx(0.26054610471444384, abs=1e-7)
    assert got["MAE"] == pytest.approx(0.5093580002968128, abs=1e-7)
    assert got["SMAPE"] == pytest.approx(107.4495833190525, abs=1e-4)
    assert got["Accuracy"] == pytest.approx(38.46153846153847)
