"""Daily, weekly, monthly and hour-of-day rollups, and summaries of a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.operators.filters import last_month
from lanewise.operators.joins import on_hour_spine
from lanewise.operators.resample import group_by_hour

# Names of the numbered zones.
ZONE_NAMES = {1: "North", 2: "South", 3: "East", 4: "West"}


def daily_sum(
    df: DataFrame,
    keys: Sequence[str] = ("RouteId",),
    ts: str = "DateTime",
    value: str = "Vehicles",
    name: str = "DailyActual",
) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("Date")).agg(F.sum(value).alias(name))


def _period_sum(
    daily: DataFrame, keys: Sequence[str], period: str, start, end
) -> DataFrame:
    """Sum every Daily* column; a period with only nulls sums to 0."""
    first, last = f"{period}Start", f"{period}End"
    adjective = {"Week": "Weekly", "Month": "Monthly"}[period]
    sums = [
        F.coalesce(F.sum(c), F.lit(0.0)).alias(c.replace("Daily", adjective, 1))
        for c in daily.columns
        if c.startswith("Daily")
    ]
    return (
        daily.groupBy(*keys, start.cast("timestamp_ntz").alias(first))
        .agg(*sums)
        .withColumn(last, cal.last_microsecond(end(F.to_date(first))))
        .withColumn(f"{period}Range", cal.range_label(first, last))
    )


def weekly_sum(daily: DataFrame, keys: Sequence[str] = ("RouteId",)) -> DataFrame:
    """Monday to Sunday totals of every Daily* column, with week bounds and label."""
    return _period_sum(daily, keys, "Week", cal.week_start("Date"), lambda d: F.date_add(d, 6))


def monthly_sum(daily: DataFrame, keys: Sequence[str] = ("RouteId",)) -> DataFrame:
    """Calendar month totals of every Daily* column, with month bounds and label."""
    return _period_sum(daily, keys, "Month", cal.month_start("Date"), F.last_day)


def hourly_profile_last_month(obs: DataFrame, keys: Sequence[str] = ("RouteId",)) -> DataFrame:
    """Mean by hour of day over each series' last month: 24 rows per series, two decimals."""
    recent = last_month(obs, keys)
    means = recent.groupBy(*keys, F.hour("DateTime").alias("Hour")).agg(
        F.bround(F.avg("Vehicles"), 2).alias("VehiclesPerHour")
    )
    return on_hour_spine(means, keys, "Hour", "VehiclesPerHour")


def volume_by_zone(obs: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Total per zone with the zone's display name, from the number in the zone code."""
    pairs = [F.lit(x) for item in (names or ZONE_NAMES).items() for x in item]
    number = F.regexp_extract("Zone", r"(\d+)", 1).try_cast("int")
    return (
        obs.groupBy("Zone")
        .agg(F.sum("Vehicles").alias("TotalVehicles"))
        .withColumn("ZoneName", F.try_element_at(F.create_map(*pairs), number))
    )


def mean_by_hour_of_day(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return obs.groupBy(*keys, F.hour("DateTime").alias("HourOfDay")).agg(
        F.avg("Vehicles").alias("MeanVehicles")
    )


def mean_by_day_of_week(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return obs.groupBy(*keys, F.weekday("DateTime").alias("DayOfWeek")).agg(
        F.avg("Vehicles").alias("MeanVehicles")
    )


def volume_over_time(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return daily_sum(obs, keys, name="Vehicles")


def series_summary(obs: DataFrame, keys: Sequence[str] = ("RouteId",)) -> DataFrame:
    """First and last time, rows and distinct days. Grouping by day first keeps it two-phase."""
    per_day = obs.groupBy(*keys, F.to_date("DateTime").alias("_day")).agg(
        F.min("DateTime").alias("first"), F.max("DateTime").alias("last"), F.count("*").alias("rows")
    )
    return per_day.groupBy(*keys).agg(
        F.min("first").alias("MinDateTime"),
        F.max("last").alias("MaxDateTime"),
        F.sum("rows").alias("Rows"),
        F.count("_day").alias("Days"),
    )


def collapse_hours(
    forecast: DataFrame, values: Sequence[str], keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """Average forecasts that fall in the same hour."""
    return group_by_hour(forecast, keys, "DateTime", [F.avg(c).alias(c) for c in values])


def day_summary(
    forecast: DataFrame, keys: Sequence[str] = ("RouteId",), value: str = "PredictedVehicles"
) -> DataFrame:
    """Peak, low and mean of each day; the earliest hour wins a tie."""
    ts, v = F.col("DateTime"), F.col(value)
    return forecast.groupBy(*keys, F.to_date(ts).alias("Date")).agg(
        F.min_by(ts, F.struct(-v, ts)).alias("PeakTime"),
        F.max(v).alias("PeakValue"),
        F.min_by(ts, F.struct(v, ts)).alias("LowTime"),
        F.min(v).alias("LowValue"),
        F.avg(v).alias("MeanValue"),
    )


def with_traffic_level(
    forecast: DataFrame,
    keys: Sequence[str] = ("RouteId",),
    value: str = "PredictedVehicles",
    labels: tuple[str, str, str] = ("Rất đông", "Trung bình", "Thưa thớt"),
) -> DataFrame:
    """Heavy, normal or light against the day's own 80 % and 20 % quantiles.

    Apply after ``collapse_hours``: a day then has at most 24 rows.
    """
    w = Window.partitionBy(*keys, F.to_date("DateTime"))
    heavy, normal, light = labels
    v = F.col(value)
    return (
        forecast.withColumn("_q", F.percentile(v, F.array(F.lit(0.2), F.lit(0.8))).over(w))
        .withColumn(
            "TrafficLevel",
            F.when(v >= F.col("_q")[1], heavy).when(v <= F.col("_q")[0], light).otherwise(normal),
        )
        .drop("_q")
    )
