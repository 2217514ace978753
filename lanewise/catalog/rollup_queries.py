"""Rollups and summaries of volume."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.catalog.filter_queries import _MONTHLY, _TRAVEL, _WEEKLY, _probabilities
from lanewise.catalog.registry import query, rd, sql
from lanewise.functions import calendar as cal
from lanewise.operators import congestion, reports, resample, rollups
from lanewise.plans import forecast as fc


@query("agg_01_hourly_mean", sql(f"SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')} FROM hourly", "hourly"))
def agg_01(spark, sf):
    return t.hourly(spark, sf)


@query("agg_02_daily_sum", sql(f"SELECT RouteId, Date, {rd('DailyActual', 'DailyActual')} FROM daily", "daily"))
def agg_02(spark, sf):
    return rollups.daily_sum(t.obs(spark, sf))


@query("agg_02_daily_sum_of_years", sql(
    f"SELECT RouteId, Date, {rd('DailyActual', 'DailyActual')} FROM sales_daily", "sales_daily"))
def agg_02_years(spark, sf):
    return rollups.daily_sum(t.sales(spark, sf))


def _weekly_sql(p):
    return sql(f"""
SELECT RouteId, WeekStart, {rd('WeeklyActual', 'WeeklyActual')}, {rd('Weekly_lag1', 'Weekly_lag1')},
       {rd('Weekly_lag7', 'Weekly_lag7')}, WeekStart + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS WeekEnd,
       strftime(WeekStart, '%Y-%m-%d') || ' → ' || strftime(WeekStart + INTERVAL 6 DAY, '%Y-%m-%d') AS WeekRange
FROM ({_WEEKLY.format(p=p)})
""", f"{p}daily_wide")


@query("agg_03_weekly_sum", _weekly_sql(""))
def agg_03(spark, sf):
    return rollups.weekly_sum(t.daily_wide(spark, sf))


@query("agg_03_weekly_sum_of_years", _weekly_sql("sales_"))
def agg_03_years(spark, sf):
    return rollups.weekly_sum(t.daily_wide(spark, sf, t.sales))


def _monthly_sql(p):
    return sql(f"""
SELECT RouteId, MonthStart, {rd('MonthlyActual', 'MonthlyActual')}, {rd('Monthly_lag1', 'Monthly_lag1')},
       {rd('Monthly_lag7', 'Monthly_lag7')}, MonthStart + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS MonthEnd,
       strftime(MonthStart, '%Y-%m-%d') || ' → ' || strftime(last_day(MonthStart), '%Y-%m-%d') AS MonthRange
FROM ({_MONTHLY.format(p=p)})
""", f"{p}daily_wide")


@query("agg_04_monthly_sum", _monthly_sql(""))
def agg_04(spark, sf):
    return rollups.monthly_sum(t.daily_wide(spark, sf))


@query("agg_04_monthly_sum_of_years", _monthly_sql("sales_"))
def agg_04_years(spark, sf):
    return rollups.monthly_sum(t.daily_wide(spark, sf, t.sales))


def _profile_sql(source):
    return sql(f"""
SELECT r.RouteId, CAST(h.Hour AS INTEGER) AS Hour, round_even(m.v, 2) AS VehiclesPerHour
FROM (SELECT DISTINCT RouteId FROM {source}) r, (SELECT unnest(range(24)) AS Hour) h
LEFT JOIN (SELECT o.RouteId, hour(o.DateTime) AS Hour, avg(o.Vehicles) AS v FROM {source} o
           JOIN (SELECT RouteId, max(DateTime) - INTERVAL 1 MONTH AS start FROM {source} GROUP BY 1) s USING (RouteId)
           WHERE o.DateTime >= s.start GROUP BY 1, 2) m
  ON m.RouteId = r.RouteId AND m.Hour = h.Hour
""", source)


@query("agg_05_hourly_profile", _profile_sql("obs"))
def agg_05(spark, sf):
    return rollups.hourly_profile_last_month(t.obs(spark, sf))


@query("agg_05_hourly_profile_of_years", _profile_sql("sales"))
def agg_05_years(spark, sf):
    return rollups.hourly_profile_last_month(t.sales(spark, sf))


@query("agg_13_bounding_box", sql("""
SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon
FROM geo WHERE isfinite(lat) AND isfinite(lon)
""", "geo"))
def agg_13(spark, sf):
    return congestion.bounding_box(t.geo(spark, sf))


@query("agg_14_volume_by_zone", sql(f"""
SELECT Zone, ['North', 'South', 'East', 'West'][CAST(substr(Zone, 2) AS INTEGER)] AS ZoneName, {rd('sum(Vehicles)', 'TotalVehicles')}
FROM obs GROUP BY Zone
""", "obs"))
def agg_14(spark, sf):
    return rollups.volume_by_zone(t.obs(spark, sf))


@query("agg_15_mean_by_hour", sql(f"""
SELECT CAST(hour(DateTime) AS INTEGER) AS HourOfDay, {rd('avg(Vehicles)', 'MeanVehicles')} FROM obs GROUP BY 1
""", "obs"))
def agg_15(spark, sf):
    return rollups.mean_by_hour_of_day(t.obs(spark, sf))


@query("agg_16_mean_by_weekday", sql(f"""
SELECT CAST(isodow(DateTime) - 1 AS INTEGER) AS DayOfWeek, {rd('avg(Vehicles)', 'MeanVehicles')} FROM obs GROUP BY 1
""", "obs"))
def agg_16(spark, sf):
    return rollups.mean_by_day_of_week(t.obs(spark, sf))


@query("agg_16_volume_over_time", sql(f"""
SELECT CAST(DateTime AS DATE) AS Date, {rd('sum(Vehicles)', 'Vehicles')} FROM sales GROUP BY 1
""", "sales"))
def agg_16_time(spark, sf):
    return rollups.volume_over_time(t.sales(spark, sf))


@query("agg_17_series_summary", sql("""
SELECT RouteId, min(DateTime) AS MinDateTime, max(DateTime) AS MaxDateTime, count(*) AS Rows,
       count(DISTINCT CAST(DateTime AS DATE)) AS Days
FROM sales GROUP BY RouteId
""", "sales"))
def agg_17(spark, sf):
    return rollups.series_summary(t.sales(spark, sf))


# Hours of the week from a Thursday on, so that equal weekdays fall together.
_SHIFTED = """
SELECT RouteId, TIMESTAMP '2024-01-18' + to_days(CAST((isodow(DateTime) - 4 + 7) % 7 AS INTEGER))
       + to_hours(CAST(hour(DateTime) AS INTEGER)) AS DateTime,
       avg(Vehicles) AS PredictedVehicles, avg(Vehicles / 2) AS Pred_half
FROM obs GROUP BY 1, 2
"""


def _shifted(spark, sf):
    rows = t.obs(spark, sf).withColumn("DateTime", cal.shift_to_week_of("DateTime", "2024-01-18"))
    return rollups.collapse_hours(
        rows.withColumnRenamed("Vehicles", "PredictedVehicles").withColumn(
            "Pred_half", F.col("PredictedVehicles") / 2
        ),
        ["PredictedVehicles", "Pred_half"],
    )


@query("agg_19_collapse_hours", sql(f"""
SELECT RouteId, DateTime, {rd('PredictedVehicles', 'PredictedVehicles')}, {rd('Pred_half', 'Pred_half')} FROM ({_SHIFTED})
""", "obs"))
def agg_19(spark, sf):
    return _shifted(spark, sf)


@query("agg_20_day_summary", sql(f"""
SELECT RouteId, CAST(DateTime AS DATE) AS Date, arg_min(DateTime, row(-Vehicles, DateTime)) AS PeakTime,
       {rd('max(Vehicles)', 'PeakValue')}, arg_min(DateTime, row(Vehicles, DateTime)) AS LowTime,
       {rd('min(Vehicles)', 'LowValue')}, {rd('avg(Vehicles)', 'MeanValue')}
FROM hourly GROUP BY 1, 2
""", "hourly"))
def agg_20(spark, sf):
    return rollups.day_summary(t.hourly(spark, sf), value="Vehicles")


@query("agg_20_day_summary_with_ties", sql("""
SELECT RouteId, CAST(DateTime AS DATE) AS Date, arg_min(DateTime, row(-v, DateTime)) AS PeakTime,
       max(v) AS PeakValue, arg_min(DateTime, row(v, DateTime)) AS LowTime, min(v) AS LowValue,
       round(avg(v) + 1e-9, 6) AS MeanValue
FROM (SELECT RouteId, DateTime, round_even(Vehicles / 100, 0) AS v FROM hourly) GROUP BY 1, 2
""", "hourly"))
def agg_20_ties(spark, sf):
    coarse = t.hourly(spark, sf).withColumn("v", F.bround(F.col("Vehicles") / 100, 0))
    return rollups.day_summary(coarse, value="v")


@query("agg_21_next_hours_summary", sql(f"""
SELECT street_name, {rd('30 * sum(least(greatest(p, 0), 1))', 'expected_congested_minutes')},
       {rd('avg(least(greatest(p, 0), 1))', 'mean_probability')}, count(*) AS n_slots,
       string_agg(TimeLabel, ',' ORDER BY ts, TimeLabel) FILTER (p >= 0.7) AS avoid_slots,
       string_agg(TimeLabel, ',' ORDER BY ts, TimeLabel) FILTER (p <= 0.3) AS good_slots
FROM (SELECT street_name, ts, TimeLabel, p FROM
        (SELECT event_type AS street_name, date_trunc('hour', ts) AS ts, strftime(date_trunc('hour', ts), '%H:%M') AS TimeLabel,
                avg(CAST(json_extract_string(props, '$.k') AS INTEGER) / 80e0 - 0.1e0) AS p
         FROM events GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY street_name ORDER BY ts DESC) <= 4)
GROUP BY street_name
"""))
def agg_21(spark, sf):
    """The four latest hours of every street, as many as the report is made for."""
    hours = _probabilities(spark, sf).groupBy(
        "street_name", cal.hour_floor("DateTime").alias("DateTime")
    ).agg(F.avg("p").alias("p"))
    latest = F.row_number().over(Window.partitionBy("street_name").orderBy(F.desc("DateTime")))
    four = hours.withColumn("place", latest).where("place <= 4").drop("place")
    labelled = four.withColumn("TimeLabel", F.date_format("DateTime", "HH:mm"))
    summary = reports.next_hours_summary(labelled, ["street_name"])
    return summary.withColumns({
        c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in ("avoid_slots", "good_slots")
    })


@query("agg_22_travel_summary", sql(f"""
SELECT street_name, {rd('avg(m)', 'mean_minutes')}, max(m) AS worst_minutes,
       arg_min(TimeLabel, row(-m, TimeLabel)) AS worst_slot, {rd('max(free_minutes)', 'free_minutes')},
       max(length_km) AS length_km
FROM (SELECT *, round_even(travel_minutes, 1) AS m FROM ({_TRAVEL})) GROUP BY street_name
"""))
def agg_22(spark, sf):
    table = reports.travel_table(_probabilities(spark, sf), ["street_name"])
    return reports.travel_summary(table, ["street_name"])


@query("agg_01_hourly_totals", sql(f"""
SELECT RouteId, date_trunc('hour', DateTime) AS DateTime, {rd('sum(Vehicles)', 'Total')}, count(*) AS Rows,
       {rd('avg(Vehicles)', 'Vehicles')}
FROM sales GROUP BY 1, 2
""", "sales"))
def agg_01_totals(spark, sf):
    return fc.hourly_totals(t.sales(spark, sf))


@query("agg_01_hourly_mean_by_zone", sql(f"""
SELECT Zone, RouteId, date_trunc('hour', DateTime) AS DateTime, {rd('avg(Vehicles)', 'Vehicles')} FROM obs GROUP BY 1, 2, 3
""", "obs"))
def agg_01_zone(spark, sf):
    return resample.hourly_mean(t.obs(spark, sf), ["Zone", "RouteId"])
