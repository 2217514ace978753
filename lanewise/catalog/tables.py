"""Inputs of the queries, derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.catalog.registry import table
from lanewise.functions import calendar as cal
from lanewise.operators import congestion, resample, rollups


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").selectExpr(
        "event_id",
        "ts AS DateTime",
        "'Metro' AS City",
        "concat('Z', user_id % 4 + 1) AS Zone",
        "event_type AS RouteId",
        "value AS Vehicles",
    )


table("obs", """
SELECT event_id, ts AS DateTime, 'Metro' AS City, 'Z' || CAST(user_id % 4 + 1 AS VARCHAR) AS Zone,
       event_type AS RouteId, value AS Vehicles
FROM events
""")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return resample.hourly_mean(obs(spark, sf))


table("hourly", """
SELECT RouteId, date_trunc('hour', DateTime) AS DateTime, avg(Vehicles) AS Vehicles
FROM obs GROUP BY 1, 2
""", "obs")

table("numbered", """
SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) - 1 AS p,
       count(*) OVER (PARTITION BY RouteId) AS n
FROM hourly
""", "hourly")

table("spans", """
SELECT RouteId, CAST(min(DateTime) AS DATE) AS first, CAST(max(DateTime) AS DATE) AS last FROM obs GROUP BY RouteId
""", "obs")

table("grid", """
SELECT g.RouteId, g.DateTime, h.Vehicles,
       row_number() OVER (PARTITION BY g.RouteId ORDER BY g.DateTime) AS pos
FROM (SELECT RouteId, unnest(generate_series(min(DateTime), max(DateTime), INTERVAL 1 HOUR)) AS DateTime
      FROM hourly GROUP BY RouteId) g
LEFT JOIN hourly h USING (RouteId, DateTime)
""", "hourly")

table("around", """
SELECT RouteId, DateTime, Vehicles, pos,
  last_value(Vehicles IGNORE NULLS) OVER back AS pv,
  last_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pp,
  first_value(Vehicles IGNORE NULLS) OVER ahead AS nv,
  first_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np
FROM grid
WINDOW back AS (PARTITION BY RouteId ORDER BY DateTime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       ahead AS (PARTITION BY RouteId ORDER BY DateTime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""", "grid")

# The grid begins and ends with known values, so both neighbours always exist.
table("filled", """
SELECT RouteId, DateTime,
       CASE WHEN Vehicles IS NOT NULL THEN Vehicles ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END AS Vehicles
FROM around
""", "around")

table("filled3", """
SELECT RouteId, DateTime,
       CASE WHEN Vehicles IS NOT NULL THEN Vehicles
            WHEN pos - pp <= 3 THEN pv + (nv - pv) * (pos - pp) / (np - pp) END AS Vehicles
FROM around
""", "around")


def los(spark: SparkSession, sf: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') AS int)"
    return load(spark, sf, "events").selectExpr(
        "event_id",
        "event_type AS street_name",
        "user_id AS segment_id",
        "cast(ts AS date) AS date",
        "concat('period_', hour(ts), '_', CASE WHEN minute(ts) < 30 THEN 0 ELSE 30 END) AS period",
        f"substr('ABCDEF', cast({k} * 6 div 100 AS int) + 1, 1) AS LOS",
        "10.7e0 + (user_id % 100) / 1000e0 AS lat_snode",
        "106.6e0 + (user_id % 70) / 1000e0 AS long_snode",
        "10.7e0 + (user_id % 100) / 1000e0 + 0.004e0 AS lat_enode",
        "106.6e0 + (user_id % 70) / 1000e0 + 0.004e0 AS long_enode",
    )


table("los", """
SELECT event_id, event_type AS street_name, user_id AS segment_id, CAST(ts AS DATE) AS date,
       'period_' || CAST(hour(ts) AS VARCHAR) || '_' || CASE WHEN minute(ts) < 30 THEN '0' ELSE '30' END AS period,
       substr('ABCDEF', CAST(json_extract_string(props, '$.k') AS INTEGER) * 6 // 100 + 1, 1) AS LOS,
       10.7e0 + (user_id % 100) / 1000e0 AS lat_snode,
       106.6e0 + (user_id % 70) / 1000e0 AS long_snode,
       10.7e0 + (user_id % 100) / 1000e0 + 0.004e0 AS lat_enode,
       106.6e0 + (user_id % 70) / 1000e0 + 0.004e0 AS long_enode
FROM events
""")

table("los_time", """
SELECT *, CAST(date AS TIMESTAMP) + to_hours(CAST(split_part(period, '_', 2) AS INTEGER))
          + to_minutes(CAST(split_part(period, '_', 3) AS INTEGER)) AS DateTime
FROM los
""", "los")


def slots(spark: SparkSession, sf: str) -> DataFrame:
    return congestion.congested_slots(los(spark, sf))


table("slots", """
SELECT street_name, DateTime,
       CAST(avg(CASE WHEN LOS IN ('D', 'E', 'F') THEN 1e0 ELSE 0e0 END) >= 0.5 AS INTEGER) AS is_congested
FROM los_time GROUP BY 1, 2
""", "los_time")

table("slot_numbered", """
SELECT *, row_number() OVER (PARTITION BY street_name ORDER BY DateTime) - 1 AS p,
       count(*) OVER (PARTITION BY street_name) AS n
FROM slots
""", "slots")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """A second family that spans several years."""
    return load(spark, sf, "lineitem").selectExpr(
        "l_shipdate AS DateTime", "l_returnflag AS RouteId", "l_quantity AS Vehicles",
        "l_orderkey", "l_linenumber",
    )


table("sales", """
SELECT l_shipdate AS DateTime, l_returnflag AS RouteId, l_quantity AS Vehicles, l_orderkey, l_linenumber
FROM lineitem
""")


def geo(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "r_name AS city",
        "n_name AS zone",
        "lower(n_name) AS route_id",
        "concat(n_name, ' (HCMC)') AS name",
        "n_nationkey * 1.5e0 - 20e0 AS lat",
        "CASE WHEN n_nationkey % 7 = 3 THEN cast('NaN' AS double) ELSE n_regionkey * 10e0 + n_nationkey END AS lon",
    )


table("geo", """
SELECT r_name AS city, n_name AS zone, lower(n_name) AS route_id, n_name || ' (HCMC)' AS name,
       n_nationkey * 1.5e0 - 20e0 AS lat,
       CASE WHEN n_nationkey % 7 = 3 THEN CAST('NaN' AS DOUBLE) ELSE n_regionkey * 10e0 + n_nationkey END AS lon
FROM nation JOIN region ON n_regionkey = r_regionkey
""")


def daily_wide(spark: SparkSession, sf: str, source=obs) -> DataFrame:
    """Daily actuals next to the totals one and seven days before, null where there are none."""
    daily = rollups.daily_sum(source(spark, sf))

    def moved(days: int, name: str) -> DataFrame:
        return daily.select(
            "RouteId", F.date_add("Date", days).alias("Date"), F.col("DailyActual").alias(name)
        )

    return daily.join(moved(1, "Daily_lag1"), ["RouteId", "Date"], "left").join(
        moved(7, "Daily_lag7"), ["RouteId", "Date"], "left"
    )


def _daily_tables(source: str, prefix: str) -> None:
    table(f"{prefix}daily", f"""
SELECT RouteId, CAST(DateTime AS DATE) AS Date, sum(Vehicles) AS DailyActual FROM {source} GROUP BY 1, 2
""", source)
    table(f"{prefix}daily_wide", f"""
SELECT d.RouteId, d.Date, d.DailyActual, a.DailyActual AS Daily_lag1, b.DailyActual AS Daily_lag7
FROM {prefix}daily d
LEFT JOIN {prefix}daily a ON a.RouteId = d.RouteId AND a.Date + 1 = d.Date
LEFT JOIN {prefix}daily b ON b.RouteId = d.RouteId AND b.Date + 7 = d.Date
""", f"{prefix}daily")


_daily_tables("obs", "")
_daily_tables("sales", "sales_")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly actuals with two simple predictions, long by model."""
    actual = hourly(spark, sf)
    parts = []
    for model, lag in (("lag1", 1), ("lag24", 24)):
        moved = actual.select(
            "RouteId", cal.plus_hours("DateTime", lag).alias("DateTime"),
            F.col("Vehicles").alias("Pred"), F.lit(model).alias("model"),
        )
        parts.append(actual.withColumnRenamed("Vehicles", "Actual").join(moved, ["RouteId", "DateTime"]))
    return parts[0].unionByName(parts[1])


table("pairs", """
SELECT a.RouteId, a.DateTime, a.Vehicles AS Actual, p.Vehicles AS Pred, m.model
FROM (VALUES ('lag1', 1), ('lag24', 24)) m(model, lag)
JOIN hourly p ON true
JOIN hourly a ON a.RouteId = p.RouteId AND a.DateTime = p.DateTime + to_hours(m.lag)
""", "hourly")


def slot_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Slots with the street's mean for that time of day as probability."""
    s = slots(spark, sf).withColumns({"hour": F.hour("DateTime"), "minute": F.minute("DateTime")})
    means = s.groupBy("street_name", "hour", "minute").agg(F.avg("is_congested").alias("p"))
    return s.join(means, ["street_name", "hour", "minute"]).select(
        "street_name", "DateTime", F.col("is_congested").cast("double").alias("Actual"), "p"
    )


table("slot_pairs", """
SELECT street_name, DateTime, CAST(is_congested AS DOUBLE) AS Actual,
       avg(is_congested) OVER (PARTITION BY street_name, hour(DateTime), minute(DateTime)) AS p
FROM slots
""", "slots")


def daily_scores(spark: SparkSession, sf: str) -> DataFrame:
    from lanewise.operators import metrics

    rows = pairs(spark, sf).withColumn("date", F.to_date("DateTime"))
    return metrics.error_metrics(rows, ["RouteId", "date", "model"])


# A day with one value has no variance and hence no R2.
table("daily_scores", """
SELECT RouteId, CAST(DateTime AS DATE) AS date, model, count(*) AS n,
       avg((Actual - Pred) * (Actual - Pred)) AS mse,
       sqrt(avg((Actual - Pred) * (Actual - Pred))) AS rmse,
       avg(abs(Actual - Pred)) AS mae,
       avg(CASE WHEN Actual <> 0 THEN abs((Actual - Pred) / Actual) END) * 100 AS mape,
       avg(2 * abs(Pred - Actual) / CASE WHEN abs(Actual) + abs(Pred) = 0 THEN 1 ELSE abs(Actual) + abs(Pred) END) * 100 AS smape,
       CASE WHEN count(*) * var_pop(Actual) <> 0
            THEN 1 - sum((Actual - Pred) * (Actual - Pred)) / (count(*) * var_pop(Actual)) END AS r2
FROM pairs GROUP BY 1, 2, 3
""", "pairs")
