"""Gap filling, windows, splits, origins and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.catalog.registry import query, rd, sql, table
from lanewise.functions import calendar as cal
from lanewise.operators import congestion, resample, windows

table("scaler", "SELECT avg(Vehicles) AS mean, stddev_pop(Vehicles) AS std FROM hourly", "hourly")
table("raw_scaler", "SELECT avg(Vehicles) AS mean, stddev_pop(Vehicles) AS std FROM obs", "obs")


@query("win_01_hourly_grid", sql(f"SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')} FROM grid", "grid"))
def win_01(spark, sf):
    return resample.hourly_grid(t.hourly(spark, sf))


@query("win_02_interpolate_both", sql(f"SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')} FROM filled", "filled"))
def win_02(spark, sf):
    return resample.fill_hourly(t.hourly(spark, sf), "both")


@query("win_03_interpolate_limit3", sql(f"SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')} FROM filled3", "filled3"))
def win_03(spark, sf):
    return resample.fill_hourly(t.hourly(spark, sf), "limit3")


@query("win_03_interpolate_limit3_by_zone", sql(f"""
SELECT Zone, RouteId, DateTime,
  CASE WHEN Vehicles IS NOT NULL THEN round(Vehicles + 1e-9, 6)
       WHEN pos - pp <= 3 THEN round(pv + (nv - pv) * (pos - pp) / (np - pp) + 1e-9, 6) END AS Vehicles
FROM (SELECT *,
    last_value(Vehicles IGNORE NULLS) OVER back AS pv,
    last_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pp,
    first_value(Vehicles IGNORE NULLS) OVER ahead AS nv,
    first_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np
  FROM (SELECT g.*, h.Vehicles, row_number() OVER (PARTITION BY g.Zone, g.RouteId ORDER BY g.DateTime) AS pos
        FROM (SELECT Zone, RouteId, unnest(generate_series(min(date_trunc('hour', DateTime)), max(date_trunc('hour', DateTime)), INTERVAL 1 HOUR)) AS DateTime
              FROM obs GROUP BY 1, 2) g
        LEFT JOIN (SELECT Zone, RouteId, date_trunc('hour', DateTime) AS DateTime, avg(Vehicles) AS Vehicles FROM obs GROUP BY 1, 2, 3) h
          USING (Zone, RouteId, DateTime))
  WINDOW back AS (PARTITION BY Zone, RouteId ORDER BY DateTime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY Zone, RouteId ORDER BY DateTime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""", "obs"))
def win_03_zone(spark, sf):
    """Series by zone are sparse, with gaps longer than the limit."""
    keys = ["Zone", "RouteId"]
    return resample.fill_hourly(resample.hourly_mean(t.obs(spark, sf), keys), "limit3", keys)


def _windows_sql(drop_last, scaled_target, scaler, source="numbered"):
    last = "s.p < s.n - 24" if drop_last else "s.p <= s.n - 24"
    y = "(r.Vehicles - mean) / std" if scaled_target else "r.Vehicles"
    return sql(f"""
SELECT s.RouteId, s.DateTime, s.p - 168 AS sample, CAST(count(*) FILTER (r.p < s.p) AS INTEGER) AS x_len,
       CAST(count(*) FILTER (r.p >= s.p) AS INTEGER) AS y_len,
       {rd('sum((r.Vehicles - mean) / std) FILTER (r.p < s.p)', 'x_sum', 5)},
       {rd('sum((r.Vehicles - mean) / std * sin(2 * pi() * hour(r.DateTime) / 24)) FILTER (r.p < s.p)', 'x_sin', 5)},
       {rd('sum((r.Vehicles - mean) / std) FILTER (r.p = s.p - 168)', 'x_first', 5)},
       {rd(f'sum({y}) FILTER (r.p >= s.p)', 'y_sum', 5)},
       {rd(f'sum({y}) FILTER (r.p = s.p + 23)', 'y_last', 5)}
FROM {source} s JOIN {source} r ON r.RouteId = s.RouteId AND r.p >= s.p - 168 AND r.p < s.p + 24
JOIN {scaler} ON true
WHERE s.p >= 168 AND {last}
GROUP BY 1, 2, 3
""", source, scaler)


def _digest(samples):
    """Numbers that depend on every element of both arrays and on their order."""
    return samples.select(
        "RouteId", "DateTime", F.col("sample").cast("long"),
        F.size("x").alias("x_len"), F.size("y").alias("y_len"),
        F.aggregate("x", F.lit(0.0), lambda a, s: a + s["v"]).alias("x_sum"),
        F.aggregate("x", F.lit(0.0), lambda a, s: a + s["v"] * s["hour_sin"]).alias("x_sin"),
        F.col("x")[0]["v"].alias("x_first"),
        F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("y_sum"),
        F.element_at("y", -1).alias("y_last"),
    )


@query("win_04_sequence_windows", _windows_sql(False, True, "scaler"), places=5)
def win_04(spark, sf):
    hourly = t.hourly(spark, sf)
    return _digest(windows.sequence_windows(hourly, scaler=windows.fit_scaler(hourly)))


@query("win_04_sequence_windows_drop_last", _windows_sql(True, True, "raw_scaler"), places=5)
def win_04_drop_last(spark, sf):
    scaler = windows.fit_scaler(t.obs(spark, sf))
    return _digest(
        windows.sequence_windows(t.hourly(spark, sf), scaler=scaler, drop_last=True, block_rows=100)
    )


table("filled3_numbered", """
SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) - 1 AS p,
       count(*) OVER (PARTITION BY RouteId) AS n
FROM filled3 WHERE Vehicles IS NOT NULL
""", "filled3")


@query("win_05_unscaled_target", _windows_sql(False, False, "raw_scaler", "filled3_numbered"), places=5)
def win_05(spark, sf):
    series = resample.fill_hourly(t.hourly(spark, sf), "limit3").where("Vehicles IS NOT NULL")
    scaler = windows.fit_scaler(t.obs(spark, sf))
    return _digest(windows.sequence_windows(series, scaler=scaler, scale_target=False))


@query("win_06_congestion_windows", sql(f"""
SELECT s.street_name, s.DateTime, s.p - 16 AS sample, s.n - 16 AS n_samples, CAST(s.is_congested AS DOUBLE) AS y,
       string_agg(CAST(r.is_congested AS VARCHAR), '' ORDER BY r.p) AS x_flags,
       {rd('sum(sin(2 * pi() * (hour(r.DateTime) * 60 + minute(r.DateTime)) / 1440))', 'x_time')},
       {rd('sum(cos(2 * pi() * (isodow(r.DateTime) - 1) / 7))', 'x_week')}
FROM slot_numbered s JOIN slot_numbered r ON r.street_name = s.street_name AND r.p >= s.p - 16 AND r.p < s.p
WHERE s.p >= 16 GROUP BY s.street_name, s.DateTime, s.p, s.n, s.is_congested
""", "slot_numbered"))
def win_06(spark, sf):
    samples = windows.congestion_windows(t.slots(spark, sf))
    flags = F.transform("x", lambda s: s["congested"].cast("int").cast("string"))
    return samples.select(
        "street_name", "DateTime", F.col("sample").cast("long"), "n_samples", "y",
        F.array_join(flags, "").alias("x_flags"),
        F.aggregate("x", F.lit(0.0), lambda a, s: a + s["time_sin"]).alias("x_time"),
        F.aggregate("x", F.lit(0.0), lambda a, s: a + s["week_cos"]).alias("x_week"),
    )


table("row_numbered", """
SELECT street_name, event_id, DateTime, CASE WHEN LOS IN ('D', 'E', 'F') THEN 1e0 ELSE 0e0 END AS v,
       row_number() OVER (PARTITION BY street_name ORDER BY DateTime, event_id) - 1 AS p,
       count(*) OVER (PARTITION BY street_name) AS n
FROM los_time
""", "los_time")


@query("win_07_value_windows", sql("""
SELECT s.street_name, s.DateTime, s.p - 12 AS sample, CAST(s.n - 12 AS BIGINT) AS n_samples, s.v AS y,
       string_agg(CAST(CAST(r.v AS INTEGER) AS VARCHAR), '' ORDER BY r.p) AS x_flags
FROM row_numbered s JOIN row_numbered r ON r.street_name = s.street_name AND r.p >= s.p - 12 AND r.p < s.p
WHERE s.p >= 12 GROUP BY s.street_name, s.DateTime, s.p, s.n, s.v
""", "row_numbered"))
def win_07(spark, sf):
    rows = congestion.with_slot_time(t.los(spark, sf)).withColumn(
        "is_congested", congestion.is_congested_row("LOS")
    )
    samples = windows.value_windows(rows, 12, order=["DateTime", "event_id"], block_rows=200)
    flags = F.transform("x", lambda v: v.cast("int").cast("string"))
    return samples.select(
        "street_name", "DateTime", F.col("sample").cast("long"), "n_samples", "y",
        F.array_join(flags, "").alias("x_flags"),
    )


@query("win_08_chronological_split", sql("""
SELECT RouteId, DateTime, CASE WHEN p < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS train_floor,
       CASE WHEN p < greatest(1, floor(n * 0.9e0)) THEN 'train' ELSE 'test' END AS train_min1,
       CASE WHEN p < n - greatest(1, floor(n * 0.2e0)) THEN 'train' ELSE 'test' END AS test_floor
FROM numbered
""", "numbered"))
def win_08(spark, sf):
    rows = windows.with_position(t.hourly(spark, sf), ["RouteId"], ["DateTime"])
    for rule, ratio in (("train_floor", 0.8), ("train_min1", 0.9), ("test_floor", 0.8)):
        rows = windows.chronological_split(rows, ratio, rule).withColumnRenamed("split", rule)
    return rows.select("RouteId", "DateTime", "train_floor", "train_min1", "test_floor")


@query("win_09_tail_history", sql(f"""
SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')}, count(*) OVER (PARTITION BY RouteId) AS n_history
FROM (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime DESC) AS age
      FROM hourly WHERE DateTime < TIMESTAMP '2024-01-20') WHERE age <= 168
""", "hourly"))
def win_09(spark, sf):
    return windows.tail_history(t.hourly(spark, sf), "2024-01-20")


@query("win_10_holdout", sql(f"""
SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')}, CASE WHEN n - p <= 24 THEN 'test' ELSE 'train' END AS split,
       192 - (n - p) AS step
FROM numbered WHERE n >= 192 AND n - p <= 192
""", "numbered"))
def win_10(spark, sf):
    return windows.holdout(t.hourly(spark, sf)).withColumn("step", F.col("step").cast("long"))


@query("win_11_evaluation_days", sql("""
SELECT 'last_20' AS asked, RouteId, CAST(unnest(generate_series(CAST(last - 19 AS TIMESTAMP), CAST(last - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS TIMESTAMP) AS origin FROM spans
UNION ALL
SELECT 'whole', RouteId, unnest(generate_series(CAST(first + 1 AS TIMESTAMP), CAST(last - 1 AS TIMESTAMP), INTERVAL 1 DAY)) FROM spans
UNION ALL
SELECT 'with_last', RouteId, unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) FROM spans
""", "spans"))
def win_11(spark, sf):
    obs = t.obs(spark, sf)
    parts = [
        windows.evaluation_days(obs, 20).withColumn("asked", F.lit("last_20")),
        windows.evaluation_days(obs, 365).withColumn("asked", F.lit("whole")),
        windows.evaluation_days(obs, 365, include_last=True).withColumn("asked", F.lit("with_last")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("asked", "RouteId", "origin")


def _origin_rows(hours):
    return sql(f"""
SELECT h.RouteId, o.origin, count(*) AS n, {rd('sum(h.Vehicles)', 'total')}, min(h.DateTime) AS first
FROM hourly h JOIN (SELECT RouteId, unnest(generate_series(CAST(first + 1 AS TIMESTAMP), CAST(last - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS origin FROM spans) o
  ON o.RouteId = h.RouteId AND h.DateTime >= o.origin - INTERVAL {hours} HOUR AND h.DateTime < o.origin
GROUP BY 1, 2
""", "hourly", "spans")


def _by_origin(spark, sf, hours):
    hourly = t.hourly(spark, sf)
    rows = windows.rows_by_origin(hourly, windows.evaluation_days(hourly, 365), hours)
    return rows.groupBy("RouteId", "origin").agg(
        F.count("*").alias("n"), F.sum("Vehicles").alias("total"), F.min("DateTime").alias("first")
    )


@query("win_11_rows_by_origin", _origin_rows(168))
def win_11_rows(spark, sf):
    return _by_origin(spark, sf, 168)


@query("win_11_rows_by_origin_part_day", _origin_rows(100))
def win_11_part_day(spark, sf):
    return _by_origin(spark, sf, 100)


@query("agg_11_scaler_hourly_base", sql(f"""
SELECT RouteId, {rd('avg(Vehicles)', 'mean')}, {rd('stddev_pop(Vehicles)', 'std')} FROM hourly GROUP BY 1
""", "hourly"))
def agg_11(spark, sf):
    return windows.fit_scaler(t.hourly(spark, sf), ["RouteId"])


@query("agg_11_scaler_raw_base", sql(f"""
SELECT c_nationkey, {rd('avg(c_acctbal)', 'mean')},
       round(CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1 ELSE stddev_pop(c_acctbal) END + 1e-9, 6) AS std
FROM customer GROUP BY 1
"""))
def agg_11_raw(spark, sf):
    return windows.fit_scaler(t.load(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")
