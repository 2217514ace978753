"""Sources and sinks: rows are written to a fresh folder and read back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise import schemas
from lanewise.catalog import tables as t
from lanewise.catalog.registry import query, rd, sql
from lanewise.functions import slugs
from lanewise.operators import congestion, filters, metrics, windows
from lanewise.plans import forecast as fc
from lanewise.session import scratch_path
from lanewise.sources import artifacts, observations, raw

START, END = "2024-01-05 06:30:00", "2024-01-27T07:00:00+07:00"


def _stored_obs(spark, sf):
    root = scratch_path(spark, "obs")
    observations.write_observations(t.obs(spark, sf), root)
    return root


@query("src_01_load_slice", sql("""
SELECT DateTime, RouteId, Vehicles FROM obs
WHERE City = 'Metro' AND Zone = 'Z2' AND RouteId IN ('click', 'view', 'error')
  AND DateTime >= TIMESTAMP '2024-01-05 06:30:00' AND DateTime < TIMESTAMP '2024-01-27 00:00:00'
""", "obs"))
def src_01(spark, sf):
    root = _stored_obs(spark, sf)
    return observations.load_slice(
        spark, root, "Metro", "Z2", ["click", "view", "error"], START, END
    )


@query("src_01_load_plain_folders", sql("""
SELECT Zone, DateTime, RouteId, Vehicles FROM obs
""", "obs"))
def src_01_plain(spark, sf):
    """Folders named by city and zone without keys, all zones; rows without zone lie in the city's."""
    root = scratch_path(spark, "plain")
    rows = t.obs(spark, sf)
    for zone in [r["Zone"] for r in rows.select("Zone").distinct().collect()]:
        part = rows.where(F.col("Zone").eqNullSafe(zone)).select("DateTime", "RouteId", "Vehicles")
        part.write.mode("append").parquet(f"{root}/Metro" + (f"/{zone}" if zone is not None else ""))
    loaded = observations.load_all(spark, root, layout="plain")
    return filters.in_city_zone(loaded, "Metro", "(All)").select(
        "Zone", "DateTime", "RouteId", "Vehicles"
    )


@query("src_02_load_all", sql("SELECT DateTime, RouteId, Vehicles, City, Zone FROM obs", "obs"))
def src_02(spark, sf):
    return observations.load_all(spark, _stored_obs(spark, sf))


@query("src_01_mixed_types", sql("""
SELECT Zone, DateTime, RouteId, CASE WHEN Zone = 'Z2' THEN trunc(Vehicles) ELSE Vehicles END AS Vehicles FROM obs
WHERE Zone <> 'Z2' OR Vehicles IS NOT NULL
""", "obs"))
def src_01_mixed(spark, sf):
    """Whole counts in one zone's files, times and counts as text in another's, doubles in the rest."""
    root = scratch_path(spark, "mixed")
    rows = t.obs(spark, sf)
    clock = F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    stored_as = [
        (F.col("Zone") == "Z2", F.col("DateTime"), F.col("Vehicles").cast("bigint")),
        (F.col("Zone") == "Z3", clock, F.col("Vehicles").cast("string")),
        (F.coalesce(~F.col("Zone").isin("Z2", "Z3"), F.lit(True)), F.col("DateTime"), F.col("Vehicles")),
    ]
    for chosen, time, vehicles in stored_as:
        part = rows.where(chosen).select(time.alias("DateTime"), "RouteId", vehicles.alias("Vehicles"), "City", "Zone")
        part.write.mode("append").partitionBy("City", "Zone").parquet(root)
    return observations.load_all(spark, root).select("Zone", "DateTime", "RouteId", "Vehicles")


@query("src_02_nanosecond_times", sql("""
SELECT 'Metro' AS City, Zone, DateTime, RouteId, Vehicles FROM obs
""", "obs"))
def src_02_nanoseconds(spark, sf):
    """Files as a pandas program leaves them, one a task, with times in nanoseconds."""
    root = scratch_path(spark, "nanoseconds")

    def write(batches):
        import uuid

        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for zone, part in batch.groupby("Zone", dropna=False):
                named = "__HIVE_DEFAULT_PARTITION__" if pd.isna(zone) else zone
                frame = pa.Table.from_pandas(
                    part[["DateTime", "RouteId", "Vehicles"]].astype({"DateTime": "datetime64[ns]"}), preserve_index=False
                )
                system, folder = fs.FileSystem.from_uri(f"{root if '://' in root else 'file://' + root.removeprefix('file:')}")
                folder = f"{folder}/City=Metro/Zone={named}"
                system.create_dir(folder)
                pq.write_table(frame, f"{folder}/{uuid.uuid4().hex}.parquet", filesystem=system)
            yield pd.DataFrame({"rows": [len(batch)]})

    t.obs(spark, sf).select("DateTime", "RouteId", "Vehicles", "Zone").mapInPandas(write, "rows long").agg(F.sum("rows")).collect()
    return observations.load_all(spark, root).select("City", "Zone", "DateTime", "RouteId", "Vehicles")


def _interstate_csv(spark, sf, volume):
    path = scratch_path(spark, "interstate")
    t.load(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_time"),
        volume.alias("traffic_volume"),
        F.col("event_type").alias("weather_main"),
    ).write.option("header", "true").csv(path)
    return path


@query("src_03_interstate_csv", sql("""
SELECT date_trunc('second', ts) AS DateTime, value AS Vehicles, 'I-94-WB' AS RouteId
FROM events WHERE event_id % 10 <> 0
"""))
def src_03(spark, sf):
    volume = F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return raw.read_interstate(spark, _interstate_csv(spark, sf, volume))


@query("src_04_interstate_hourly", sql("""
SELECT 'I-94-WB' AS RouteId, DateTime,
       round(CASE WHEN Vehicles IS NOT NULL THEN Vehicles
                  WHEN pos - pp <= 3 THEN pv + (nv - pv) * (pos - pp) / (np - pp) END + 1e-9, 6) AS Vehicles
FROM (
  SELECT DateTime, Vehicles, pos,
    last_value(Vehicles IGNORE NULLS) OVER back AS pv,
    last_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pp,
    first_value(Vehicles IGNORE NULLS) OVER ahead AS nv,
    first_value(CASE WHEN Vehicles IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np
  FROM (
    WITH h AS (SELECT date_trunc('hour', DateTime) AS DateTime, avg(Vehicles) AS Vehicles FROM obs WHERE Vehicles IS NOT NULL GROUP BY 1)
    SELECT g.DateTime, h.Vehicles, row_number() OVER (ORDER BY g.DateTime) AS pos
    FROM (SELECT unnest(generate_series(min(DateTime), max(DateTime), INTERVAL 1 HOUR)) AS DateTime FROM h) g LEFT JOIN h USING (DateTime))
  WINDOW back AS (ORDER BY DateTime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (ORDER BY DateTime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""", "obs"))
def src_04(spark, sf):
    """The numbers of every event type."""
    return raw.read_interstate_hourly(spark, _interstate_csv(spark, sf, F.col("value").cast("string")))


@query("src_05_wide_counter_csv", sql("""
SELECT DateTime, 'Bridge-' || RouteId AS RouteId, round(Vehicles + 1e-9, 6) AS Vehicles
FROM hourly
""", "hourly"))
def src_05(spark, sf):
    """A column per route; the distinct routes are the width of the file."""
    path = scratch_path(spark, "wide")
    hourly = t.hourly(spark, sf)
    names = sorted(r["RouteId"] for r in hourly.select("RouteId").distinct().collect())
    wide = hourly.groupBy("DateTime").pivot("RouteId", names).agg(F.first("Vehicles"))
    wide.withColumn("Date", F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss")).select(
        "Date", *names
    ).write.option("header", "true").csv(path)
    columns = {n: f"Bridge-{n}" for n in [*names, "absent"]}
    return raw.read_bridge(spark, path, columns)


def _stored_los(spark, sf):
    path = scratch_path(spark, "los")
    rows = t.los(spark, sf).withColumn("weekday", F.weekday("date"))
    rows.select(
        F.col("event_id").alias("_id"), "segment_id", "date", "weekday", "period", "LOS",
        "street_name", "lat_snode", "long_snode", "lat_enode", "long_enode",
    ).write.option("header", "true").csv(path)
    return path


_LOS_SQL = sql("""
SELECT CAST(event_id AS VARCHAR) AS _id, street_name, CAST(segment_id AS VARCHAR) AS segment_id,
       DateTime, LOS, round(lat_snode + 1e-9, 6) AS lat_snode, round(long_enode + 1e-9, 6) AS long_enode
FROM los_time
""", "los_time")
_LOS_COLUMNS = ["_id", "street_name", "segment_id", "DateTime", "LOS", "lat_snode", "long_enode"]


@query("src_06_street_los_csv", _LOS_SQL)
def src_06(spark, sf):
    return raw.read_level_of_service(spark, _stored_los(spark, sf)).select(*_LOS_COLUMNS)


@query("src_06_street_los_declared", _LOS_SQL)
def src_06_declared(spark, sf):
    return raw.read_level_of_service_declared(spark, _stored_los(spark, sf)).select(*_LOS_COLUMNS)


@query("src_07_route_geo_json", sql("""
SELECT city, zone, route_id, CAST(NULL AS VARCHAR) AS name, lat,
       CASE WHEN isnan(lon) THEN NULL ELSE lon END AS lon
FROM geo
""", "geo"))
def src_07(spark, sf):
    """A file without names reads as null names."""
    path = scratch_path(spark, "geo")
    t.geo(spark, sf).withColumn("lon", F.nanvl("lon", F.lit(None))).drop("name").write.json(path)
    return artifacts.read_route_geo(spark, path, multi_line=False)


def _summaries(spark, sf):
    daily = t.daily_scores(spark, sf)
    spans = daily.groupBy("RouteId").agg(
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("eval_start_date"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("eval_end_date"),
        F.countDistinct("date").cast("int").alias("n_days_evaluated"),
    )
    rows = metrics.backtest_summary(metrics.average_metrics(daily), spans)
    return rows.select(
        F.lit("Metro").alias("city"), F.lit("(All)").alias("zone"),
        F.col("RouteId").alias("route_id"), F.lit("Metro").alias("family_name"),
        "eval_start_date", "eval_end_date", "n_days_evaluated", "top_models", "metrics_avg",
    )


def _stored_summaries(spark, sf):
    path = scratch_path(spark, "summary")
    artifacts.write_backtest_summaries(_summaries(spark, sf), path)
    return path


_AVERAGES = """
SELECT RouteId, model, avg(mse) AS mse, avg(rmse) AS rmse, avg(mae) AS mae, avg(mape) AS mape,
       avg(smape) AS smape, avg(r2) AS r2, count(*) AS n_days
FROM daily_scores GROUP BY 1, 2
"""


@query("src_08_backtest_summary_json", sql(f"""
SELECT 'Metro' AS city, '(All)' AS zone, RouteId AS route_id, model, {rd('mse', 'mse')},
       {rd('rmse', 'rmse')}, {rd('mae', 'mae')}, {rd('mape', 'mape')}, {rd('smape', 'smape')},
       {rd('r2', 'r2')}, {rd('coalesce(smape, rmse)', 'score')}
FROM ({_AVERAGES})
""", "daily_scores"))
def src_08(spark, sf):
    path = _stored_summaries(spark, sf)
    return artifacts.summary_scores(
        artifacts.read_backtest_summaries(spark, path, multi_line=False)
    )


def _street_metrics(spark, sf):
    return filters.training_status(t.slots(spark, sf), ["street_name"]).select(
        "street_name", slugs.slug("street_name").alias("slug"), F.col("timesteps").cast("int"),
        F.col("n_train").cast("int").alias("n_train_seq"), F.col("n_test").cast("int").alias("n_test_seq"),
        F.lit(None).cast("double").alias("acc"),
        F.when(F.col("street_name") != "view", F.lit(0.25)).alias("f1"), "status",
        F.concat(F.lit("models/"), "street_name").alias("model_path"),
    )


@query("src_09_metric_csv_with_bom", sql("""
SELECT street_name, street_name AS slug, CAST(count(*) AS INTEGER) AS timesteps,
       'models/' || street_name AS model_path, 'GRU' AS model_type
FROM slots GROUP BY street_name
HAVING count(*) > 26 AND count(*) - 16 - floor((count(*) - 16) * 0.8e0) >= 10
""", "slots"))
def src_09(spark, sf):
    path = scratch_path(spark, "metrics")
    marked = _street_metrics(spark, sf).withColumnRenamed("street_name", "\ufeffstreet_name")
    marked.write.option("header", "true").csv(path)
    return artifacts.trained_configs(artifacts.read_metric_csv(spark, path))


@query("src_10_daily_cache", sql(f"""
SELECT 'Metro' AS family, RouteId, Date, {rd('DailyActual', 'DailyActual')},
       {rd('Daily_lag1', 'Daily_lag1')}, {rd('Daily_lag7', 'Daily_lag7')}
FROM daily_wide
""", "daily_wide"))
def src_10(spark, sf):
    path = scratch_path(spark, "daily")
    artifacts.write_daily_cache(
        t.daily_wide(spark, sf).withColumn("family", F.lit("Metro")), path
    )
    return artifacts.read_daily_cache(spark, path)


@query("snk_01_obs_by_city_zone", sql("""
SELECT City, Zone, RouteId, count(*) AS rows, min(DateTime) AS first, max(DateTime) AS last,
       round(sum(Vehicles) + 1e-9, 6) AS total
FROM obs GROUP BY 1, 2, 3
""", "obs"))
def snk_01(spark, sf):
    stored = observations.read_observations(spark, _stored_obs(spark, sf))
    return stored.groupBy("City", "Zone", "RouteId").agg(
        F.count("*").alias("rows"), F.min("DateTime").alias("first"),
        F.max("DateTime").alias("last"), F.sum("Vehicles").alias("total"),
    )


@query("snk_02_daily_cache_skip_and_overwrite", sql(f"""
SELECT 'Metro' AS family, RouteId, Date,
       {rd("CASE WHEN RouteId = 'click' THEN 2 * DailyActual ELSE DailyActual END", 'DailyActual')}
FROM daily
""", "daily"))
def snk_02(spark, sf):
    """Cached routes are skipped, a missing one is added, an overwritten one is replaced."""
    path = scratch_path(spark, "cache")
    daily = t.daily_wide(spark, sf).select("RouteId", "Date", "DailyActual")
    daily = daily.withColumn("family", F.lit("Metro"))
    twice = daily.withColumn("DailyActual", F.col("DailyActual") * 2)
    artifacts.write_daily_cache(daily.where("RouteId <> 'view'"), path)
    artifacts.write_daily_cache(twice.where("RouteId <> 'view'"), path)
    artifacts.write_daily_cache(daily, path)
    artifacts.write_daily_cache(twice.where("RouteId = 'click'"), path, overwrite=True)
    return artifacts.read_daily_cache(spark, path)


@query("snk_03_predictions_csv", sql("""
SELECT DateTime + INTERVAL 24 HOUR AS DateTime, RouteId, round(Vehicles + 1e-9, 6) AS PredictedVehicles,
       CAST(DateTime + INTERVAL 24 HOUR AS DATE) AS BaseDate, 'daily_naive' AS ModelUsed
FROM hourly
""", "hourly"))
def snk_03(spark, sf):
    path = scratch_path(spark, "predictions")
    moved = fc.lagged(t.hourly(spark, sf), 24, "PredictedVehicles").withColumns(
        {"BaseDate": F.to_date("DateTime"), "ModelUsed": F.lit("daily_naive")}
    )
    artifacts.write_predictions(moved, path)
    return artifacts.read_predictions(spark, path)


@query("snk_04_daily_metrics_table", sql(f"""
SELECT RouteId, date, model, n, {rd('mse', 'mse')}, {rd('rmse', 'rmse')}, {rd('mae', 'mae')},
       {rd('mape', 'mape')}, {rd('smape', 'smape')}, {rd('r2', 'r2')}
FROM daily_scores
""", "daily_scores"))
def snk_04(spark, sf):
    path = scratch_path(spark, "daily-metrics")
    artifacts.write_table(t.daily_scores(spark, sf), path)
    return spark.read.parquet(path)


@query("snk_04_summary_json", sql(f"""
SELECT RouteId AS route_id, strftime(min(date), '%Y-%m-%d') AS eval_start_date,
       strftime(max(date), '%Y-%m-%d') AS eval_end_date,
       CAST(count(DISTINCT date) AS INTEGER) AS n_days_evaluated,
       (SELECT string_agg(model, ',' ORDER BY coalesce(smape, rmse), model)
        FROM ({_AVERAGES}) a WHERE a.RouteId = d.RouteId) AS top_models
FROM daily_scores d GROUP BY RouteId
""", "daily_scores"))
def snk_04_json(spark, sf):
    stored = artifacts.read_backtest_summaries(
        spark, _stored_summaries(spark, sf), multi_line=False
    )
    return stored.select(
        "route_id", "eval_start_date", "eval_end_date", "n_days_evaluated",
        F.array_join("top_models", ",").alias("top_models"),
    )


@query("snk_05_street_evaluation_csv", sql(f"""
SELECT street_name, street_name AS slug, 'slot_mean' AS model_type, count(*) AS timesteps,
       count(*) + CAST(floor(count(*) / (1 - 0.8e0) * 0.8e0) AS BIGINT) AS n_seq_total, count(*) AS n_seq_test,
       {rd('avg((p - Actual) * (p - Actual))', 'MSE')},
       {rd('sqrt(avg((p - Actual) * (p - Actual)))', 'RMSE')},
       {rd('avg(abs(p - Actual))', 'MAE')},
       {rd('avg(2 * abs(p - Actual) / (abs(p) + abs(Actual) + 1e-8)) * 100', 'SMAPE')},
       {rd('avg(CASE WHEN (p >= 0.5) = (Actual = 1) THEN 1e0 ELSE 0e0 END) * 100', 'Accuracy')},
       count(*) AS detail_rows
FROM slot_pairs GROUP BY street_name
""", "slot_pairs"))
def snk_05(spark, sf):
    from lanewise.plans import streets

    path = scratch_path(spark, "evaluation")
    detail = t.slot_pairs(spark, sf).select(
        "street_name", slugs.slug("street_name").alias("slug"), F.lit("slot_mean").alias("model_type"),
        "DateTime", F.col("Actual").alias("Actual_is_congested"), F.col("p").alias("Predicted_prob"),
    )
    artifacts.write_evaluation(detail, streets.evaluation_summary(detail), path)
    stored = spark.read.option("header", "true").csv(f"{path}/details")
    rows = stored.groupBy("slug").agg(F.count("*").alias("detail_rows"))
    summary = artifacts.read_metric_csv(spark, f"{path}/summary", schemas.STREET_EVALUATION_CSV)
    return summary.join(rows, "slug")




@query("snk_06_stored_windows", sql(f"""
SELECT s.RouteId, s.DateTime, s.p - 168 AS sample, CAST(168 AS INTEGER) AS x_len, CAST(24 AS INTEGER) AS y_len,
       {rd('sum(CASE WHEN r.p < s.p THEN r.Vehicles END)', 'x_sum', 5)},
       {rd('sum(CASE WHEN r.p >= s.p THEN r.Vehicles END)', 'y_sum', 5)}
FROM (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) - 1 AS p,
             count(*) OVER (PARTITION BY RouteId) AS n FROM hourly) s
JOIN (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY DateTime) - 1 AS p FROM hourly) r
  ON r.RouteId = s.RouteId AND r.p >= s.p - 168 AND r.p < s.p + 24
WHERE s.p >= 168 AND s.p <= s.n - 24
GROUP BY 1, 2, 3
""", "hourly"), places=5)
def snk_06(spark, sf):
    path = scratch_path(spark, "windows")
    artifacts.write_table(windows.sequence_windows(t.hourly(spark, sf)), path)
    return spark.read.parquet(path).select(
        "RouteId", "DateTime", F.col("sample").cast("long"), F.size("x").alias("x_len"),
        F.size("y").alias("y_len"),
        F.aggregate("x", F.lit(0.0), lambda a, s: a + s["v"]).alias("x_sum"),
        F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("y_sum"),
    )


@query("snk_07_scaler_and_meta", sql(f"""
SELECT m.City, CAST(168 AS INTEGER) AS LOOKBACK, CAST(24 AS INTEGER) AS HORIZON,
       string_agg(m.RouteId, ',' ORDER BY m.RouteId) AS routes,
       CAST(count(*) + 5 AS INTEGER) AS n_features, {rd('any_value(s.mean)', 'mean')},
       {rd('any_value(s.std)', 'std')}
FROM (SELECT DISTINCT City, RouteId FROM obs) m
JOIN (SELECT avg(Vehicles) AS mean, stddev_pop(Vehicles) AS std FROM hourly) s ON true
GROUP BY m.City
""", "hourly"))
def snk_07(spark, sf):
    """The second fit, on doubled values, must not replace the stored scaler."""
    path = scratch_path(spark, "scaler")
    base = t.hourly(spark, sf)
    artifacts.fit_once(spark, f"{path}/scaler", lambda: windows.fit_scaler(base))
    doubled = base.withColumn("Vehicles", F.col("Vehicles") * 2)
    scaler = artifacts.fit_once(spark, f"{path}/scaler", lambda: windows.fit_scaler(doubled))
    artifacts.write_table(artifacts.sequence_meta(t.obs(spark, sf)), f"{path}/meta")
    meta = spark.read.parquet(f"{path}/meta").withColumn("routes", F.array_join("routes", ","))
    return windows.with_scaler(meta, scaler)


@query("snk_08_route_geo_json", sql("""
SELECT 'HoChiMinh' AS city, 'Center' AS zone, street_name AS route_id,
       street_name || ' (HCMC)' AS name,
       round((avg(lat_snode) + avg(lat_enode)) / 2 + 1e-9, 6) AS lat,
       round((avg(long_snode) + avg(long_enode)) / 2 + 1e-9, 6) AS lon
FROM los_time GROUP BY street_name
""", "los_time"))
def snk_08(spark, sf):
    path = scratch_path(spark, "geo-out")
    los = congestion.with_slot_time(t.los(spark, sf))
    artifacts.write_route_geo(
        congestion.route_geo(los, _street_metrics(spark, sf), "HoChiMinh", "Center"), path
    )
    return artifacts.read_route_geo(spark, path, multi_line=False)
