"""Filters, lookups, joins, sorting, set operations and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.catalog.registry import query, rd, sql
from lanewise.functions import calendar as cal
from lanewise.functions import slugs, travel
from lanewise.operators import congestion, filters, joins, reports, rollups, shape, windows
from lanewise.plans import forecast as fc
from lanewise.session import stored

NOW, TODAY = "2024-01-18 09:41:00", "2024-01-18"


@query("flt_01_clean_obs", sql("""
SELECT event_id, RouteId, DateTime - CASE WHEN event_id % 7 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END AS DateTime,
       Vehicles
FROM obs WHERE event_id % 11 <> 0 AND event_id % 13 <> 0
""", "obs"))
def flt_01(spark, sf):
    """Text input with zoned times, times that do not parse and counts that are not numbers."""
    n = F.col("event_id")
    text = F.date_format("DateTime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    dirty = t.obs(spark, sf).select(
        "event_id", "RouteId",
        F.when(n % 11 == 0, "31/31/2024").when(n % 7 == 0, F.concat(text, F.lit("+07:00")))
        .otherwise(text).alias("DateTime"),
        F.when(n % 13 == 0, F.element_at(F.array(F.lit("NaN"), F.lit("many"), F.lit("")), (n % 3 + 1).cast("int")))
        .otherwise(F.col("Vehicles").cast("string")).alias("Vehicles"),
    )
    return filters.clean_observations(dirty)


@query("flt_02_time_range", sql("""
SELECT event_id, RouteId, DateTime, Vehicles FROM obs
WHERE DateTime >= TIMESTAMP '2024-01-02 17:00:00' AND DateTime < TIMESTAMP '2024-01-28 12:00:00'
""", "obs"))
def flt_02(spark, sf):
    rows = t.obs(spark, sf).select("event_id", "RouteId", "DateTime", "Vehicles")
    return filters.in_time_range(rows, "2024-01-03T00:00:00+07:00", "2024-01-28 12:00:00")


@query("flt_03_routes", sql("""
SELECT event_id, RouteId, Vehicles FROM obs WHERE RouteId IN ('click', 'signup')
""", "obs"))
def flt_03(spark, sf):
    return filters.on_routes(
        t.obs(spark, sf).select("event_id", "RouteId", "Vehicles"), ["click", "signup", "absent"]
    )


@query("flt_03_routes_from_table", sql("""
SELECT event_id, RouteId, Vehicles FROM obs
WHERE RouteId IN (SELECT RouteId FROM obs GROUP BY RouteId HAVING avg(Vehicles) >= (SELECT avg(Vehicles) FROM obs))
""", "obs"))
def flt_03_table(spark, sf):
    rows = t.obs(spark, sf).select("event_id", "RouteId", "Vehicles")
    overall = rows.agg(F.avg("Vehicles")).scalar()
    busy = rows.groupBy("RouteId").agg(F.avg("Vehicles").alias("m")).where(F.col("m") >= overall)
    return filters.on_routes(rows, busy)


@query("flt_04_cities", sql("SELECT DISTINCT city AS City FROM geo", "geo"))
def flt_04_cities(spark, sf):
    return filters.list_cities(t.geo(spark, sf).withColumnRenamed("city", "City"))


@query("flt_04_zones", sql("""
SELECT '(All)' AS Zone, CAST(0 AS INTEGER) AS rank UNION ALL SELECT DISTINCT Zone, CAST(1 AS INTEGER) FROM obs
""", "obs"))
def flt_04_zones(spark, sf):
    return filters.list_zones(t.obs(spark, sf), "Metro")


@query("flt_04_routes", sql("SELECT DISTINCT RouteId FROM obs", "obs"))
def flt_04_routes(spark, sf):
    return filters.list_routes(t.obs(spark, sf), "Metro", "(All)")


@query("flt_05_routes_of_city", sql("""
SELECT 'all' AS asked, city, zone, route_id FROM geo WHERE city = 'ASIA'
UNION ALL SELECT 'zone', city, zone, route_id FROM geo WHERE city = 'ASIA' AND zone = 'NATION_7'
""", "geo"))
def flt_05(spark, sf):
    geo = t.geo(spark, sf).select("city", "zone", "route_id")
    city = filters.in_city_zone(geo, "ASIA", "(All)", "city", "zone")
    zone = filters.in_city_zone(geo, "ASIA", "NATION_7", "city", "zone")
    return shape.union_all(
        [city.select(F.lit("all").alias("asked"), "*"), zone.select(F.lit("zone").alias("asked"), "*")]
    )


@query("flt_06_eligible_streets", sql(f"""
SELECT street_name, count(*) AS timesteps, count(*) FILTER (is_congested = 1) AS n_congested,
       count(*) FILTER (is_congested = 0) AS n_free, {rd('avg(is_congested)', 'ratio_congested')},
       {rd('1 - avg(is_congested)', 'ratio_free')}
FROM slots GROUP BY street_name
HAVING count(*) >= 80 AND avg(is_congested) >= 0.05 AND 1 - avg(is_congested) >= 0.05
""", "slots"))
def flt_06(spark, sf):
    return congestion.eligible_streets(t.slots(spark, sf))


@query("flt_07_trained_routes", sql("""
SELECT p_partkey, p_brand AS street_name, CAST(p_size AS DOUBLE) / 50 AS f1 FROM part
WHERE p_size % 3 <> 0 AND p_partkey % 5 <> 0 AND CAST(p_size AS DOUBLE) / 50 >= 0.4
"""))
def flt_07(spark, sf):
    rows = t.load(spark, sf, "part").selectExpr(
        "p_partkey", "p_brand AS street_name",
        "CASE WHEN p_size % 3 <> 0 THEN cast(p_size AS double) / 50 END AS f1",
        "CASE WHEN p_partkey % 5 = 0 THEN 'skipped_too_short' ELSE 'trained' END AS status",
    )
    return filters.trained_routes(rows, 0.4).drop("status")


@query("flt_08_long_series", sql("""
SELECT o_custkey, o_orderkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)
"""))
def flt_08(spark, sf):
    rows = t.load(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return filters.keep_long_series(rows, ["o_custkey"], 12)


@query("flt_08_training_status", sql("""
SELECT l_partkey, timesteps, n_train, n_windows - n_train AS n_test,
       CASE WHEN timesteps <= 26 THEN 'skipped_too_short'
            WHEN n_windows - n_train < 5 THEN 'skipped_small_test' ELSE 'trained' END AS status
FROM (SELECT *, CAST(floor(n_windows * 0.8e0) AS BIGINT) AS n_train
      FROM (SELECT l_partkey, count(*) AS timesteps, greatest(count(*) - 16, 0) AS n_windows
            FROM lineitem GROUP BY 1))
"""))
def flt_08_status(spark, sf):
    return filters.training_status(t.load(spark, sf, "lineitem"), ["l_partkey"], min_test=5)


@query("flt_09_last_days", sql("""
SELECT l_orderkey, l_linenumber, RouteId, DateTime FROM sales s
WHERE DateTime >= (SELECT CAST(max(CAST(DateTime AS DATE)) - 90 AS TIMESTAMP) FROM sales m WHERE m.RouteId = s.RouteId)
""", "sales"))
def flt_09(spark, sf):
    return filters.last_days(t.sales(spark, sf), 90).select(
        "l_orderkey", "l_linenumber", "RouteId", "DateTime"
    )


@query("flt_10_last_month", sql("""
SELECT o.event_id, o.RouteId, o.DateTime FROM obs o
JOIN (SELECT RouteId, max(DateTime) - INTERVAL 1 MONTH AS start FROM obs GROUP BY 1) m USING (RouteId)
WHERE o.DateTime >= m.start
""", "obs"))
def flt_10(spark, sf):
    return filters.last_month(t.obs(spark, sf)).select("event_id", "RouteId", "DateTime")


@query("flt_10_last_month_of_years", sql("""
SELECT l_orderkey, l_linenumber, s.RouteId, s.DateTime FROM sales s
JOIN (SELECT RouteId, max(DateTime) - INTERVAL 1 MONTH AS start FROM sales GROUP BY 1) m USING (RouteId)
WHERE s.DateTime >= m.start
""", "sales"))
def flt_10_years(spark, sf):
    return filters.last_month(t.sales(spark, sf)).select(
        "l_orderkey", "l_linenumber", "RouteId", "DateTime"
    )


@query("flt_11_find_route", sql("SELECT * FROM geo WHERE route_id = 'nation_12'", "geo"))
def flt_11(spark, sf):
    padded = t.geo(spark, sf).withColumn("route_id", F.concat(F.lit("  "), F.upper("route_id")))
    found = filters.find_route(padded, " Nation_12 ")
    return found.withColumn("route_id", F.lower(F.trim("route_id")))


def _registry(spark, sf):
    """Families named by city and zone for some zones, and by city for Asia."""
    geo = t.geo(spark, sf)
    zones = geo.where(F.col("zone") < "NATION_2").select(
        F.replace(F.concat_ws("_", "city", "zone"), F.lit(" "), F.lit("_")).alias("family")
    )
    return zones.unionByName(geo.where("city = 'ASIA'").select(F.col("city").alias("family")).distinct())


@query("flt_12_resolve_family", sql(f"""
SELECT city, zone, CASE WHEN zone < 'NATION_2' THEN replace(city || '_' || zone, ' ', '_')
                        WHEN city = 'ASIA' THEN 'ASIA' END AS family
FROM geo
""", "geo"))
def flt_12(spark, sf):
    return filters.resolve_family(t.geo(spark, sf), _registry(spark, sf))


@query("flt_12_training_family", sql("""
SELECT city, zone, replace(city || '_' || zone, ' ', '_') AS family FROM geo
UNION ALL SELECT city, '(All)', replace(city, ' ', '_') FROM geo
UNION ALL SELECT 'Minneapolis', zone, 'I94' FROM geo
UNION ALL SELECT '', '', 'default' FROM geo
""", "geo"))
def flt_12_training(spark, sf):
    geo = t.geo(spark, sf).select("city", "zone")
    asked = shape.union_all([
        geo, geo.withColumn("zone", F.lit("(All)")), geo.withColumn("city", F.lit("Minneapolis")),
        geo.select(F.lit("").alias("city"), F.lit("").alias("zone")),
    ])
    return asked.withColumn("family", filters.family_for_training("city", "zone"))


@query("flt_13_zone_fallback", sql("""
SELECT city, '(All)' AS zone,
       CASE WHEN city = 'ASIA' THEN '(All)' ELSE coalesce(min(zone) FILTER (zone < 'NATION_2'), '(All)') END AS zone_used,
       CASE WHEN city = 'ASIA' THEN 'ASIA'
            ELSE replace(city || '_' || min(zone) FILTER (zone < 'NATION_2'), ' ', '_') END AS family
FROM geo GROUP BY city
""", "geo"))
def flt_13(spark, sf):
    geo = t.geo(spark, sf)
    asked = geo.select("city").distinct().withColumn("zone", F.lit("(All)"))
    found = filters.with_zone_fallback(asked, geo.select("city", "zone"), _registry(spark, sf))
    return found.withColumn("zone_used", F.coalesce("zone_used", F.lit("(All)")))


@query("flt_14_drop_past", sql("""
SELECT event_id, RouteId, DateTime FROM obs WHERE DateTime >= TIMESTAMP '2024-01-18 09:00:00'
""", "obs"))
def flt_14(spark, sf):
    return filters.drop_past(t.obs(spark, sf), NOW).select("event_id", "RouteId", "DateTime")


# Joins.

def _late_predictions(spark, sf):
    shift = F.make_dt_interval(hours=F.lit(24), mins=(F.col("event_id") % 61 - 30).cast("int"))
    return t.obs(spark, sf).select(
        "event_id", "RouteId", (F.col("DateTime") + shift).alias("DateTime"),
        F.col("Vehicles").alias("PredictedVehicles"),
    )


_ASOF = """
SELECT p.event_id, p.RouteId, p.DateTime, p.PredictedVehicles,
       CASE WHEN b.DateTime >= p.DateTime - INTERVAL 30 MINUTE
                 AND (f.DateTime IS NULL OR p.DateTime - b.DateTime <= f.DateTime - p.DateTime) THEN b.Vehicles
            WHEN f.DateTime <= p.DateTime + INTERVAL 30 MINUTE THEN f.Vehicles END AS Vehicles
FROM (SELECT event_id, RouteId, DateTime + INTERVAL 24 HOUR + to_minutes(CAST(event_id % 61 - 30 AS INTEGER)) AS DateTime,
             Vehicles AS PredictedVehicles FROM obs) p
ASOF LEFT JOIN (SELECT RouteId, DateTime, arg_max(Vehicles, event_id) AS Vehicles FROM obs GROUP BY 1, 2) b
  ON b.RouteId = p.RouteId AND p.DateTime >= b.DateTime
ASOF LEFT JOIN (SELECT RouteId, DateTime, arg_min(Vehicles, event_id) AS Vehicles FROM obs GROUP BY 1, 2) f
  ON f.RouteId = p.RouteId AND p.DateTime <= f.DateTime
"""


@query("joi_01_asof_nearest", sql(_ASOF, "obs"))
def joi_01(spark, sf):
    return joins.asof_nearest(
        _late_predictions(spark, sf), t.obs(spark, sf), right_order=F.col("event_id")
    )


@query("joi_01_asof_scores", sql(f"""
SELECT RouteId, count(*) AS n, {rd('avg((Vehicles - PredictedVehicles) ** 2)', 'MSE')},
       {rd('avg(abs(Vehicles - PredictedVehicles))', 'MAE')},
       {rd('1 - sum((Vehicles - PredictedVehicles) ** 2) / (count(*) * var_pop(Vehicles))', 'R2')}
FROM ({_ASOF}) WHERE Vehicles IS NOT NULL GROUP BY RouteId
""", "obs"))
def joi_01_scores(spark, sf):
    from lanewise.operators import metrics

    return metrics.error_metrics(
        joi_01(spark, sf), ["RouteId"], "Vehicles", "PredictedVehicles", r2_mode="sklearn"
    ).select("RouteId", "n", F.col("mse").alias("MSE"), F.col("mae").alias("MAE"), F.col("r2").alias("R2"))


@query("joi_02_actual_vs_predicted", sql(f"""
SELECT a.RouteId, a.DateTime, {rd('a.Vehicles', 'Actual')}, {rd('p.Vehicles', 'Pred')}
FROM hourly a JOIN hourly p ON p.RouteId = a.RouteId AND p.DateTime + INTERVAL 24 HOUR = a.DateTime
""", "hourly"))
def joi_02(spark, sf):
    hourly = t.hourly(spark, sf)
    return joins.actual_vs_predicted(
        hourly.withColumnRenamed("Vehicles", "Actual"), fc.lagged(hourly, 24, "Pred")
    )


@query("joi_03_daily_with_models", sql(f"""
SELECT RouteId, Date, {rd('DailyActual', 'DailyActual')}, {rd('Daily_lag1', 'Daily_lag1')},
       {rd('Daily_lag7', 'Daily_lag7')}
FROM sales_daily_wide
""", "sales_daily_wide"))
def joi_03(spark, sf):
    daily = rollups.daily_sum(t.sales(spark, sf))
    long = shape.union_all([
        daily.select("RouteId", F.date_add("Date", days).alias("Date"), F.lit(f"lag{days}").alias("model"),
                     F.col("DailyActual").alias("DailyPred"))
        for days in (1, 7)
    ])
    return joins.daily_with_models(daily, long, ["lag1", "lag7"])


@query("joi_04_models_side_by_side", sql(f"""
SELECT a.RouteId, a.DateTime, {rd('a.Pred', 'Pred_lag1')}, {rd('b.Pred', 'Pred_lag24')}
FROM pairs a JOIN pairs b ON a.RouteId = b.RouteId AND a.DateTime = b.DateTime
WHERE a.model = 'lag1' AND b.model = 'lag24'
""", "pairs"))
def joi_04(spark, sf):
    long = t.pairs(spark, sf).withColumnRenamed("Pred", "PredictedVehicles")
    return joins.models_side_by_side(long, ["lag1", "lag24"])


def _vietnamese(column):
    """Street-like names with composed, Icelandic and combining forms."""
    return F.concat(F.lit("Đường "), column, F.lit(" Lý Ðình Kiệt, Q.1 (é/"), F.lit("é)"))


_VIET = "'Đường ' || p_name || ' Lý Ðình Kiệt, Q.1 (é/' || 'é)'"
_CANON = """trim(regexp_replace(lower(strip_accents(translate({x}, 'ĐđÐð', 'DdDd'))), '[^a-z0-9]+', '_', 'g'), '_')"""


@query("joi_05_street_by_slug", sql(f"""
SELECT slug, min(name) AS street_name, count(*) AS n_models
FROM (SELECT {_VIET} AS name, {_CANON.format(x=_VIET)} AS slug FROM part) GROUP BY slug
"""))
def joi_05(spark, sf):
    streets = t.load(spark, sf, "part").select(_vietnamese(F.col("p_name")).alias("street_name"))
    names = joins.street_names_by_slug(streets, slugs.slug)
    models = streets.select(slugs.slug("street_name").alias("slug"))
    return joins.with_street_name(models, names).groupBy("slug").agg(
        F.max("street_name").alias("street_name"), F.count("*").alias("n_models")
    )


@query("joi_05_street_to_geo", sql("""
SELECT DISTINCT c.c_custkey, g.route_id, g.zone AS street_name FROM customer c
JOIN (SELECT * FROM geo WHERE city = 'EUROPE') g ON g.zone = (SELECT n_name FROM nation WHERE n_nationkey = c.c_nationkey)
""", "geo"))
def joi_05_geo(spark, sf):
    streets = joins.street_of_route(t.geo(spark, sf), "EUROPE").select("route_id", "street_name")
    nation = t.load(spark, sf, "nation")
    people = t.load(spark, sf, "customer").join(nation, F.col("c_nationkey") == nation.n_nationkey)
    return people.withColumnRenamed("n_name", "street_name").join(streets, "street_name").select(
        "c_custkey", "route_id", "street_name"
    )


@query("joi_06_hour_spine", sql(f"""
SELECT r.RouteId, CAST(h.Hour AS INTEGER) AS Hour, {rd('m.MeanVehicles', 'MeanVehicles')}
FROM (SELECT DISTINCT RouteId FROM obs) r, (SELECT unnest(range(24)) AS Hour) h
LEFT JOIN (SELECT RouteId, hour(DateTime) AS Hour, avg(Vehicles) FILTER (Vehicles > 250) AS MeanVehicles FROM obs GROUP BY 1, 2) m
  ON m.RouteId = r.RouteId AND m.Hour = h.Hour
""", "obs"))
def joi_06(spark, sf):
    busy = t.obs(spark, sf).withColumn("Vehicles", F.when(F.col("Vehicles") > 250, F.col("Vehicles")))
    means = rollups.mean_by_hour_of_day(busy, ["RouteId"]).withColumnRenamed("HourOfDay", "Hour")
    seen = means.where("MeanVehicles IS NOT NULL OR Hour < 12")
    return joins.on_hour_spine(seen, ["RouteId"], "Hour", "MeanVehicles")


@query("joi_06_slot_spine", sql(f"""
SELECT c.c_custkey, CAST(h AS INTEGER) AS hour, CAST(m AS INTEGER) AS minute
FROM customer c, (SELECT unnest([6, 7, 8]) AS h), (SELECT unnest([0, 30]) AS m)
"""))
def joi_06_slots(spark, sf):
    return joins.slot_spine(t.load(spark, sf, "customer").select("c_custkey"), 6, 9)


@query("joi_07_weekday_names", sql("""
SELECT RouteId, ['Thứ 2', 'Thứ 3', 'Thứ 4', 'Thứ 5', 'Thứ 6', 'Thứ 7', 'Chủ nhật'][isodow(DateTime)] AS weekday,
       count(*) AS n
FROM obs GROUP BY 1, 2
""", "obs"))
def joi_07(spark, sf):
    return t.obs(spark, sf).groupBy("RouteId", cal.weekday_name("DateTime").alias("weekday")).agg(
        F.count("*").alias("n")
    )


# Sorting, set operations, reshaping.

@query("ord_03_sort_by_time", sql("SELECT event_id, DateTime, RouteId FROM obs ORDER BY DateTime, event_id", "obs"))
def ord_03(spark, sf):
    return t.obs(spark, sf).select("event_id", "DateTime", "RouteId").orderBy("DateTime", "event_id")


@query("set_01_union", sql("""
SELECT RouteId, DateTime, Vehicles, Zone FROM obs
UNION ALL SELECT RouteId, DateTime, Vehicles, NULL FROM sales
""", "obs", "sales"))
def set_01(spark, sf):
    return shape.union_all([
        t.obs(spark, sf).select("RouteId", "DateTime", "Vehicles", "Zone"),
        t.sales(spark, sf).select("RouteId", "DateTime", "Vehicles"),
    ])


@query("set_02_distinct_days", sql("""
SELECT DISTINCT RouteId, CAST(DateTime AS DATE) AS Date FROM obs
""", "obs"))
def set_02(spark, sf):
    return t.obs(spark, sf).select("RouteId", F.to_date("DateTime").alias("Date")).distinct()


def _long_sql(source, prefix, time, value):
    return f"""
SELECT RouteId, {time}, 'Actual' AS Source, {rd(f'{prefix}Actual', value)} FROM ({source})
UNION ALL SELECT RouteId, {time}, 'lag1', round({prefix}_lag1 + 1e-9, 6) FROM ({source})
UNION ALL SELECT RouteId, {time}, 'lag7', round({prefix}_lag7 + 1e-9, 6) FROM ({source})
"""


@query("set_03_daily_long", sql(_long_sql("SELECT * FROM daily_wide", "Daily", "Date", "DailyValue"), "daily_wide"))
def set_03(spark, sf):
    """A model column without any value leaves no rows."""
    wide = t.daily_wide(spark, sf).withColumn("Daily_none", F.lit(None).cast("double"))
    return shape.sources_long(wide, "Daily", "Date")


_WEEKLY = """
SELECT RouteId, CAST(date_trunc('week', Date) AS TIMESTAMP) AS WeekStart, sum(DailyActual) AS WeeklyActual,
       coalesce(sum(Daily_lag1), 0) AS Weekly_lag1, coalesce(sum(Daily_lag7), 0) AS Weekly_lag7
FROM {p}daily_wide GROUP BY 1, 2
"""
_MONTHLY = """
SELECT RouteId, CAST(date_trunc('month', Date) AS TIMESTAMP) AS MonthStart, sum(DailyActual) AS MonthlyActual,
       coalesce(sum(Daily_lag1), 0) AS Monthly_lag1, coalesce(sum(Daily_lag7), 0) AS Monthly_lag7
FROM {p}daily_wide GROUP BY 1, 2
"""


@query("set_03_weekly_long", sql(_long_sql(_WEEKLY.format(p="sales_"), "Weekly", "WeekStart", "WeeklyValue"), "sales_daily_wide"))
def set_03_weekly(spark, sf):
    weekly = rollups.weekly_sum(t.daily_wide(spark, sf, t.sales))
    return shape.sources_long(weekly, "Weekly", "WeekStart")


@query("set_03_monthly_long", sql(_long_sql(_MONTHLY.format(p="sales_"), "Monthly", "MonthStart", "MonthlyValue"), "sales_daily_wide"))
def set_03_monthly(spark, sf):
    monthly = rollups.monthly_sum(t.daily_wide(spark, sf, t.sales))
    return shape.sources_long(monthly, "Monthly", "MonthStart")


_HOUR_COLUMNS = [f"{h:02d}:00" for h in range(24)]


@query("set_04_hours_wide", sql(
    "SELECT RouteId, CAST(DateTime AS DATE) AS Date, "
    + ", ".join(
        f"avg(round_even(Vehicles, 0)) FILTER (hour(DateTime) = {h}) AS \"{c}\""
        for h, c in enumerate(_HOUR_COLUMNS)
    )
    + " FROM hourly GROUP BY 1, 2", "hourly"))
def set_04(spark, sf):
    hourly = t.hourly(spark, sf).withColumn("Date", F.to_date("DateTime"))
    return shape.labels_wide(
        hourly, ["RouteId", "Date"], F.date_format("DateTime", "HH:mm"), _HOUR_COLUMNS,
        F.bround("Vehicles", 0),
    )


# Scalar expressions.

_TWO_PI = "2 * pi()"


@query("scl_01_hour_week_features", sql(f"""
SELECT event_id, {rd(f'sin({_TWO_PI} * hour(DateTime) / 24)', 'hour_sin')},
       {rd(f'cos({_TWO_PI} * hour(DateTime) / 24)', 'hour_cos')},
       {rd(f'sin({_TWO_PI} * (isodow(DateTime) - 1) / 7)', 'dow_sin')},
       {rd(f'cos({_TWO_PI} * (isodow(DateTime) - 1) / 7)', 'dow_cos')}
FROM obs
""", "obs"))
def scl_01(spark, sf):
    return t.obs(spark, sf).select("event_id", *cal.hour_week_features("DateTime"))


@query("scl_02_period_time", sql("SELECT event_id, DateTime FROM los_time", "los_time"))
def scl_02(spark, sf):
    return congestion.with_slot_time(t.los(spark, sf)).select("event_id", "DateTime")


@query("scl_03_numbered_period_time", sql("""
SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes(CAST((user_id % 48) * 30 AS INTEGER)) AS DateTime
FROM events
"""))
def scl_03(spark, sf):
    return t.load(spark, sf, "events").select(
        "event_id",
        cal.numbered_period_timestamp(
            F.to_date("ts"), (F.col("user_id") % 48 + 1).cast("string")
        ).alias("DateTime"),
    )


@query("scl_04_minute_week_features", sql(f"""
SELECT event_id, {rd(f'sin({_TWO_PI} * (hour(DateTime) * 60 + minute(DateTime)) / 1440)', 'time_sin')},
       {rd(f'cos({_TWO_PI} * (hour(DateTime) * 60 + minute(DateTime)) / 1440)', 'time_cos')},
       {rd(f'sin({_TWO_PI} * (isodow(DateTime) - 1) / 7)', 'week_sin')},
       {rd(f'cos({_TWO_PI} * (isodow(DateTime) - 1) / 7)', 'week_cos')}
FROM obs
""", "obs"))
def scl_04(spark, sf):
    return t.obs(spark, sf).select("event_id", *cal.minute_week_features("DateTime"))


@query("scl_05_scale_and_back", sql(f"""
SELECT event_id, RouteId, {rd('(Vehicles - mean) / std', 'scaled')},
       {rd('greatest((Vehicles - mean) / std * std + mean, 0)', 'restored')},
       {rd('greatest(-3 * std + mean, 0)', 'low')}
FROM obs JOIN (SELECT RouteId, avg(Vehicles) AS mean, stddev_pop(Vehicles) AS std FROM obs GROUP BY 1) USING (RouteId)
""", "obs"))
def scl_05(spark, sf):
    rows = t.obs(spark, sf).select("event_id", "RouteId", "Vehicles")
    fitted = windows.with_scaler(rows, windows.fit_scaler(rows, ["RouteId"]), ["RouteId"])
    return fitted.withColumn("scaled", windows.scaled("Vehicles")).select(
        "event_id", "RouteId", "scaled", windows.unscaled("scaled").alias("restored"),
        windows.unscaled(F.lit(-3.0)).alias("low"),
    )


@query("scl_06_route_one_hot", sql("""
SELECT o.event_id, CAST(r.i AS INTEGER) AS route_index,
       list_aggregate([CAST(CASE WHEN k = r.i THEN 1 ELSE 0 END AS VARCHAR) FOR k IN range(r.n)], 'string_agg', ',') AS one_hot
FROM obs o JOIN (SELECT Zone, RouteId, row_number() OVER (PARTITION BY Zone ORDER BY RouteId) - 1 AS i,
                        count(*) OVER (PARTITION BY Zone) AS n
                 FROM (SELECT DISTINCT Zone, RouteId FROM obs)) r USING (Zone, RouteId)
""", "obs"))
def scl_06(spark, sf):
    rows = t.obs(spark, sf)
    index = stored(windows.route_index(rows, ["Zone"]), "route-index")
    placed = rows.join(index, ["Zone", "RouteId"])
    vector = F.transform(windows.one_hot("route_index", "n_routes"), lambda v: v.cast("int").cast("string"))
    return placed.select("event_id", "route_index", F.array_join(vector, ",").alias("one_hot"))


@query("scl_07_slug", sql(f"SELECT p_partkey, {_CANON.format(x=_VIET)} AS slug FROM part"))
def scl_07(spark, sf):
    return t.load(spark, sf, "part").select(
        "p_partkey", slugs.slug(_vietnamese(F.col("p_name"))).alias("slug")
    )


@query("scl_08_older_slugs", sql(f"""
SELECT p_partkey,
  regexp_replace(replace(lower(regexp_replace(strip_accents({_VIET}), '[^\\x00-\\x7F]', '', 'g')), ' ', '_'), '[/\\\\,.:;()''"]', '', 'g') AS ascii_only,
  regexp_replace(replace(lower(strip_accents({_VIET})), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS keep_letters
FROM part
"""))
def scl_08(spark, sf):
    name = _vietnamese(F.col("p_name"))
    return t.load(spark, sf, "part").select(
        "p_partkey", slugs.slug_ascii_only(name).alias("ascii_only"),
        slugs.slug_keep_letters(name).alias("keep_letters"),
    )


_P = "CAST(json_extract_string(props, '$.k') AS INTEGER) / 80e0 - 0.1e0"


def _probabilities(spark, sf):
    """Probabilities that also leave the unit interval, on known and unknown streets."""
    names = [*travel.STREET_LENGTH_KM, "elsewhere"]
    streets = F.array(*[F.lit(n) for n in names])
    return t.load(spark, sf, "events").select(
        "event_id", (F.get_json_object("props", "$.k").cast("int") / F.lit(80.0) - 0.1).alias("p"),
        F.element_at(streets, (F.col("user_id") % len(names) + 1).cast("int")).alias("slug"),
        F.date_format("ts", "HH:mm").alias("TimeLabel"), F.col("ts").alias("DateTime"),
        F.col("event_type").alias("street_name"),
    )


_TRAVEL = f"""
SELECT event_id, TimeLabel, street_name, p, slug, length_km, 60 * length_km / 40 AS free_minutes,
       60 * length_km / greatest(40 * CASE WHEN p <= 0.3 THEN 0.9e0 WHEN p <= 0.7 THEN 0.6e0 ELSE 0.3e0 END, 5) AS travel_minutes,
       CASE WHEN p <= 0.3 THEN 'low' WHEN p <= 0.7 THEN 'medium' ELSE 'high' END AS slowdown
FROM (SELECT event_id, strftime(ts, '%H:%M') AS TimeLabel, event_type AS street_name, {_P} AS p, slug,
             CAST([4.3, 3.8, 5.6, 3.2, 7.2, 51.0, 2.1, 8.5, 4.0][i + 1] AS DOUBLE) AS length_km
      FROM (SELECT *, user_id % 9 AS i,
                   ['ly_thuong_kiet', 'nguyen_kiem', 'quang_trung', 'nguyen_dinh_chieu', 'le_duc_tho',
                    'quoc_lo_1a', 'to_hien_thanh', 'truong_chinh', 'elsewhere'][user_id % 9 + 1] AS slug FROM events))
"""


@query("scl_09_congestion_level", sql(f"""
SELECT event_id, CASE WHEN {_P} >= 0.7 THEN 'high' WHEN {_P} >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM events
"""))
def scl_09(spark, sf):
    return _probabilities(spark, sf).select("event_id", travel.congestion_level("p").alias("level"))


@query("scl_10_travel_time", sql(f"""
SELECT event_id, slug, {rd('length_km', 'length_km')}, {rd('free_minutes', 'free_minutes')},
       {rd('travel_minutes', 'travel_minutes')}, {rd('travel_minutes - free_minutes', 'delay_minutes')}, slowdown
FROM ({_TRAVEL})
"""))
def scl_10(spark, sf):
    return travel.with_travel_time(_probabilities(spark, sf)).select(
        "event_id", "slug", "length_km", "free_minutes", "travel_minutes", "delay_minutes", "slowdown"
    )


@query("scl_11_travel_table", sql(f"""
SELECT event_id, TimeLabel AS slot, {rd('round_even(p * 100, 1)', 'p_pct')},
       round_even(travel_minutes, 1) AS travel_minutes,
       round_even(travel_minutes - free_minutes, 1) AS delay_minutes, slowdown,
       {rd('free_minutes', 'free_minutes')}, length_km
FROM ({_TRAVEL})
"""))
def scl_11(spark, sf):
    return reports.travel_table(_probabilities(spark, sf), ["event_id"]).orderBy("slot")


@query("scl_12_traffic_level", sql(f"""
SELECT RouteId, DateTime, {rd('Vehicles', 'Vehicles')},
       CASE WHEN Vehicles >= quantile_cont(Vehicles, 0.8) OVER w THEN 'Rất đông'
            WHEN Vehicles <= quantile_cont(Vehicles, 0.2) OVER w THEN 'Thưa thớt' ELSE 'Trung bình' END AS TrafficLevel
FROM hourly WINDOW w AS (PARTITION BY RouteId, CAST(DateTime AS DATE))
""", "hourly"))
def scl_12(spark, sf):
    return rollups.with_traffic_level(t.hourly(spark, sf), value="Vehicles")


@query("scl_13_labels", sql("""
SELECT event_id, ['Thứ 2', 'Thứ 3', 'Thứ 4', 'Thứ 5', 'Thứ 6', 'Thứ 7', 'Chủ nhật'][isodow(DateTime)] || ' ' || strftime(DateTime, '%d/%m') AS day_label,
       strftime(DateTime, '%H:%M') AS time_label
FROM obs
""", "obs"))
def scl_13(spark, sf):
    return t.obs(spark, sf).select(
        "event_id", cal.weekday_day_label("DateTime").alias("day_label"),
        cal.time_label(F.hour("DateTime"), F.minute("DateTime")).alias("time_label"),
    )


@query("scl_14_next_slots", sql("""
SELECT event_id, date_trunc('hour', DateTime) AS hour_start,
       CAST(k AS INTEGER) AS step,
       date_trunc('hour', DateTime) + INTERVAL 7 HOUR
         + to_minutes(CAST(CASE WHEN minute(DateTime) < 30 THEN 0 ELSE 30 END + 30 * k AS INTEGER)) AS slot
FROM obs, (SELECT unnest([1, 2, 3, 4]) AS k)
""", "obs"))
def scl_14(spark, sf):
    local = cal.local_clock(F.col("DateTime"))
    return t.obs(spark, sf).select(
        "event_id", cal.hour_floor("DateTime").alias("hour_start"),
        F.posexplode(cal.next_slots(local)).alias("i", "slot"),
    ).select("event_id", "hour_start", (F.col("i") + 1).alias("step"), "slot")


@query("scl_15_shift_to_week", sql("""
SELECT event_id, TIMESTAMP '2024-01-18' + to_days(CAST((isodow(DateTime) - 4 + 7) % 7 AS INTEGER))
                 + (DateTime - date_trunc('day', DateTime)) AS DateTime
FROM obs
WHERE TIMESTAMP '2024-01-18' + to_days(CAST((isodow(DateTime) - 4 + 7) % 7 AS INTEGER))
      + (DateTime - date_trunc('day', DateTime)) >= TIMESTAMP '2024-01-18 09:00:00'
""", "obs"))
def scl_15(spark, sf):
    moved = t.obs(spark, sf).select("event_id", cal.shift_to_week_of("DateTime", TODAY).alias("DateTime"))
    return filters.drop_past(moved, NOW)


@query("scl_16_calendar_columns", sql("""
SELECT event_id, DateTime, CAST(year(DateTime) AS INTEGER) AS Year, CAST(month(DateTime) AS INTEGER) AS Month,
       CAST(DateTime AS DATE) AS Date, CAST(hour(DateTime) AS INTEGER) AS Hour, CAST(day(DateTime) AS INTEGER) AS Day,
       CAST(isodow(DateTime) - 1 AS INTEGER) AS DayOfWeek, CAST(hour(DateTime) AS INTEGER) AS HourOfDay
FROM obs
""", "obs"))
def scl_16(spark, sf):
    return cal.calendar_columns(t.obs(spark, sf).select("event_id", "DateTime"))


@query("scl_17_names_and_ranges", sql("""
SELECT c_custkey, replace(c_name || ' (HCMC)', ' (HCMC)', '') AS street_name,
       strftime(DATE '2024-01-01' + CAST(c_custkey AS INTEGER), '%Y-%m-%d') || ' → '
         || strftime(DATE '2024-01-07' + CAST(c_custkey AS INTEGER), '%Y-%m-%d') AS label
FROM customer
"""))
def scl_17(spark, sf):
    rows = t.load(spark, sf, "customer").select(
        "c_custkey", F.lit("X").alias("city"), F.col("c_custkey").alias("route_id"),
        F.concat("c_name", F.lit(" (HCMC)")).alias("name"),
    )
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("route_id").cast("int"))
    return joins.street_of_route(rows, "X").select(
        F.col("route_id").alias("c_custkey"), "street_name",
        cal.range_label(start, F.date_add(start, 6)).alias("label"),
    )
