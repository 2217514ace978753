"""Street congestion: slots, patterns, departure advice and street models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.catalog.registry import query, rd, sql, table
from lanewise.functions import slugs
from lanewise.operators import congestion
from lanewise.plans import advisor, streets

NOW = "2024-02-01 02:41:00"


@query("agg_06_congested_slots", sql("SELECT street_name, DateTime, is_congested FROM slots", "slots"))
def agg_06(spark, sf):
    return t.slots(spark, sf)


@query("agg_06_missing_letters", sql("""
SELECT street_name, DateTime,
       CAST(avg(CASE WHEN event_id % 3 <> 0 AND LOS IN ('D', 'E', 'F') THEN 1e0 ELSE 0e0 END) >= 0.5 AS INTEGER) AS is_congested
FROM los_time GROUP BY 1, 2
""", "los_time"))
def agg_06_missing(spark, sf):
    """A missing letter stays in the denominator."""
    los = t.los(spark, sf).withColumn("LOS", F.when(F.col("event_id") % 3 != 0, F.col("LOS")))
    return congestion.congested_slots(congestion.with_slot_time(los))


def _accented(los):
    """Two spellings per street that share a slug."""
    even = F.col("segment_id") % 2 == 0
    return los.withColumn(
        "street_name", F.when(even, F.concat(F.lit("Đường "), "street_name")).otherwise(F.concat(F.lit("duong_"), "street_name"))
    )


@query("agg_07_congested_slots_by_slug", sql("""
SELECT 'duong_' || street_name AS slug, DateTime, is_congested FROM slots
""", "slots"))
def agg_07(spark, sf):
    return congestion.congested_slots(_accented(t.los(spark, sf)), slug_of="street_name")


@query("agg_08_congested_rows", sql("""
SELECT event_id, CASE WHEN LOS IN ('D', 'E', 'F') THEN 1e0 ELSE 0e0 END AS by_letter,
       CASE WHEN user_grade >= 4 THEN 1e0 ELSE 0e0 END AS by_grade
FROM (SELECT *, segment_id % 7 AS user_grade FROM los)
""", "los"))
def agg_08(spark, sf):
    return t.los(spark, sf).select(
        "event_id",
        congestion.is_congested_row(F.lower("LOS")).alias("by_letter"),
        congestion.is_congested_row((F.col("segment_id") % 7).cast("string")).alias("by_grade"),
    )


_HOURS = [f"{h:02d}:00" for h in range(24)]
_HOUR_SQL = ", ".join(
    f"round_even(avg(is_congested) FILTER (hour(DateTime) = {h}) * 100, 1) AS \"{c}\"" for h, c in enumerate(_HOURS)
)


@query("agg_09_weekly_pattern", sql(f"""
SELECT street_name, CAST(isodow(DateTime) - 1 AS INTEGER) AS weekday,
       ['Thứ 2', 'Thứ 3', 'Thứ 4', 'Thứ 5', 'Thứ 6', 'Thứ 7', 'Chủ nhật'][isodow(DateTime)] AS weekday_label, {_HOUR_SQL}
FROM slots GROUP BY 1, 2, 3
""", "slots"))
def agg_09(spark, sf):
    return congestion.weekly_pattern(t.slots(spark, sf))


def _means(weekday, samples):
    return f"""
SELECT street_name, CAST(hour(DateTime) AS INTEGER) AS hour, CAST(minute(DateTime) AS INTEGER) AS minute,
       CASE WHEN count(*) FILTER (isodow(DateTime) - 1 = {weekday}) >= {samples}
            THEN avg(is_congested) FILTER (isodow(DateTime) - 1 = {weekday}) ELSE avg(is_congested) END AS m
FROM slots GROUP BY 1, 2, 3
"""


@query("agg_10_slot_means", sql(f"""
SELECT street_name, hour, minute, {rd('m', 'MeanCongestion')} FROM ({_means(0, 4)})
""", "slots"))
def agg_10(spark, sf):
    return congestion.slot_means(t.slots(spark, sf), 0, min_samples=4)


@query("agg_12_street_centroids", sql(f"""
SELECT street_name, {rd('(avg(lat_snode) + avg(lat_enode)) / 2', 'lat')}, {rd('(avg(long_snode) + avg(long_enode)) / 2', 'lon')}
FROM los GROUP BY 1
""", "los"))
def agg_12(spark, sf):
    return congestion.street_centroids(t.los(spark, sf))


@query("agg_18_class_balance", sql(f"""
SELECT street_name, count(*) AS timesteps, count(*) FILTER (is_congested = 1) AS n_congested,
       count(*) FILTER (is_congested = 0) AS n_free, {rd('avg(is_congested)', 'ratio_congested')},
       {rd('1 - avg(is_congested)', 'ratio_free')}
FROM slots GROUP BY 1
""", "slots"))
def agg_18(spark, sf):
    return congestion.class_balance(t.slots(spark, sf))


table("offered", f"""
SELECT street_name, lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute AS VARCHAR), 2, '0') AS TimeLabel,
       hour, minute, round_even(m * 100, 1) AS pct, m
FROM ({_means(2, 4)}) WHERE hour >= 6 AND hour < 9
""", "slots")

_RANKED = """
SELECT *, row_number() OVER (PARTITION BY street_name ORDER BY pct, TimeLabel) AS low,
       row_number() OVER (PARTITION BY street_name ORDER BY pct DESC, TimeLabel) AS high,
       min(pct) OVER (PARTITION BY street_name) AS least, max(pct) OVER (PARTITION BY street_name) AS most
FROM offered
"""


def _offered(spark, sf):
    means = congestion.slot_means(t.slots(spark, sf), 2, min_samples=4)
    return congestion.window_slots(means, 6, 9)


_SLOT_COLUMNS = f"street_name, TimeLabel, hour, minute, pct AS CongestionPct, {rd('m', 'MeanCongestion')}"


@query("ord_01_best_slots", sql(f"""
SELECT {_SLOT_COLUMNS}, CAST(low AS INTEGER) AS rank FROM ({_RANKED}) WHERE pct <= 30 OR (least > 30 AND low <= 2)
""", "offered"))
def ord_01(spark, sf):
    return congestion.best_slots(_offered(spark, sf))


@query("ord_02_worst_slots", sql(f"""
SELECT {_SLOT_COLUMNS}, CAST(high AS INTEGER) AS rank FROM ({_RANKED})
WHERE pct >= 70 OR (most < 70 AND most > 0 AND high <= 2)
""", "offered"))
def ord_02(spark, sf):
    return congestion.worst_slots(_offered(spark, sf))


def _advice(weekday, start, end):
    return sql(f"""
SELECT street_name, {rd('avg(pct)', 'mean_pct')},
       coalesce(string_agg(TimeLabel, ',' ORDER BY low) FILTER (pct <= 30 OR (least > 30 AND low <= 2)), '') AS best,
       coalesce(string_agg(TimeLabel, ',' ORDER BY high) FILTER (pct >= 70 OR (most < 70 AND most > 0 AND high <= 2)), '') AS worst
FROM (SELECT *, row_number() OVER (PARTITION BY street_name ORDER BY pct, TimeLabel) AS low,
             row_number() OVER (PARTITION BY street_name ORDER BY pct DESC, TimeLabel) AS high,
             min(pct) OVER (PARTITION BY street_name) AS least, max(pct) OVER (PARTITION BY street_name) AS most
      FROM (SELECT street_name, lpad(CAST(hour AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute AS VARCHAR), 2, '0') AS TimeLabel,
                   round_even(m * 100, 1) AS pct
            FROM ({_means(weekday, 5)}) WHERE hour >= {start} AND hour < {end}))
GROUP BY street_name
""", "slots")


def _advise(spark, sf, weekday, window):
    rows = advisor.departure_advice(t.slots(spark, sf), weekday, window)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("best", "worst")})


@query("fc_16_departure_morning", _advice(1, 6, 9))
def fc_16(spark, sf):
    return _advise(spark, sf, 1, "morning")


@query("fc_16_departure_evening", _advice(5, 16, 19))
def fc_16_evening(spark, sf):
    return _advise(spark, sf, 5, "evening")


@query("fc_08_train_logit")
def fc_08(spark, sf):
    """One fit per street; a numeric fit has no SQL form."""
    return streets.train_streets(t.slots(spark, sf), "logit")[1]


@query("fc_08_train_mlp")
def fc_08_mlp(spark, sf):
    """One network over all streets; an iterative fit has no SQL form."""
    return streets.train_streets(t.slots(spark, sf), "mlp")[1]


@query("fc_08_test_split", sql("""
SELECT street_name, street_name AS slug, n AS timesteps, CAST(floor((n - 16) * 0.8e0) AS BIGINT) AS n_train_seq,
       n - 16 - CAST(floor((n - 16) * 0.8e0) AS BIGINT) AS n_test_seq,
       count(*) FILTER (p - 16 >= floor((n - 16) * 0.8e0) AND is_congested = 1) AS support, 'trained' AS status,
       'models/logit_' || street_name AS model_path
FROM slot_numbered GROUP BY street_name, n
""", "slot_numbered"))
def fc_08_split(spark, sf):
    """The part of the training report that does not depend on the fit."""
    return streets.train_streets(t.slots(spark, sf), "logit")[1].select(
        "street_name", "slug", "timesteps", "n_train_seq", "n_test_seq", "support", "status", "model_path"
    )


@query("fc_10_rollout_logit")
def fc_10(spark, sf):
    """Four steps of a fitted model; the fit has no SQL form."""
    slots = t.slots(spark, sf)
    fits = streets.fit_logit(slots)
    return streets.rollout_next(slots, lambda df: streets.predict_logit(df, fits))


@query("fc_10_rollout_given_weights", f"""
{sql("", "slots", recursive=True)},
recent AS (SELECT street_name, list(struct_pack(y := CAST(is_congested AS DOUBLE), t := DateTime) ORDER BY DateTime) AS w
           FROM (SELECT *, row_number() OVER (PARTITION BY street_name ORDER BY DateTime DESC) AS age,
                        count(*) OVER (PARTITION BY street_name) AS n FROM slots) WHERE age <= 16 AND n > 16 GROUP BY 1),
roll AS (
  SELECT street_name, 0 AS step, w, CAST(NULL AS DOUBLE) AS p FROM recent
  UNION ALL
  SELECT street_name, step + 1, list_concat(w[2:16], [struct_pack(y := CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END, t := w[16].t + INTERVAL 30 MINUTE)]), p
  FROM (SELECT street_name, step, w, 1 / (1 + exp(-(-0.4e0 + list_sum([
          (k + 1) * 0.02e0 * w[k + 1].y + 0.01e0 * (k + 1) * sin(2 * pi() * (hour(w[k + 1].t) * 60 + minute(w[k + 1].t)) / 1440)
          - 0.03e0 * cos(2 * pi() * (isodow(w[k + 1].t) - 1) / 7) FOR k IN range(16)])))) AS p
        FROM roll WHERE step < 4)
)
SELECT street_name, CAST(step AS INTEGER) AS step, {rd('p', 'p')} FROM roll WHERE step > 0
""")
def fc_10_given(spark, sf):
    """The rollout with fixed coefficients, which SQL can follow."""
    weights = [-0.4]
    for k in range(1, 17):
        weights += [0.02 * k, 0.01 * k, 0.0, 0.0, -0.03]
    given = F.array(*[F.lit(w) for w in weights])
    return streets.rollout_next(
        t.slots(spark, sf),
        lambda df: df.withColumn("p", streets.logit_probability(streets.flat_features("x"), given)),
    )


@query("fc_14_evaluate_streets")
def fc_14(spark, sf):
    """Both street models on the test part; depends on fits."""
    return streets.evaluate_streets(t.slots(spark, sf))[1]


@query("fc_14_evaluation_detail")
def fc_14_detail(spark, sf):
    return streets.evaluate_streets(t.slots(spark, sf), ["logit"])[0]


@query("fc_14_evaluate_last_value", sql(f"""
SELECT street_name, street_name AS slug, 'persist' AS model_type, count(*) AS timesteps,
       count(*) + CAST(floor(count(*) / (1 - 0.8e0) * 0.8e0) AS BIGINT) AS n_seq_total, count(*) AS n_seq_test,
       {rd('avg((q - y) * (q - y))', 'MSE')}, {rd('sqrt(avg((q - y) * (q - y)))', 'RMSE')}, {rd('avg(abs(q - y))', 'MAE')},
       {rd('avg(2 * abs(q - y) / (abs(q) + abs(y) + 1e-8)) * 100', 'SMAPE')},
       {rd('avg(CASE WHEN (q >= 0.5) = (y = 1) THEN 1e0 ELSE 0e0 END) * 100', 'Accuracy')}
FROM (SELECT street_name, p, n, CAST(is_congested AS DOUBLE) AS y, 0.25e0 + 0.5 * lag(is_congested) OVER (PARTITION BY street_name ORDER BY p) AS q
      FROM slot_numbered)
WHERE p >= 16 AND p - 16 >= greatest(1, floor((n - 16) * 0.8e0)) GROUP BY street_name
""", "slot_numbered"))
def fc_14_last_value(spark, sf):
    """The same evaluation of a model without a fit: the last slot's state."""
    samples = streets.labelled_windows(t.slots(spark, sf), rule="train_min1")
    detail = samples.where("split = 'test'").select(
        "street_name", slugs.slug("street_name").alias("slug"), F.lit("persist").alias("model_type"),
        F.col("y").alias("Actual_is_congested"),
        (F.lit(0.25) + F.element_at("x", -1)["congested"] * 0.5).alias("Predicted_prob"),
    )
    return streets.evaluation_summary(detail)


def _two_hours(spark, sf):
    return streets.next_two_hours(t.slots(spark, sf), NOW)


@query("fc_17_next_two_hours")
def fc_17(spark, sf):
    """Levels of the next four slots by two models; depends on fits."""
    return streets.two_hour_report(_two_hours(spark, sf))[0]


@query("fc_17_two_hour_summary")
def fc_17_summary(spark, sf):
    summary, travel = streets.two_hour_report(_two_hours(spark, sf))[1:]
    return summary.join(travel, "street_name").withColumns(
        {c: F.array_join(c, ",") for c in ("avoid_slots", "good_slots")}
    )


@query("fc_17_report_of_last_state", sql(f"""
SELECT street_name, {rd('30 * 4 * last', 'expected_congested_minutes')}, {rd('last', 'mean_probability')},
       CASE WHEN last >= 0.7 THEN '10:00,10:30,11:00,11:30' ELSE '' END AS avoid_slots,
       CASE WHEN last <= 0.3 THEN '10:00,10:30,11:00,11:30' ELSE '' END AS good_slots, CAST(4 AS BIGINT) AS n_slots,
       CASE WHEN last <= 0.3 THEN 6.7e0 ELSE 20e0 END AS mean_minutes,
       CASE WHEN last <= 0.3 THEN 6.7e0 ELSE 20e0 END AS worst_minutes, '10:00' AS worst_slot,
       6e0 AS free_minutes, 4e0 AS length_km
FROM (SELECT street_name, CAST(arg_max(is_congested, DateTime) AS DOUBLE) AS last FROM slots GROUP BY 1)
""", "slots"))
def fc_17_last_state(spark, sf):
    """The report on a model without a fit."""
    forecast = streets.next_two_hours(
        t.slots(spark, sf), NOW, {"persist": lambda df: df.withColumn("p", F.element_at("x", -1)["congested"])}
    )
    summary, travel = streets.two_hour_report(forecast)[1:]
    return summary.join(travel, "street_name").withColumns(
        {c: F.array_join(c, ",") for c in ("avoid_slots", "good_slots")}
    )


@query("fc_18_model_registry", sql("""
SELECT street_name, street_name AS slug, 'logit' AS model_type, CAST(16 AS INTEGER) AS timesteps, 'trained' AS status,
       'models/logit_' || street_name AS model_path
FROM slots GROUP BY street_name
HAVING count(*) > 26 AND count(*) - 16 - floor((count(*) - 16) * 0.8e0) >= 10
""", "slots"))
def fc_18(spark, sf):
    slots = t.slots(spark, sf)
    return streets.registry_summary(streets.train_streets(slots, "logit")[1], slots)
