"""Error metrics, model selection and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.catalog import tables as t
from lanewise.catalog.registry import query, rd, sql
from lanewise.catalog.source_queries import _AVERAGES, _summaries
from lanewise.operators import metrics, rollups
from lanewise.sources import artifacts

_SIX = ("mse", "rmse", "mae", "mape", "smape", "r2")
_SIX_SQL = ", ".join(rd(m, m) for m in _SIX)
_MSE = "avg((Actual - Pred) * (Actual - Pred))"
_EPS = "avg(2 * abs(Pred - Actual) / (abs(Actual) + abs(Pred) + 1e-8)) * 100"


@query("met_01_regression_metrics", sql(f"""
SELECT model, count(*) AS n, {rd(_MSE, 'MSE')}, {rd(f'sqrt({_MSE})', 'RMSE')},
       {rd('avg(abs(Actual - Pred))', 'MAE')}, {rd(_EPS, 'SMAPE')},
       {rd('avg(CASE WHEN abs(Pred - Actual) / (abs(Actual) + 1e-8) <= 0.2 THEN 1e0 ELSE 0e0 END) * 100', 'Accuracy')}
FROM pairs GROUP BY model
""", "pairs"))
def met_01(spark, sf):
    return metrics.common_metrics(t.pairs(spark, sf), ["model"], "Actual", "Pred")


@query("met_02_probability_metrics", sql(f"""
SELECT street_name, count(*) AS n, {rd('avg((p - Actual) * (p - Actual))', 'MSE')},
       {rd('sqrt(avg((p - Actual) * (p - Actual)))', 'RMSE')}, {rd('avg(abs(p - Actual))', 'MAE')},
       {rd('avg(2 * abs(p - Actual) / (abs(Actual) + abs(p) + 1e-8)) * 100', 'SMAPE')},
       {rd('avg(CASE WHEN (p >= 0.5) = (Actual = 1) THEN 1e0 ELSE 0e0 END) * 100', 'Accuracy')}
FROM slot_pairs GROUP BY street_name
""", "slot_pairs"))
def met_02(spark, sf):
    return metrics.common_metrics(
        t.slot_pairs(spark, sf), ["street_name"], "Actual", "p", task="binary_prob"
    )


@query("met_03_daily_metrics", sql(
    f"SELECT RouteId, date, model, n, {_SIX_SQL} FROM daily_scores", "daily_scores"))
def met_03(spark, sf):
    return t.daily_scores(spark, sf)


def _variant(source, actual, predicted):
    """Null when any actual is 0, and R2 as 1 or 0 for a constant actual."""
    a, p = actual, predicted
    return f"""
SELECT RouteId, count(*) AS n, {rd(f'avg(({a} - {p}) ** 2)', 'mse')}, {rd(f'sqrt(avg(({a} - {p}) ** 2))', 'rmse')},
       {rd(f'avg(abs({a} - {p}))', 'mae')},
       CASE WHEN count(*) FILTER ({a} = 0) = 0 THEN round(avg(abs(({a} - {p}) / nullif({a}, 0))) * 100 + 1e-9, 6) END AS mape,
       {rd(f'avg(2 * abs({p} - {a}) / CASE WHEN abs({a}) + abs({p}) = 0 THEN 1 ELSE abs({a}) + abs({p}) END) * 100', 'smape')},
       CASE WHEN var_pop({a}) = 0 THEN CASE WHEN sum(({a} - {p}) ** 2) = 0 THEN 1e0 ELSE 0e0 END
            ELSE round(1 - sum(({a} - {p}) ** 2) / (count(*) * var_pop({a})) + 1e-9, 6) END AS r2
FROM {source} WHERE {a} IS NOT NULL AND {p} IS NOT NULL GROUP BY RouteId
"""


@query("met_04_daily_variant", sql(_variant("sales_daily_wide", "DailyActual", "Daily_lag7"), "sales_daily_wide"))
def met_04(spark, sf):
    wide = t.daily_wide(spark, sf, t.sales)
    return metrics.error_metrics(
        wide, ["RouteId"], "DailyActual", "Daily_lag7", mape_mode="null", r2_mode="sklearn"
    )


@query("met_04_weekly_variant", sql(_variant("""(
SELECT RouteId, date_trunc('week', Date) AS w, sum(DailyActual) AS a, coalesce(sum(Daily_lag7), 0) AS p
FROM sales_daily_wide GROUP BY 1, 2)""", "a", "p"), "sales_daily_wide"))
def met_04_weekly(spark, sf):
    weekly = rollups.weekly_sum(t.daily_wide(spark, sf, t.sales))
    return metrics.error_metrics(
        weekly, ["RouteId"], "WeeklyActual", "Weekly_lag7", mape_mode="null", r2_mode="sklearn"
    )


@query("met_04_monthly_variant", sql(_variant("""(
SELECT RouteId, date_trunc('month', Date) AS w, sum(DailyActual) AS a, coalesce(sum(Daily_lag1), 0) AS p
FROM sales_daily_wide GROUP BY 1, 2)""", "a", "p"), "sales_daily_wide"))
def met_04_monthly(spark, sf):
    monthly = rollups.monthly_sum(t.daily_wide(spark, sf, t.sales))
    return metrics.error_metrics(
        monthly, ["RouteId"], "MonthlyActual", "Monthly_lag1", mape_mode="null", r2_mode="sklearn"
    )


@query("met_04_congestion_as_error", sql(_variant(
    "(SELECT street_name AS RouteId, Actual, p FROM slot_pairs)", "Actual", "p"), "slot_pairs"))
def met_04_zeros(spark, sf):
    """Zero actuals: MAPE is null in this mode."""
    rows = t.slot_pairs(spark, sf).withColumnRenamed("street_name", "RouteId")
    return metrics.error_metrics(rows, ["RouteId"], "Actual", "p", mape_mode="null", r2_mode="sklearn")


@query("met_05_classification_report", sql(f"""
SELECT street_name, {rd('(tp + tn) / n', 'acc')}, {rd('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')},
       {rd('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
       {rd('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, CAST(tp + fn AS BIGINT) AS support
FROM (SELECT street_name, count(*)::DOUBLE AS n,
             (count(*) FILTER (Actual = 1 AND p >= 0.6))::DOUBLE AS tp, (count(*) FILTER (Actual = 0 AND p >= 0.6))::DOUBLE AS fp,
             (count(*) FILTER (Actual = 1 AND p < 0.6))::DOUBLE AS fn, (count(*) FILTER (Actual = 0 AND p < 0.6))::DOUBLE AS tn
      FROM slot_pairs GROUP BY 1)
""", "slot_pairs"))
def met_05(spark, sf):
    rows = t.slot_pairs(spark, sf).withColumn("predicted", (F.col("p") >= 0.6).cast("int"))
    return metrics.classification_report(rows, ["street_name"], "Actual", "predicted")


@query("met_06_average_metrics", sql(f"SELECT RouteId, model, {_SIX_SQL}, n_days FROM ({_AVERAGES})", "daily_scores"))
def met_06(spark, sf):
    return metrics.average_metrics(t.daily_scores(spark, sf))


def _top(order, score, name):
    return sql(f"""
SELECT RouteId, model, {rd(score, 'score')}, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY RouteId ORDER BY {order}, model) AS rank FROM ({_AVERAGES}))
WHERE rank <= {name}
""", "daily_scores")


@query("met_07_top_models_by_smape", _top("coalesce(smape, rmse)", "coalesce(smape, rmse)", 2))
def met_07(spark, sf):
    averages = metrics.average_metrics(t.daily_scores(spark, sf))
    return metrics.top_models(averages).select("RouteId", "model", "score", "rank")


@query("met_08_top_model_by_mae", _top("mae", "mae", 1))
def met_08(spark, sf):
    averages = metrics.average_metrics(t.daily_scores(spark, sf))
    return metrics.top_models(averages, 1, "mae").select("RouteId", "model", "score", "rank")


@query("met_09_summary_rows", sql(f"""
SELECT RouteId AS route_id, model, {rd('mse', 'mse')}, {rd('smape', 'smape')},
       {rd('coalesce(smape, rmse)', 'score')},
       CAST(row_number() OVER (PARTITION BY RouteId ORDER BY coalesce(smape, rmse), model) AS INTEGER) AS place
FROM ({_AVERAGES})
""", "daily_scores"))
def met_09(spark, sf):
    rows = _summaries(spark, sf)
    scores = artifacts.summary_scores(rows).select("route_id", "model", "mse", "smape", "score")
    places = rows.select("route_id", F.posexplode("top_models").alias("i", "model"))
    return scores.join(places, ["route_id", "model"]).withColumn("place", F.col("i") + 1).drop("i")


@query("met_10_choose_models", sql(f"""
SELECT RouteId, CASE RouteId WHEN 'click' THEN 'daily_naive,profile' WHEN 'view' THEN 'seasonal_naive'
                ELSE (SELECT string_agg(model, ',' ORDER BY coalesce(smape, rmse), model)
                      FROM ({_AVERAGES}) a WHERE a.RouteId = r.RouteId) || ',profile' END AS chosen
FROM (SELECT DISTINCT RouteId FROM obs) r
""", "daily_scores"))
def met_10(spark, sf):
    """One route without a summary, one without summary or models, the others with both."""
    routes = t.obs(spark, sf).select("RouteId").distinct()
    summaries = _summaries(spark, sf).where(~F.col("route_id").isin("click", "view"))
    summaries = summaries.withColumnRenamed("route_id", "RouteId")
    available = routes.where("RouteId <> 'view'").withColumn(
        "models", F.array(F.lit("daily_naive"), F.lit("profile"))
    )
    chosen = metrics.choose_models(routes, summaries, available)
    return chosen.withColumn("chosen", F.array_join("chosen", ","))


@query("met_11_estimated_sequences", sql("""
SELECT o_custkey, count(*) AS n_test, count(*) + CAST(floor(count(*) / (1 - 0.8e0) * 0.8e0) AS BIGINT) AS n_total
FROM orders GROUP BY 1
"""))
def met_11(spark, sf):
    tests = t.load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_test"))
    return tests.withColumn("n_total", metrics.estimated_sequences("n_test"))
