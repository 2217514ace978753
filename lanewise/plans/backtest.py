"""Rolling backtests over all routes: daily metrics, averages, best models, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.operators import joins, metrics, resample, windows
from lanewise.operators.filters import family_for_training
from lanewise.plans import forecast as fc
from lanewise.session import stored


def daily_metrics(
    obs: DataFrame,
    days: int = 365,
    models: Sequence[str] = fc.MODELS,
    min_history: int | None = None,
    include_last: bool = False,
    r2_mode: str = "null",
    keys: Sequence[str] = fc.KEYS,
) -> DataFrame:
    """Metrics per route, day and model over the hours that have an actual value.

    One hourly table feeds the actuals, the histories and the fits; ``n_model`` counts the hours
    the model itself answered, so a baseline never passes for the model.
    """
    keys = list(keys)
    hourly = stored(resample.hourly_mean(obs, keys), "hourly")
    origins = windows.evaluation_days(hourly, days, include_last, keys)
    predicted = fc.forecast(hourly, origins, models, min_history=min_history, keys=keys)
    actual = hourly.withColumnRenamed("Vehicles", "Actual")
    pairs = joins.actual_vs_predicted(actual, predicted, [*keys, "DateTime"]).withColumns(
        {
            "date": F.to_date("origin"),
            "Pred": F.col("PredictedVehicles"),
            "_own": (F.col("model_used") == F.col("model")).cast("int"),
        }
    )
    return metrics.error_metrics(
        pairs, [*keys, "date", "model"], r2_mode=r2_mode, extra=[F.sum("_own").alias("n_model")]
    )


def evaluated_span(
    obs: DataFrame, days: int = 365, include_last: bool = False, keys: Sequence[str] = fc.KEYS
) -> DataFrame:
    """First, last and number of evaluated days per route."""
    origins = windows.evaluation_days(obs, days, include_last, keys)
    return origins.groupBy(*keys).agg(
        F.date_format(F.min("origin"), "yyyy-MM-dd").alias("eval_start_date"),
        F.date_format(F.max("origin"), "yyyy-MM-dd").alias("eval_end_date"),
        F.count(F.lit(1)).cast("int").alias("n_days_evaluated"),
    )


def run(
    obs: DataFrame, days: int = 365, models: Sequence[str] = fc.MODELS,
    min_history: int | None = None, keys: Sequence[str] = fc.KEYS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily metrics, their averages, and the two best models per route."""
    daily = daily_metrics(obs, days, models, min_history, keys=keys)
    averages = metrics.average_metrics(daily, [*keys, "model"])
    return daily, averages, metrics.top_models(averages, keys=keys)


def summary(
    obs: DataFrame,
    daily: DataFrame,
    city: str | None = None,
    zone: str | None = None,
    family: str | None = None,
    days: int = 365,
    keys: Sequence[str] = fc.KEYS,
) -> DataFrame:
    """The stored summary, one row per route.

    City and zone come from the arguments, or from the data when they are among the keys; the
    family defaults to the one a trainer would write to.
    """
    averages = metrics.average_metrics(daily, [*keys, "model"])
    rows = metrics.backtest_summary(averages, evaluated_span(obs, days, keys=keys), keys=keys)
    city_column = F.lit(city) if city is not None else F.col("City")
    zone_column = F.lit(zone) if zone is not None else F.col("Zone")
    named = family_for_training(city_column, zone_column) if family is None else F.lit(family)
    return rows.select(
        city_column.alias("city"),
        zone_column.alias("zone"),
        F.col("RouteId").alias("route_id"),
        named.alias("family_name"),
        "eval_start_date",
        "eval_end_date",
        "n_days_evaluated",
        "top_models",
        "metrics_avg",
    )


def holdout_metrics(
    hourly: DataFrame, lookback: int = 168, horizon: int = 24, season: int = 24,
    keys: Sequence[str] = fc.KEYS,
) -> DataFrame:
    """RMSE and MAE of a seasonal AR(1) on each route's last ``horizon`` hours.

    Fitted on the ``lookback`` rows before. Short routes, and routes without a stationary fit,
    are left out. A route contributes at most ``lookback + horizon`` rows here.
    """
    if horizon > season:
        raise ValueError("horizon must not exceed the season")
    keys = list(keys)
    rows = windows.holdout(hourly, lookback, horizon, keys)
    w = Window.partitionBy(*keys).orderBy("step")
    levels = rows.withColumn("_y", F.col("Vehicles") - F.lag("Vehicles", season).over(w))
    levels = levels.withColumn("_x", F.lag("_y").over(w))
    train = F.col("split") == "train"
    fit = levels.where(train).groupBy(*keys).agg(
        F.regr_slope("_y", "_x").alias("_phi"),
        F.regr_intercept("_y", "_x").alias("_c"),
        F.max_by("_y", "step").alias("_last"),
    )
    base = rows.select(*keys, (F.col("step") + season).alias("step"), F.col("Vehicles").alias("_base"))
    steps = F.col("step") - lookback + 1
    mu = F.col("_c") / (F.lit(1.0) - F.col("_phi"))
    predicted = F.col("_base") + fc.ar_step(F.col("_phi"), mu, F.col("_last"), steps)
    tested = (
        rows.where(F.col("split") == "test")
        .join(base, [*keys, "step"])
        .join(fit.where(F.abs("_phi") < 1), keys)
        .withColumn("_p", predicted)
    )
    return tested.groupBy(*keys).agg(
        F.sqrt(metrics.mse("Vehicles", "_p")).alias("RMSE"), metrics.mae("Vehicles", "_p").alias("MAE")
    )


def linear_direct(
    obs: DataFrame,
    train_ratio: float = 0.8,
    lookback: int = 168,
    min_history: int | None = None,
    family: Sequence[str] = ("City",),
    keys: Sequence[str] = fc.KEYS,
) -> DataFrame:
    """One pooled linear model over all routes, trained on the earlier days, applied to the rest.

    One row per (origin, step), with the values a week and a day before, the history's mean, the
    last hour before the origin, cyclic calendar terms and the route's index. Lag columns stand
    in for a 168-step tensor: they carry what a linear model can use, at a small share of the
    size. The solver adds up one small matrix per partition. Without any training row the result
    is empty.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    keys = list(keys)
    samples = stored(
        linear_samples(obs, lookback, min_history, keys, train_ratio, family), "samples"
    )
    features = [
        "seasonal_naive", "daily_naive", "history_mean", "last_value",
        "hour_sin", "hour_cos", "dow_sin", "dow_cos", "route_index",
    ]
    train = samples.where(F.col("split") == "train")
    if train.isEmpty():
        return samples.limit(0).select(
            *keys, "origin", "DateTime", "Actual",
            F.col("Actual").alias("PredictedVehicles"), F.lit("").alias("model_used"),
        )
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"),
            LinearRegression(
                featuresCol="features", labelCol="Actual", solver="normal", regParam=1e-6
            ),
        ]
    ).fit(train)
    return model.transform(samples.where(F.col("split") == "test")).select(
        *keys,
        "origin",
        "DateTime",
        "Actual",
        F.greatest("prediction", F.lit(0.0)).alias("PredictedVehicles"),
        F.lit("linear_direct").alias("model_used"),
    )


def linear_samples(
    obs: DataFrame, lookback: int = 168, min_history: int | None = None,
    keys: Sequence[str] = fc.KEYS, train_ratio: float = 0.8, family: Sequence[str] = ("City",),
) -> DataFrame:
    """Training rows of the pooled model, with a chronological split by origin day.

    A route belongs to one family; its index is its place in the family's sorted routes.
    """
    keys = list(keys)
    hourly = stored(resample.hourly_mean(obs, keys), "hourly")
    origins = hourly.select(*keys, cal.day_floor("DateTime").alias("origin")).distinct()
    stats = fc.history_stats(hourly, origins, lookback, keys).where(
        F.col("n_history") >= (lookback if min_history is None else min_history)
    )
    ordered = windows.chronological_split(
        windows.with_position(stats, keys, ["origin"]), train_ratio
    ).drop("pos", "n")
    last_hour = hourly.select(
        *keys, cal.plus_hours("DateTime", 1).alias("origin"), F.col("Vehicles").alias("last_value")
    )
    located = ordered.join(last_hour, [*keys, "origin"])
    rows = fc.forecast_hours(located).join(
        hourly.withColumnRenamed("Vehicles", "Actual"), [*keys, "DateTime"]
    )
    for name, lag in fc.LAGS.items():
        rows = rows.join(fc.lagged(hourly, lag, name, keys), [*keys, "DateTime"])
    indexed = windows.route_index(obs, family).select("RouteId", "route_index")
    return rows.join(indexed, "RouteId").select("*", *cal.hour_week_features("DateTime"))
