"""Street congestion models: training, registry, evaluation and the two-hour forecast.

A street's history is one row per half hour, 17,568 a year at most, whatever the number of raw
rows. That bounded series is what a per-street fit receives.

* ``logit``: one regularised logistic regression per street, fitted in its own group.
* ``mlp``: one neural network pooled over all streets, fitted by MLlib over all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.functions import slugs, travel
from lanewise.operators import filters, joins, metrics, reports, windows
from lanewise.operators.shape import union_all
from lanewise.plans.forecast import mean_of_present
from lanewise.session import stored

KEY = "street_name"
LOOKBACK = 16
STEP_FIELDS = ("congested", "time_sin", "time_cos", "week_sin", "week_cos")
_FIT_SCHEMA = f"{KEY} string, coefficients array<double>"


def labelled_windows(
    slots: DataFrame, train_ratio: float = 0.8, lookback: int = LOOKBACK, rule: str = "train_floor"
) -> DataFrame:
    """One-step windows of every street with their chronological split."""
    samples = windows.congestion_windows(slots, lookback, [KEY])
    return windows.chronological_split(samples, train_ratio, rule, pos="sample", n="n_samples")


def flat_features(x: Column | str) -> Column:
    """The five numbers of every step, in time order."""
    return F.flatten(
        F.transform(cal.col(x), lambda s: F.array(*[s[f].cast("double") for f in STEP_FIELDS]))
    )


def _newton_logit(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept, first, is not penalised."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.full(design.shape[1], ridge)
    penalty[0] = 1e-9
    beta = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + penalty * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        move = np.linalg.solve(hessian, gradient)
        beta -= move
        if np.abs(move).max() < 1e-9:
            break
    return beta


def fit_logit(
    slots: DataFrame, train_ratio: float = 0.8, ridge: float = 1.0, lookback: int = LOOKBACK
) -> DataFrame:
    """Coefficients per street: intercept, then five per step.

    Only the slot series is sent to the group; its windows are views made there, so nothing is
    multiplied in the shuffle.
    """
    series = slots.select(
        KEY,
        "DateTime",
        F.col("is_congested").cast("double").alias("congested"),
        *cal.minute_week_features("DateTime"),
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("DateTime")
        n = len(pdf) - lookback
        n_train = int(np.floor(n * train_ratio)) if n > 0 else 0
        if n_train < 1:
            return pd.DataFrame({KEY: [], "coefficients": []})
        steps = pdf[list(STEP_FIELDS)].to_numpy(float)
        views = np.lib.stride_tricks.sliding_window_view(steps, lookback, axis=0)[:n_train]
        x = views.transpose(0, 2, 1).reshape(n_train, -1)
        y = steps[lookback : lookback + n_train, 0]
        beta = _newton_logit(x, y, ridge)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "coefficients": [beta.tolist()]})

    return series.groupBy(KEY).applyInPandas(fit, _FIT_SCHEMA)


def logit_probability(features: Column, coefficients: Column) -> Column:
    """Logistic response as a JVM expression."""
    terms = F.zip_with(
        features, F.slice(coefficients, 2, F.size(coefficients) - 1), lambda a, b: a * b
    )
    score = F.aggregate(terms, F.get(coefficients, F.lit(0)), lambda total, t: total + t)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def predict_logit(samples: DataFrame, fits: DataFrame, name: str = "p") -> DataFrame:
    """Add the probability of the street's own model; null where it has none."""
    return (
        samples.join(fits, KEY, "left")
        .withColumn(name, logit_probability(flat_features("x"), F.col("coefficients")))
        .drop("coefficients")
    )


def _model_input(x: str = "x") -> Column:
    """The features as a vector of fixed size.

    The optimizer may score a row before the filter that drops incomplete windows; such a row
    gets zeros instead of failing, and is dropped afterwards.
    """
    from pyspark.ml.functions import array_to_vector

    zeros = F.array_repeat(F.lit(0.0), LOOKBACK * len(STEP_FIELDS))
    return array_to_vector(F.when(F.size(x) == LOOKBACK, flat_features(x)).otherwise(zeros))


def fit_mlp(samples: DataFrame, hidden: int = 8, max_iter: int = 30, seed: int = 7):
    """Pooled network on the training windows of all streets."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    train = samples.where(F.col("split") == "train").select(
        _model_input().alias("features"), F.col("y").alias("label")
    )
    return MultilayerPerceptronClassifier(
        layers=[LOOKBACK * len(STEP_FIELDS), hidden, 2], maxIter=max_iter, seed=seed
    ).fit(train)


def predict_mlp(samples: DataFrame, model, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(samples.withColumn(model.getFeaturesCol(), _model_input()))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(
        model.getFeaturesCol(), "rawPrediction", "probability", "prediction"
    )


def train_streets(
    slots: DataFrame, model_type: str = "logit", folder: str = "models", train_ratio: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Train every street and test it: fitted models, and one status row per street.

    A street that is too short, or whose test part is too small, keeps a row that says so.
    """
    slots = stored(slots, "slots")
    status = filters.training_status(slots, [KEY], LOOKBACK, train_ratio=train_ratio)
    usable = slots.join(status.where(F.col("status") == "trained").select(KEY), KEY, "left_semi")
    samples = labelled_windows(usable, train_ratio)
    test = samples.where(F.col("split") == "test")
    if model_type == "logit":
        model = fit_logit(usable, train_ratio)
        scored = predict_logit(test, model)
    elif model_type == "mlp":
        model = fit_mlp(samples)
        scored = predict_mlp(test, model)
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    report = metrics.classification_report(
        scored.withColumn("predicted", (F.col("p") >= 0.5).cast("int")), [KEY], "y", "predicted"
    )
    path = F.concat_ws("/", F.lit(folder), F.concat_ws("_", F.lit(model_type), "slug"))
    registry = (
        status.join(report, KEY, "left")
        .withColumn("slug", slugs.slug(KEY))
        .withColumn("model_type", F.lit(model_type))
        .withColumn("model_path", F.when(F.col("status") == "trained", path))
    )
    return model, registry.select(
        KEY, "slug", "model_type", "timesteps",
        F.col("n_train").alias("n_train_seq"), F.col("n_test").alias("n_test_seq"),
        "acc", "f1", "precision", "recall", "support", "status", "model_path",
    )


def registry_summary(models: DataFrame, slots: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Table of trained models by slug with the street each belongs to, sorted by street."""
    names = joins.street_names_by_slug(slots.select(KEY).distinct(), slugs.slug)
    listed = models.where(F.col("status") == "trained").select("slug", "model_type", "model_path")
    return (
        joins.with_street_name(listed, names)
        .select(
            KEY, "slug", "model_type", F.lit(lookback).alias("timesteps"),
            F.lit("trained").alias("status"), "model_path",
        )
        .orderBy(KEY, "model_type")
    )


def evaluate_streets(
    slots: DataFrame, model_types: Sequence[str] = ("logit", "mlp"), train_ratio: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Test detail (street, time, actual, probability, model) and its summary per street."""
    slots = stored(slots, "slots")
    long_enough = filters.keep_long_series(slots, [KEY], LOOKBACK + 11)
    samples = labelled_windows(long_enough, train_ratio, rule="train_min1")
    test = samples.where(F.col("split") == "test").select(KEY, "DateTime", "x", "y")
    parts = []
    for kind in model_types:
        if kind == "logit":
            scored = predict_logit(test, fit_logit(long_enough, train_ratio))
        else:
            scored = predict_mlp(test, fit_mlp(samples))
        parts.append(
            scored.select(
                KEY,
                slugs.slug(KEY).alias("slug"),
                F.lit(kind).alias("model_type"),
                "DateTime",
                F.col("y").alias("Actual_is_congested"),
                F.col("p").alias("Predicted_prob"),
            )
        )
    return union_all(parts), union_all([evaluation_summary(p, train_ratio) for p in parts])


def evaluation_summary(detail: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """Stored form of the street evaluation, one row per street and model."""
    scores = metrics.common_metrics(
        detail, [KEY, "slug", "model_type"], "Actual_is_congested", "Predicted_prob", "binary_prob"
    )
    return scores.select(
        KEY, "slug", "model_type", F.col("n").alias("timesteps"),
        metrics.estimated_sequences("n", train_ratio).alias("n_seq_total"),
        F.col("n").alias("n_seq_test"), "MSE", "RMSE", "MAE", "SMAPE", "Accuracy",
    )


def last_slots(slots: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Each street's most recent slots as an array; shorter streets are left out."""
    placed = windows.with_position(slots, [KEY], ["DateTime"])
    recent = placed.where((F.col("n") > lookback) & (F.col("pos") >= F.col("n") - lookback))
    step = F.struct("DateTime", F.col("is_congested").cast("double").alias("congested"))
    return recent.groupBy(KEY).agg(F.array_sort(F.collect_list(step)).alias("_last"))


def _as_window(last: Column) -> Column:
    def features(s: Column) -> Column:
        return F.struct(
            s["congested"].alias("congested"), *cal.minute_week_features(s["DateTime"])
        )

    return F.transform(last, features)


def rollout_next(
    slots: DataFrame, predict, steps: int = 4, minutes: int = 30, lookback: int = LOOKBACK
) -> DataFrame:
    """Feed each step's 0/1 decision back in: one row per street and step with ``p``.

    ``predict`` adds column ``p`` from a window column ``x``. The four steps are four columns of
    one plan; nothing is collected between them.
    """
    state = last_slots(slots, lookback)
    for i in range(1, steps + 1):
        state = predict(state.withColumn("x", _as_window(F.col("_last"))))
        newest = F.element_at("_last", -1)["DateTime"]
        step = F.struct(
            (newest + F.make_dt_interval(mins=F.lit(minutes))).alias("DateTime"),
            F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0).alias("congested"),
        )
        state = (
            state.withColumn(f"_p{i}", F.col("p"))
            .withColumn("_last", F.concat(F.slice("_last", 2, lookback - 1), F.array(step)))
            .drop("x", "p")
        )
    answers = F.array(*[F.col(f"_p{i}") for i in range(1, steps + 1)])
    return state.select(KEY, F.posexplode(answers).alias("_i", "p")).select(
        KEY, (F.col("_i") + 1).alias("step"), "p"
    )


def fitted_predictors(slots: DataFrame, models: Sequence[str], train_ratio: float = 0.8) -> dict:
    """Functions that add ``p`` from a window, by model name."""
    known = {}
    for name in models:
        if name == "logit":
            fits = stored(fit_logit(slots, train_ratio), "logit")
            known[name] = partial(predict_logit, fits=fits)
        elif name == "mlp":
            known[name] = partial(predict_mlp, model=fit_mlp(labelled_windows(slots, train_ratio)))
        else:
            raise ValueError(f"unknown model type {name!r}")
    return known


def next_two_hours(
    slots: DataFrame,
    now,
    models: Sequence[str] | dict = ("logit", "mlp"),
    steps: int = 4,
    zone: str = "Asia/Ho_Chi_Minh",
) -> DataFrame:
    """Mean probability of the models for the slots after ``now``, a UTC clock reading.

    Steps are labelled with the local wall clock, not with the data's own end. ``models`` may
    also be a dictionary of functions that add ``p`` from a window ``x``.
    """
    slots = stored(slots, "slots")
    predictors = models if isinstance(models, dict) else fitted_predictors(slots, models)
    parts = [
        rollout_next(slots, predict, steps).withColumn("model", F.lit(name))
        for name, predict in predictors.items()
    ]
    long = union_all(parts).repartition(KEY, "step")
    wide = long.groupBy(KEY, "step").pivot("model", list(predictors)).agg(F.first("p"))
    named = wide.select(
        KEY, "step", *[F.col(f"`{m}`").alias(f"Prob_{m}") for m in predictors]
    )
    times = cal.next_slots(cal.local_clock(now, zone), steps)
    return (
        named.withColumn("DateTime", F.element_at(times, F.col("step")))
        .withColumn("p", mean_of_present([f"Prob_{m}" for m in predictors]))
        .withColumn("TimeLabel", F.date_format("DateTime", "HH:mm"))
        .withColumn("slug", slugs.slug(KEY))
    )


def two_hour_report(forecast: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels per slot, the summary per street, and its travel-time summary."""
    levels = forecast.withColumn("level", travel.congestion_level("p"))
    summary = reports.next_hours_summary(forecast, [KEY])
    travel_times = reports.travel_summary(reports.travel_table(forecast, [KEY]), [KEY])
    return levels, summary, travel_times
