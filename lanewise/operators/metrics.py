"""Error metrics, each computed in one grouped aggregation, and model selection.

Choices on which published variants differ are arguments:

* ``smape``: ``"eps"`` adds 1e-8 to the denominator, ``"replace0"`` uses 1 where it is 0.
* ``mape``: ``"skip0"`` leaves zero actuals out, ``"null"`` makes the result null if any is zero.
* ``r2``: ``"null"`` is null for constant actuals, ``"sklearn"`` gives 1 if perfect, else 0.

A value that is undefined is null, so later averages skip it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.calendar import col


def complete_pairs(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows on which both values are numbers."""
    a, p = F.col(actual), F.col(predicted)
    return df.where(a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p))


def mse(a: Column | str, p: Column | str) -> Column:
    e = col(p) - col(a)
    return F.avg(e * e)


def mae(a: Column | str, p: Column | str) -> Column:
    return F.avg(F.abs(col(p) - col(a)))


def smape(a: Column | str, p: Column | str, mode: str = "eps") -> Column:
    a, p = col(a), col(p)
    size = F.abs(a) + F.abs(p)
    if mode == "eps":
        denominator = size + F.lit(1e-8)
    elif mode == "replace0":
        denominator = F.when(size == 0, F.lit(1.0)).otherwise(size)
    else:
        raise ValueError(f"unknown smape mode {mode!r}")
    return F.avg(F.lit(2.0) * F.abs(p - a) / denominator) * 100.0


def mape(a: Column | str, p: Column | str, mode: str = "skip0") -> Column:
    a, p = col(a), col(p)
    mean = F.avg(F.abs(F.try_divide(a - p, F.nullif(a, F.lit(0.0))))) * 100.0
    if mode == "skip0":
        return mean
    if mode == "null":
        return F.when(F.count_if(a == 0) == 0, mean)
    raise ValueError(f"unknown mape mode {mode!r}")


def r2(a: Column | str, p: Column | str, mode: str = "null") -> Column:
    a, p = col(a), col(p)
    residual = F.sum((a - p) * (a - p))
    total = F.count(a) * F.var_pop(a)
    ratio = F.lit(1.0) - F.try_divide(residual, F.nullif(total, F.lit(0.0)))
    if mode == "null":
        return ratio
    if mode == "sklearn":
        constant = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(total == 0, constant).otherwise(ratio)
    raise ValueError(f"unknown r2 mode {mode!r}")


def error_metrics(
    df: DataFrame,
    keys: Sequence[str],
    actual: str = "Actual",
    predicted: str = "Pred",
    smape_mode: str = "replace0",
    mape_mode: str = "skip0",
    r2_mode: str = "null",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """MSE, RMSE, MAE, MAPE, SMAPE, R2 and row count per group, and ``extra`` aggregates."""
    return (
        complete_pairs(df, actual, predicted)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            mse(actual, predicted).alias("mse"),
            F.sqrt(mse(actual, predicted)).alias("rmse"),
            mae(actual, predicted).alias("mae"),
            mape(actual, predicted, mape_mode).alias("mape"),
            smape(actual, predicted, smape_mode).alias("smape"),
            r2(actual, predicted, r2_mode).alias("r2"),
            *extra,
        )
    )


def common_metrics(
    df: DataFrame,
    keys: Sequence[str],
    actual: str,
    predicted: str,
    task: str = "regression",
    tolerance: float = 0.2,
    threshold: float = 0.5,
) -> DataFrame:
    """MSE, RMSE, MAE, SMAPE and accuracy per group.

    Accuracy is the percent of rows within ``tolerance`` relative error, or, for
    ``task="binary_prob"``, the percent that the thresholded probability gets right.
    """
    a, p = F.col(actual), F.col(predicted)
    if task == "regression":
        right = F.abs(p - a) / (F.abs(a) + F.lit(1e-8)) <= tolerance
    elif task == "binary_prob":
        right = (p >= threshold).cast("double") == a
    else:
        raise ValueError(f"unknown task {task!r}")
    return (
        complete_pairs(df, actual, predicted)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            mse(a, p).alias("MSE"),
            F.sqrt(mse(a, p)).alias("RMSE"),
            mae(a, p).alias("MAE"),
            smape(a, p, "eps").alias("SMAPE"),
            (F.avg(right.cast("double")) * 100.0).alias("Accuracy"),
        )
    )


def classification_report(
    df: DataFrame, keys: Sequence[str], actual: str, predicted: str
) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1; 0 where undefined."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    cells = df.groupBy(*keys).agg(
        F.count_if(a & p).alias("tp"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(~a & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(0.0))

    return cells.select(
        *keys,
        ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def average_metrics(
    daily: DataFrame, keys: Sequence[str] = ("RouteId", "model"), names: Sequence[str] = (
        "mse", "rmse", "mae", "mape", "smape", "r2",
    ),
) -> DataFrame:
    """Mean of daily metrics and number of days."""
    return daily.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n_days")
    )


def smape_score() -> Column:
    """SMAPE, or RMSE where SMAPE is missing."""
    return F.coalesce(F.col("smape"), F.col("rmse"))


def top_models(
    averages: DataFrame, k: int = 2, score: Column | str | None = None,
    keys: Sequence[str] = ("RouteId",),
) -> DataFrame:
    """The ``k`` models with the lowest score per route, model name breaking ties.

    Scores count as equal to nine decimals: beyond that they depend on the order in which a
    cluster happens to add them up.
    """
    scored = averages.withColumn("score", smape_score() if score is None else col(score))
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).asc_nulls_last(), "model")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def backtest_summary(
    averages: DataFrame, spans: DataFrame, k: int = 2, keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """One row per route: top models in order and a map from model to its mean metrics.

    ``spans`` holds one row per route with the evaluated dates. A route has as many rows as
    there are models, so the collected lists are short.
    """
    scored = averages.withColumn("score", smape_score())
    names = ("mse", "rmse", "mae", "mape", "smape", "r2", "score")
    entry = F.struct("model", F.struct(*names).alias("scores"))
    ranked = F.struct(
        F.coalesce(F.round("score", 9), F.lit(float("inf"))).alias("s"), F.col("model").alias("m")
    )
    grouped = scored.groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(ranked)), 1, k)["m"].alias("top_models"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics_avg"),
    )
    return spans.join(grouped, list(keys))


def choose_models(
    routes: DataFrame,
    summaries: DataFrame,
    available: DataFrame,
    default: Sequence[str] = ("seasonal_naive",),
    preferred: Sequence[str] = ("seasonal_naive", "daily_naive"),
    always: Sequence[str] = ("profile",),
) -> DataFrame:
    """Models to use per route: the backtest's choice, else available preferred ones, else the
    default; the ``always`` models are added where they are available.

    ``summaries`` has RouteId and top_models, ``available`` RouteId and models.
    """
    def literals(names: Sequence[str]) -> Column:
        return F.array(*[F.lit(n) for n in names])

    joined = routes.join(summaries.select("RouteId", "top_models"), "RouteId", "left").join(
        available.select("RouteId", "models"), "RouteId", "left"
    )
    models = F.coalesce(F.col("models"), F.array().cast("array<string>"))
    fallback = F.filter(literals(preferred), lambda m: F.array_contains(models, m))
    chosen = F.coalesce(F.col("top_models"), fallback)
    chosen = F.when(F.size(chosen) > 0, chosen).otherwise(literals(default))
    return joined.withColumn(
        "chosen", F.array_union(chosen, F.array_intersect(literals(always), models))
    ).drop("top_models", "models")


def estimated_sequences(n_test: Column | str, train_ratio: float = 0.8) -> Column:
    """Total windows guessed from the test count, truncated to whole windows."""
    t, r = col(n_test), F.lit(float(train_ratio))
    return t + F.floor(t / (F.lit(1.0) - r) * r).cast("bigint")
