"""Stored artifacts: route map, backtest summaries, metric tables, daily cache, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise import schemas


def _or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def read_route_geo(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Route coordinates; absent columns are null, an absent file is empty."""
    reader = spark.read.option("multiLine", str(multi_line).lower()).schema(schemas.ROUTE_GEO)
    return _or_empty(spark, schemas.ROUTE_GEO, lambda: reader.json(path))


def write_route_geo(geo: DataFrame, path: str, mode: str = "overwrite") -> None:
    geo.select(*schemas.ROUTE_GEO.names).write.mode(mode).json(path)


def read_backtest_summaries(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Summaries of every route; a missing file is empty and a broken one contributes no row."""
    reader = (
        spark.read.option("multiLine", str(multi_line).lower())
        .option("mode", "PERMISSIVE")
        .schema(schemas.BACKTEST_SUMMARY)
    )
    rows = _or_empty(spark, schemas.BACKTEST_SUMMARY, lambda: reader.json(path))
    return rows.where(F.col("route_id").isNotNull())


def summary_scores(summaries: DataFrame) -> DataFrame:
    """One row per route and model with its mean metrics."""
    entry = F.explode("metrics_avg").alias("model", "scores")
    return summaries.select("city", "zone", "route_id", entry).select(
        "city", "zone", "route_id", "model", "scores.*"
    )


def write_backtest_summaries(summaries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per route."""
    summaries.select(F.to_json(F.struct(*summaries.columns)).alias("value")).write.mode(mode).text(
        path
    )


def read_metric_csv(
    spark: SparkSession, path: str, schema: T.StructType = schemas.STREET_METRICS_CSV
) -> DataFrame:
    """Stored metrics by their header, in any order, with or without a byte-order mark.

    A column that the file lacks is null, but for the optional ``status`` and ``model_type``,
    which are left out.
    """
    rows = spark.read.option("header", "true").csv(path)
    names = {c.lstrip("\ufeff"): c for c in rows.columns}
    return rows.select(
        *[
            (F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
            if f.name in names or f.name not in ("status", "model_type")
        ]
    )


def trained_configs(metrics: DataFrame, default_model: str = "GRU") -> DataFrame:
    """Rows of trained streets with their model type; a table without a status keeps all rows."""
    rows = metrics.where(F.col("status") == "trained") if "status" in metrics.columns else metrics
    kind = F.col("model_type") if "model_type" in rows.columns else F.lit(default_model)
    return rows.select("street_name", "slug", "timesteps", "model_path", kind.alias("model_type"))


def write_daily_cache(daily: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store daily actuals and model columns by family and route.

    A route that is already cached is skipped; with ``overwrite`` it is replaced. Other routes
    are left as they are either way.
    """
    keys = ["family", "RouteId"]
    if not overwrite:
        empty = T.StructType([T.StructField(k, T.StringType()) for k in keys])
        cached = _or_empty(
            daily.sparkSession, empty, lambda: daily.sparkSession.read.parquet(path).select(*keys)
        )
        daily = daily.join(cached.distinct(), keys, "left_anti")
    (
        daily.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("overwrite" if overwrite else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_daily_cache(spark: SparkSession, path: str) -> DataFrame:
    """The daily cache with Date as a date. A cache without its two main columns is an error."""
    cache = spark.read.parquet(path)
    missing = {"Date", "DailyActual"} - set(cache.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    return cache.withColumn("Date", F.to_date("Date"))


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions as CSV with a header, times to the microsecond; City and Zone last if present."""
    place = [c for c in ("City", "Zone") if c in predictions.columns]
    (
        predictions.select(*schemas.PREDICTION_CSV.names, *place)
        .write.mode(mode)
        .option("header", "true")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .csv(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("header", "true")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        .schema(schemas.PREDICTION_CSV)
        .csv(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A plain parquet table: windows, scaler, sequence meta or daily metrics."""
    df.write.mode(mode).parquet(path)


def fit_once(spark: SparkSession, path: str, fit) -> DataFrame:
    """Read a stored scaler, or fit and store it when there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    write_table(fit(), path, mode="errorifexists")
    return spark.read.parquet(path)


def sequence_meta(
    obs: DataFrame, lookback: int = 168, horizon: int = 24, family: Sequence[str] = ("City",)
) -> DataFrame:
    """Look-back, horizon, sorted route list and feature count per family.

    The list holds a family's distinct routes, which its windows need as a vocabulary.
    """
    routes = obs.select(*family, "RouteId").distinct()
    listed = routes.groupBy(*family).agg(F.array_sort(F.collect_list("RouteId")).alias("routes"))
    return listed.select(
        *family,
        F.lit(lookback).alias("LOOKBACK"),
        F.lit(horizon).alias("HORIZON"),
        "routes",
        (F.size("routes") + 5).alias("n_features"),
    )


def write_evaluation(detail: DataFrame, summary: DataFrame, path: str) -> None:
    """Street evaluation: detail rows by slug and model type, and one summary table."""
    (
        detail.hint("rebalance", F.col("slug"), F.col("model_type"))
        .write.mode("overwrite")
        .partitionBy("slug", "model_type")
        .option("header", "true")
        .csv(f"{path}/details")
    )
    summary.write.mode("overwrite").option("header", "true").csv(f"{path}/summary")
