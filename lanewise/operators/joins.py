"""Joins: nearest in time, spines, and lookups in dimension tables.

Small sides are not hinted as broadcast. Spark broadcasts a side only when its size, taken from
its files or measured at run time, is under ``spark.sql.autoBroadcastJoinThreshold``; a larger one
falls back to a shuffled join, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("RouteId",),
    ts: str = "DateTime",
    value: str = "Vehicles",
    tolerance: dt.timedelta = dt.timedelta(minutes=30),
    right_order: Column | None = None,
) -> DataFrame:
    """Add the right ``value`` nearest in time, both ways, within an inclusive tolerance.

    The earlier row wins a tie. Of right rows at one time the last (by ``right_order``) is used
    looking back and the first looking ahead. Unmatched left rows keep a null.

    Both sides are first reduced to distinct (key, time), which combines map-side, then matched
    in windows of one key and one hour; right times within the tolerance of an hour's edge are
    copied to the neighbour. A hot route is thereby spread over its hours, and the windows hold
    distinct times only. The final equi join brings the match to every left row.
    """
    if tolerance > dt.timedelta(hours=1):
        raise ValueError("tolerance must not exceed the one-hour bucket")
    by = list(by)
    tol = F.lit(tolerance)
    order = F.col(value) if right_order is None else right_order
    right_times = right.groupBy(*by, ts).agg(
        F.max_by(value, order).alias("_last"), F.min_by(value, order).alias("_first")
    )
    buckets = F.sequence(cal.hour_number(F.col(ts) - tol), cal.hour_number(F.col(ts) + tol))
    right_side = right_times.select(
        *by, ts, F.explode(buckets).alias("_bucket"), F.lit(0).alias("_side"), "_first", "_last"
    )
    left_side = left.select(*by, ts).distinct().select(
        *by,
        ts,
        cal.hour_number(ts).alias("_bucket"),
        F.lit(1).alias("_side"),
        F.lit(None).cast(dict(right.dtypes)[value]).alias("_first"),
        F.lit(None).cast(dict(right.dtypes)[value]).alias("_last"),
    )
    is_right = F.col("_side") == 0
    group = Window.partitionBy(*by, "_bucket")
    back = group.orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = group.orderBy(F.col(ts).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    before = F.when(is_right, F.struct(F.col(ts).alias("t"), F.col("_last").alias("v")))
    after = F.when(is_right, F.struct(F.col(ts).alias("t"), F.col("_first").alias("v")))
    found = (
        right_side.unionByName(left_side)
        .withColumn("_b", F.last(before, ignorenulls=True).over(back))
        .withColumn("_a", F.last(after, ignorenulls=True).over(ahead))
        .where(~is_right)
    )
    gap_back = F.col(ts) - F.col("_b")["t"]
    gap_ahead = F.col("_a")["t"] - F.col(ts)
    use_back = (gap_back <= tol) & (F.col("_a").isNull() | (gap_back <= gap_ahead))
    matched = found.select(
        *by,
        ts,
        F.when(use_back, F.col("_b")["v"]).when(gap_ahead <= tol, F.col("_a")["v"]).alias(value),
    ).where(F.col(value).isNotNull())
    return left.join(matched, [*by, ts], "left")


def actual_vs_predicted(
    actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = ("RouteId", "DateTime")
) -> DataFrame:
    """Hours that have both an actual and a predicted value."""
    return actual.join(predicted, list(keys))


def daily_with_models(
    actual: DataFrame,
    daily_models: DataFrame,
    models: Sequence[str],
    keys: Sequence[str] = ("RouteId",),
) -> DataFrame:
    """Daily actuals with one nullable ``Daily_<model>`` column per model.

    ``daily_models`` is long: the keys, Date, model, DailyPred.
    """
    on = [*keys, "Date"]
    wide = daily_models.groupBy(*on).pivot("model", list(models)).agg(F.avg("DailyPred"))
    renamed = wide.select(*on, *[F.col(f"`{m}`").alias(f"Daily_{m}") for m in models])
    return actual.join(renamed, on, "left")


def models_side_by_side(
    forecasts: DataFrame, models: Sequence[str], keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """One row per hour forecast by every listed model, with a ``Pred_<model>`` column each.

    An inner join of all models, done as one grouping. The rows usually come from a union; the
    explicit repartition keeps the grouping from relying on partitioning the union reports.
    """
    wide = (
        forecasts.where(F.col("model").isin(list(models)))
        .repartition(*keys, "DateTime")
        .groupBy(*keys, "DateTime")
        .pivot("model", list(models))
        .agg(F.avg("PredictedVehicles"))
    )
    named = wide.select(
        *keys, "DateTime", *[F.col(f"`{m}`").alias(f"Pred_{m}") for m in models]
    )
    return named.dropna(subset=[f"Pred_{m}" for m in models])


def on_hour_spine(
    values: DataFrame, keys: Sequence[str], hour: str, value: str
) -> DataFrame:
    """All 24 hours for every series in ``values``, null where it has none.

    ``values`` has at most one row per series and hour. Gathering those 24 and spreading them
    over the full day takes one grouping, where a join with a spine would read the input again.
    """
    by_hour = values.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(hour, value))).alias("_by_hour")
    )
    return by_hour.withColumn(hour, F.explode(F.sequence(F.lit(0), F.lit(23)))).select(
        *keys, hour, F.try_element_at("_by_hour", F.col(hour)).alias(value)
    )


def slot_spine(series: DataFrame, start_hour: int, end_hour: int) -> DataFrame:
    """The half-hour slots in ``[start_hour, end_hour)`` for every row of ``series``."""
    slots = [
        F.struct(F.lit(h).alias("hour"), F.lit(m).alias("minute"))
        for h in range(start_hour, end_hour)
        for m in (0, 30)
    ]
    return series.withColumn("_slot", F.explode(F.array(*slots))).select(
        *series.columns, "_slot.hour", "_slot.minute"
    )


def street_names_by_slug(streets: DataFrame, slug_of) -> DataFrame:
    """One street per slug; the first in name order wins a clash."""
    return (
        streets.where(F.col("street_name").isNotNull())
        .groupBy(slug_of("street_name").alias("slug"))
        .agg(F.min("street_name").alias("street_name"))
    )


def with_street_name(models: DataFrame, names: DataFrame) -> DataFrame:
    """Street name of each model's slug, or the slug itself when it is unknown."""
    return models.join(names, "slug", "left").withColumn(
        "street_name", F.coalesce("street_name", "slug")
    )


def street_of_route(geo: DataFrame, city: str, suffix: str = " (HCMC)") -> DataFrame:
    """Route id to raw street name for a city: the display name without its city suffix."""
    return geo.where(F.col("city") == city).select(
        "route_id", "name", F.replace("name", F.lit(suffix), F.lit("")).alias("street_name")
    )
