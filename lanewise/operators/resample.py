"""Hourly resampling, complete grids and gap filling.

After ``hourly_mean`` a series has at most one row per hour of the clock (8,784 a year), so a
window over one series is small however many raw rows a route has. Raw rows are only ever
combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal

ROUTE = ("RouteId",)


def group_by_hour(
    df: DataFrame, keys: Sequence[str], ts: str, aggregates: Sequence[Column]
) -> DataFrame:
    """Aggregate per series and hour of the clock.

    Rows are grouped by date and hour number, which are cheap to take from a timestamp; the hour
    mark is put together afterwards, once per group.
    """
    grouped = df.groupBy(
        *keys, F.to_date(ts).alias("_day"), F.hour(ts).alias("_hour")
    ).agg(*aggregates)
    others = [c for c in grouped.columns if c not in (*keys, "_day", "_hour")]
    mark = cal.plus_hours(F.col("_day").cast("timestamp_ntz"), F.col("_hour"))
    return grouped.select(*keys, mark.alias(ts), *others)


def hourly_mean(
    obs: DataFrame, keys: Sequence[str] = ROUTE, ts: str = "DateTime", value: str = "Vehicles"
) -> DataFrame:
    """Mean per series and hour; hours without a value are absent."""
    means = group_by_hour(obs, keys, ts, [F.avg(value).alias(value)])
    return means.where(F.col(value).isNotNull())


def hourly_grid(
    hourly: DataFrame, keys: Sequence[str] = ROUTE, ts: str = "DateTime", value: str = "Vehicles"
) -> DataFrame:
    """Every hour between a series' first and last row; added hours have a null value.

    Each row emits itself and the empty hours up to the next row, so no join is needed.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    following = F.coalesce(
        F.lead(ts).over(w) - F.make_dt_interval(hours=F.lit(1)), F.col(ts)
    )
    hours = F.sequence(F.col(ts), F.col("_last"), F.make_dt_interval(hours=F.lit(1)))
    return (
        hourly.withColumn("_last", following)
        .withColumn("_hour", F.explode(hours))
        .select(
            *keys,
            F.col("_hour").alias(ts),
            F.when(F.col("_hour") == F.col(ts), F.col(value)).alias(value),
        )
    )


def interpolate(
    df: DataFrame,
    keys: Sequence[str] = ROUTE,
    order: str = "DateTime",
    value: str = "Vehicles",
    limit: int | None = None,
    both_ways: bool = False,
) -> DataFrame:
    """Linear fill by row position.

    Forward fill reaches at most ``limit`` rows past a known value, on the straight line to the
    next known value; a trailing gap repeats the last value. With ``both_ways`` a leading gap
    takes the first value. The backward pass is a descending running window: a frame that ends
    at the last row would cost quadratic time.
    """
    up = Window.partitionBy(*keys).orderBy(order)
    down = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    so_far = (Window.unboundedPreceding, Window.currentRow)
    known = F.when(
        F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("_pos").alias("p"))
    )
    marked = (
        df.withColumn("_pos", F.row_number().over(up))
        .withColumn("_prev", F.last(known, ignorenulls=True).over(up.rowsBetween(*so_far)))
        .withColumn("_next", F.last(known, ignorenulls=True).over(down.rowsBetween(*so_far)))
    )
    prev, after, pos = F.col("_prev"), F.col("_next"), F.col("_pos")
    on_line = prev["v"] + (after["v"] - prev["v"]) * (pos - prev["p"]) / (after["p"] - prev["p"])
    forward = F.when(after.isNull(), prev["v"]).otherwise(on_line)
    if limit is not None:
        forward = F.when(pos - prev["p"] <= limit, forward)
    filled = F.when(prev.isNotNull(), forward)
    if both_ways:
        filled = F.coalesce(filled, after["v"])
    return marked.withColumn(value, F.coalesce(F.col(value), filled)).drop("_pos", "_prev", "_next")


def fill_hourly(
    hourly: DataFrame,
    policy: str = "limit3",
    keys: Sequence[str] = ROUTE,
    ts: str = "DateTime",
    value: str = "Vehicles",
) -> DataFrame:
    """Complete the grid and fill it by one of the gap policies.

    ``drop`` leaves empty hours out, ``limit3`` fills three hours forward and keeps the rest as
    null, ``both`` fills everything.
    """
    if policy == "drop":
        return hourly
    grid = hourly_grid(hourly, keys, ts, value)
    if policy == "limit3":
        return interpolate(grid, keys, ts, value, limit=3)
    if policy == "both":
        return interpolate(grid, keys, ts, value, both_ways=True)
    raise ValueError(f"unknown gap policy {policy!r}")
