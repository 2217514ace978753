"""Look-back and horizon windows, positions, splits and rolling origins.

Building every window multiplies the input by its length, so the work is spread by blocks of
positions rather than by series: one long series becomes many tasks of equal size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.session import stored

BLOCK_ROWS = 720


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """Add ``pos`` (from 0) and ``n``, the series length.

    With ``chunk``, a value that never falls along ``order`` such as the date, rows are numbered
    within a chunk and shifted by the row count of earlier chunks. Use it on raw rows, where one
    series may hold most of the data; only one count per chunk is windowed by series.
    """
    keys = list(keys)
    if chunk is None:
        w = Window.partitionBy(*keys)
        return df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn(
            "n", F.count(F.lit(1)).over(w)
        )
    chunked = df.withColumn("_chunk", chunk)
    before = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("n", F.sum("_rows").over(Window.partitionBy(*keys)))
        .drop("_rows")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_row", F.row_number().over(within))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("pos", F.col("_offset") + F.col("_row") - 1)
        .drop("_chunk", "_row", "_offset")
    )


def with_ranged_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """``pos`` and ``n`` as ``with_position`` gives them, for series that no task could hold.

    One sort by ranges of (keys, order) spreads all rows evenly, a hot series over many tasks. A
    row's number within its task is shifted by the series' rows in the tasks before, a table of
    one row per series and task. Rows equal in keys and order stay in one task, so ``order``
    should end in an id. The numbered rows are stored once, because ranges come from a sample.
    Null keys form a series; null times come first.
    """
    keys = list(keys)
    task, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    numbered = stored(
        sorted_rows.withColumn("_id", F.monotonically_increasing_id())
        .withColumns({"_task": task, "_row": row})
        .drop("_id"),
        "numbered",
    )
    series = Window.partitionBy(*keys)
    before = series.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(*keys, "_task")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_start"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_start"))
        .withColumn("n", F.sum("_rows").over(series))
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_task").alias("_of_task"), "_shift", "n")
    )
    same = F.col("_task") == F.col("_of_task")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (
        numbered.join(offsets, same)
        .withColumn("pos", F.col("_row") + F.col("_shift"))
        .select(*df.columns, "pos", "n")
    )


def chronological_split(
    df: DataFrame,
    train_ratio: float = 0.8,
    rule: str = "train_floor",
    pos: str = "pos",
    n: str = "n",
) -> DataFrame:
    """Add ``split``, ``train`` or ``test``, from a position and a series length.

    ``train_floor`` trains on the first ``floor(n * ratio)`` rows, ``train_min1`` on at least one,
    ``test_floor`` tests on the last ``max(1, floor(n * (1 - ratio)))``.
    """
    total = F.col(n).cast("double")
    if rule == "train_floor":
        n_train = F.floor(total * F.lit(float(train_ratio)))
    elif rule == "train_min1":
        n_train = F.greatest(F.lit(1), F.floor(total * F.lit(float(train_ratio))))
    elif rule == "test_floor":
        test_ratio = round(1.0 - train_ratio, 12)
        n_train = F.col(n) - F.greatest(F.lit(1), F.floor(total * F.lit(test_ratio)))
    else:
        raise ValueError(f"unknown split rule {rule!r}")
    return df.withColumn("split", F.when(F.col(pos) < n_train, "train").otherwise("test"))


def _blocks(df: DataFrame, keys: Sequence[str], back: int, ahead: int, size: int) -> DataFrame:
    """Copy each row to the blocks whose windows need it, and spread the blocks.

    Numbering left a series in one partition, which would do for windows by block as well;
    the explicit repartition makes its blocks go to different tasks.
    """
    first = F.floor((F.col("pos") - ahead) / size)
    last = F.floor((F.col("pos") + back) / size)
    copied = df.withColumn("_block", F.explode(F.sequence(first, last)))
    return copied.repartition(*keys, "_block")


def _own_block(size: int) -> Column:
    return F.floor(F.col("pos") / size) == F.col("_block")


def fit_scaler(df: DataFrame, keys: Sequence[str] = (), value: str = "Vehicles") -> DataFrame:
    """Mean and population deviation; a zero deviation becomes 1.

    Fit on hourly means or on raw rows: the caller passes the base it wants.
    """
    deviation = F.stddev_pop(value)
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias("std"),
    )


def with_scaler(df: DataFrame, scaler: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``mean`` and ``std``: by key, or from a one-row scaler as a scalar subquery."""
    if keys:
        return df.join(stored(scaler, "scaler"), list(keys))
    return df.withColumn("mean", scaler.select("mean").scalar()).withColumn(
        "std", scaler.select("std").scalar()
    )


def scaled(value: Column | str) -> Column:
    return (cal.col(value) - F.col("mean")) / F.col("std")


def unscaled(value: Column | str) -> Column:
    """Back to counts, never below 0."""
    return F.greatest(cal.col(value) * F.col("std") + F.col("mean"), F.lit(0.0))


def route_index(df: DataFrame, family: Sequence[str]) -> DataFrame:
    """Position of each route in its family's sorted route list, with the list's length.

    Works on the distinct routes of a family, not on their rows.
    """
    routes = df.select(*family, "RouteId").distinct()
    by_family = Window.partitionBy(*family)
    return routes.withColumn(
        "route_index", F.row_number().over(by_family.orderBy("RouteId")) - 1
    ).withColumn("n_routes", F.count(F.lit(1)).over(by_family))


def one_hot(index: Column | str, size: Column | str) -> Column:
    """Vector with a 1 at ``index``. Windows store the index once instead of per step."""
    i = cal.col(index)
    return F.transform(
        F.sequence(F.lit(0), cal.col(size).cast("int") - 1), lambda k: (k == i).cast("double")
    )


def sequence_windows(
    hourly: DataFrame,
    lookback: int = 168,
    horizon: int = 24,
    scaler: DataFrame | None = None,
    keys: Sequence[str] = ("RouteId",),
    drop_last: bool = False,
    scale_target: bool = True,
    stride: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per sample: ``x``, the prior ``lookback`` rows, and ``y``, the next ``horizon``.

    A step of ``x`` holds the scaled value and its four cyclic features. A series of N rows
    gives N-L-H+1 samples, or N-L-H with ``drop_last``. ``DateTime`` is the first target hour.
    """
    base = hourly if scaler is None else with_scaler(hourly, scaler)
    value = F.col("Vehicles") if scaler is None else scaled("Vehicles")
    steps = base.select(
        *keys,
        "DateTime",
        F.struct(value.alias("v"), *cal.hour_week_features("DateTime")).alias("_step"),
        (value if scale_target else F.col("Vehicles")).alias("_target"),
    )
    placed = with_position(steps, keys, ["DateTime"])
    copied = _blocks(placed, keys, lookback, horizon - 1, block_rows)
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    last_start = F.col("n") - horizon - (1 if drop_last else 0)
    return (
        copied.withColumn("x", F.collect_list("_step").over(w.rowsBetween(-lookback, -1)))
        .withColumn("y", F.collect_list("_target").over(w.rowsBetween(0, horizon - 1)))
        .where(_own_block(block_rows) & (F.col("pos") >= lookback) & (F.col("pos") <= last_start))
        .where((F.col("pos") - lookback) % stride == 0)
        .select(*keys, "DateTime", (F.col("pos") - lookback).alias("sample"), "x", "y")
    )


def congestion_windows(
    slots: DataFrame,
    lookback: int = 16,
    keys: Sequence[str] = ("street_name",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One-step samples: ``x``, the prior slots with four cyclic features, and ``y``."""
    flag = F.col("is_congested").cast("double")
    steps = slots.select(
        *keys,
        "DateTime",
        F.struct(flag.alias("congested"), *cal.minute_week_features("DateTime")).alias("_step"),
        flag.alias("y"),
    )
    return _one_step(with_position(steps, keys, ["DateTime"]), lookback, keys, block_rows)


def value_windows(
    rows: DataFrame,
    lookback: int,
    keys: Sequence[str] = ("street_name",),
    value: str = "is_congested",
    order: Sequence[str] = ("DateTime",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One-step samples of raw rows without features.

    Rows are numbered over ranges, since a street's raw rows are not bounded, not even in a day.
    """
    steps = rows.select(
        *keys, *order, F.col(value).cast("double").alias("_step"), F.col(value).cast("double").alias("y")
    )
    return _one_step(with_ranged_position(steps, keys, order), lookback, keys, block_rows)


def _one_step(
    placed: DataFrame, lookback: int, keys: Sequence[str], block_rows: int
) -> DataFrame:
    copied = _blocks(placed, keys, lookback, 0, block_rows)
    w = Window.partitionBy(*keys, "_block").orderBy("pos")
    return (
        copied.withColumn("x", F.collect_list("_step").over(w.rowsBetween(-lookback, -1)))
        .where(_own_block(block_rows) & (F.col("pos") >= lookback))
        .select(
            *keys,
            "DateTime",
            (F.col("pos") - lookback).alias("sample"),
            (F.col("n") - lookback).alias("n_samples"),
            "x",
            "y",
        )
    )


def tail_history(
    hourly: DataFrame, base, lookback: int = 168, keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """The ``lookback`` most recent hours before ``base``, with how many there are."""
    w = Window.partitionBy(*keys)
    recent = F.row_number().over(w.orderBy(F.col("DateTime").desc()))
    return (
        hourly.where(F.col("DateTime") < cal.clock(base))
        .withColumn("_age", recent)
        .where(F.col("_age") <= lookback)
        .withColumn("n_history", F.count(F.lit(1)).over(w))
        .drop("_age")
    )


def holdout(
    hourly: DataFrame, lookback: int = 168, horizon: int = 24, keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """Last ``horizon`` rows as test and the ``lookback`` before as train; short series go."""
    placed = with_position(hourly, keys, ["DateTime"])
    from_end = F.col("n") - F.col("pos")
    return (
        placed.where((F.col("n") >= lookback + horizon) & (from_end <= lookback + horizon))
        .withColumn("split", F.when(from_end <= horizon, "test").otherwise("train"))
        .withColumn("step", lookback + horizon - from_end)
        .drop("pos", "n")
    )


def evaluation_days(
    obs: DataFrame, days: int, include_last: bool = False, keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """Days to forecast in a rolling backtest, one row per series and ``origin`` midnight.

    The last ``days`` days up to the day before the last; a range that would begin before the
    first day begins on the second. With ``include_last`` it runs from the first day to the last.
    """
    span = obs.groupBy(*keys).agg(
        F.to_date(F.min("DateTime")).alias("_first"), F.to_date(F.max("DateTime")).alias("_last")
    )
    start = F.date_sub("_last", days - 1)
    early = start < F.col("_first")
    if include_last:
        start, end = F.greatest(start, F.col("_first")), F.col("_last")
    else:
        start = F.when(early, F.date_add("_first", 1)).otherwise(start)
        end = F.date_sub("_last", 1)
    return (
        span.withColumn("_start", start)
        .withColumn("_end", end)
        .where(F.col("_start") <= F.col("_end"))
        .select(*keys, F.explode(F.sequence("_start", "_end")).alias("origin"))
        .withColumn("origin", F.col("origin").cast("timestamp_ntz"))
    )


def rows_by_origin(
    rows: DataFrame, origins: DataFrame, lookback: int = 168, keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """History rows in ``[origin - lookback h, origin)`` for every origin.

    Each row goes to the midnights it serves and meets the origins in an equi join; a range
    join would compare every row with every origin of its route.
    """
    days = math.ceil(lookback / 24)
    served = F.sequence(F.date_add(F.to_date("DateTime"), 1), F.date_add(F.to_date("DateTime"), days))
    copied = rows.withColumn("origin", F.explode(served)).withColumn(
        "origin", F.col("origin").cast("timestamp_ntz")
    )
    if lookback % 24:
        copied = copied.where(
            F.col("DateTime") >= F.col("origin") - F.make_dt_interval(hours=F.lit(lookback))
        )
    return copied.join(origins.select(*keys, "origin"), [*keys, "origin"])
