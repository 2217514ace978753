"""Volume forecasts: every route and every origin in one job.

A forecast looks back ``lookback`` hours from an origin midnight and yields ``horizon`` hours. The
estimators are exchangeable:

* ``seasonal_naive``, ``daily_naive``: the value one week or one day before.
* ``profile``: the mean of earlier hours with the same weekday and hour.
* ``ar1``: AR(1) fitted to all history before the origin.
* ``sar1``: the same on daily differences, added back to the last day.
* ``linear``: least squares pooled over the routes of a city, on lags, history and the calendar.

Where an estimator cannot answer, the mean of the history does, and ``model_used`` says so.

All windows below run over hourly or daily rows of one route, at most 8,784 or 366 a year; raw
rows only ever go through combining aggregations. Jobs that use the hourly table several times
store it first, so the raw rows are scanned once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.operators import joins, resample, rollups, windows
from lanewise.operators.filters import drop_past
from lanewise.operators.shape import union_all
from lanewise.plans import pooled
from lanewise.session import stored

KEYS = ("RouteId",)
LAGS = {"seasonal_naive": 168, "daily_naive": 24}
ROLLOUT_SEASONS = {"ar1": 0, "sar1": 24}
MODELS = ("seasonal_naive", "daily_naive", "profile", "ar1", "sar1", "linear")
FITTED = ("ar1", "sar1")
BASELINE = "baseline"
REGRESSORS = (
    "seasonal_naive", "daily_naive", "history_mean", "last_value",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
)


def hourly_totals(obs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum, count and mean per hour: one pass that serves hourly and daily consumers."""
    value = F.col("Vehicles")
    parts = [F.sum(value).alias("Total"), F.count(value).alias("Rows"), F.avg(value).alias("Vehicles")]
    totals = resample.group_by_hour(obs, keys, "DateTime", parts)
    return totals.where(F.col("Vehicles").isNotNull())


def history_stats(
    hourly: DataFrame, origins: DataFrame, lookback: int = 168, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean and number of non-empty hours in the clock window before each origin.

    For whole days the hours are first added up by day, which leaves a 24th of the rows to copy.
    """
    if lookback % 24 == 0:
        parts = hourly.groupBy(*keys, cal.day_floor("DateTime").alias("DateTime")).agg(
            F.sum("Vehicles").alias("_sum"), F.count("Vehicles").alias("_count")
        )
    else:
        parts = hourly.select(
            *keys, "DateTime", F.col("Vehicles").alias("_sum"), F.lit(1).alias("_count")
        )
    served = windows.rows_by_origin(parts, origins, lookback, keys)
    return served.groupBy(*keys, "origin").agg(
        (F.sum("_sum") / F.sum("_count")).alias("history_mean"),
        F.sum("_count").cast("bigint").alias("n_history"),
    )


def forecast_hours(origins: DataFrame, horizon: int = 24) -> DataFrame:
    """One row per origin and forecast hour."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon - 1)))
    return origins.withColumn("step", steps).withColumn(
        "DateTime", cal.plus_hours("origin", F.col("step"))
    )


def baseline_mean(
    hourly: DataFrame, origins: DataFrame, lookback: int = 168, horizon: int = 24,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The history's mean for every hour, 0 where there is no history."""
    stats = history_stats(hourly, origins, lookback, keys)
    known = origins.select(*keys, "origin").distinct().join(stats, [*keys, "origin"], "left")
    return forecast_hours(known, horizon).select(
        *keys,
        "origin",
        "DateTime",
        F.coalesce("history_mean", F.lit(0.0)).alias("PredictedVehicles"),
        F.lit(BASELINE).alias("model_used"),
    )


def lagged(hourly: DataFrame, lag: int, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each hour's value moved ``lag`` hours ahead, ready for an equi join."""
    return hourly.select(
        *keys, cal.plus_hours("DateTime", lag).alias("DateTime"), F.col("Vehicles").alias(name)
    )


def profile_means(
    hourly: DataFrame, targets: DataFrame, name: str = "profile", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean of all earlier hours with the target's weekday and hour.

    Targets and history share one running window; equal weekdays are seven days apart, so for
    horizons up to a week everything earlier than a target precedes its origin too.
    """
    past = hourly.select(*keys, "DateTime", F.col("Vehicles").alias("_v"), F.lit(1).alias("_side"))
    ahead = targets.select(*keys, "DateTime").distinct().select(
        *keys, "DateTime", F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_side")
    )
    w = (
        Window.partitionBy(*keys, F.weekday("DateTime"), F.hour("DateTime"))
        .orderBy("DateTime", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        past.unionByName(ahead)
        .withColumn(name, F.avg("_v").over(w))
        .where(F.col("_side") == 0)
        .select(*keys, "DateTime", name)
    )


def filled_series(hourly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gap-free hourly series with ``known_at``, the observed hour that completes each row."""
    grid = resample.hourly_grid(hourly, keys).withColumn(
        "_seen", F.when(F.col("Vehicles").isNotNull(), F.col("DateTime"))
    )
    down = Window.partitionBy(*keys).orderBy(F.col("DateTime").desc())
    ahead = F.last("_seen", ignorenulls=True).over(
        down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return resample.interpolate(
        grid.withColumn("known_at", ahead).drop("_seen"), keys, both_ways=True
    )


def fit_ar(
    hourly: DataFrame,
    origins: DataFrame,
    seasons: dict[str, int] | None = None,
    fill_first: bool = False,
    min_points: int = 24,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """AR(1) with intercept for every origin, on all history before it.

    ``seasons`` names the fits; a fit with a season models the differences to that many hours
    earlier. Each becomes a struct of ``phi``, ``mu``, ``last_time`` and ``last_level``, whose
    phi and mu are null where it is not stationary or the history is shorter than
    ``min_points`` hours.

    The series is gap-filled linearly. By default it is cut at the origin before filling, so an
    hour filled from a value at or after the origin does not count. ``fill_first`` fills before
    cutting, which lets later values reach the end of the history.

    Each day adds five sums per fit, and running sums over days serve every origin, so the cost
    does not grow with the number of origins.
    """
    keys = list(keys)
    seasons = seasons or {"ar1": 0}
    w = Window.partitionBy(*keys).orderBy("DateTime")
    series = filled_series(hourly, keys).withColumn(
        "_day", F.to_date("DateTime" if fill_first else "known_at")
    )
    value = F.col("Vehicles")
    levels = {n: value - F.lag(value, lag).over(w) if lag else value for n, lag in seasons.items()}
    series = series.withColumns({f"_y_{n}": level for n, level in levels.items()})
    series = series.withColumns({f"_x_{n}": F.lag(f"_y_{n}").over(w) for n in seasons})
    complete = F.lit(True) if fill_first else F.col("DateTime") == F.col("known_at")
    state = F.struct("DateTime", *[F.col(f"_y_{n}").alias(n) for n in seasons])
    sums = {}
    for n in seasons:
        x, y = F.col(f"_x_{n}"), F.when(F.col(f"_x_{n}").isNotNull(), F.col(f"_y_{n}"))
        pairs = {"n": F.count(y), "sx": F.sum(x), "sy": F.sum(y)}
        pairs |= {"sxx": F.sum(x * x), "sxy": F.sum(x * y)}
        sums |= {f"_{stat}_{n}": agg for stat, agg in pairs.items()}
    daily = series.groupBy(*keys, "_day").agg(
        *[agg.alias(c) for c, agg in sums.items()],
        F.max(F.when(complete, state)).alias("_state"),
        F.min("DateTime").alias("_first"),
        F.lit(1).alias("_side"),
    )
    asked = origins.select(*keys, F.to_date("origin").alias("_day")).distinct()
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("_day", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at_origin = (
        daily.unionByName(asked.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        .select(
            *keys,
            "_side",
            F.col("_day").cast("timestamp_ntz").alias("origin"),
            *[F.sum(c).over(so_far).alias(c) for c in sums],
            F.last("_state", ignorenulls=True).over(so_far).alias("_state"),
            F.min("_first").over(so_far).alias("_first"),
        )
        .where(F.col("_side") == 0)
    )
    last_time = F.col("_state.DateTime")
    long_enough = cal.hours_between("_first", last_time) + 1 >= min_points

    def fit(name: str) -> Column:
        n, sx, sy, sxx, sxy = (F.col(f"_{c}_{name}") for c in ("n", "sx", "sy", "sxx", "sxy"))
        slope = F.try_divide(n * sxy - sx * sy, F.nullif(n * sxx - sx * sx, F.lit(0.0)))
        phi = F.when((F.abs(slope) < 1) & long_enough, slope)
        mu = F.try_divide(sy - phi * sx, n) / (F.lit(1.0) - phi)
        return F.struct(
            phi.alias("phi"),
            mu.alias("mu"),
            last_time.alias("last_time"),
            F.col(f"_state.{name}").alias("last_level"),
        )

    return at_origin.select(*keys, "origin", *[fit(name).alias(name) for name in seasons])


def ar_step(phi: Column, mu: Column, last: Column, steps: Column) -> Column:
    """Value of an AR(1) process ``steps`` after its last one."""
    return mu + F.pow(phi, steps.cast("double")) * (last - mu)


def _with_ar(rows: DataFrame, name: str) -> DataFrame:
    fit = F.col(f"_{name}")
    steps = cal.hours_between(fit["last_time"], F.col("DateTime"))
    return rows.withColumn(name, ar_step(fit["phi"], fit["mu"], fit["last_level"], steps))


def _with_seasonal_ar(
    rows: DataFrame, hourly: DataFrame, name: str, season: int, keys: Sequence[str]
) -> DataFrame:
    """Add the forecast differences, one per season back to the last observed one, to it."""
    fit = F.col(f"_{name}")
    steps = cal.hours_between(fit["last_time"], F.col("DateTime"))
    seasons = F.ceil(steps / season).cast("int")
    base = filled_series(hourly, keys).select(
        *keys, F.col("DateTime").alias("_base_time"), F.col("Vehicles").alias("_base")
    )
    differences = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.col("_seasons"), F.lit(1)) - 1),
        F.lit(0.0),
        lambda total, j: total
        + ar_step(fit["phi"], fit["mu"], fit["last_level"], F.col("_steps") - j * season),
    )
    return (
        rows.withColumn("_steps", steps)
        .withColumn("_seasons", seasons)
        .withColumn("_base_time", cal.plus_hours("DateTime", -season * F.col("_seasons")))
        .join(base, [*keys, "_base_time"], "left")
        .withColumn(name, F.col("_base") + differences)
        .drop("_steps", "_seasons", "_base_time", "_base")
    )


def regressors(rows: DataFrame, hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add struct ``_x`` with the regressors to forecast hours that have ``history_mean``.

    All are known at the origin: the values a week and a day before the hour, the history's mean,
    the last hour before the origin, and the calendar.
    """
    last_hour = hourly.select(
        *keys, cal.plus_hours("DateTime", 1).alias("origin"), F.col("Vehicles").alias("_last_value")
    )
    rows = rows.join(last_hour, [*keys, "origin"], "left")
    for name, lag in LAGS.items():
        rows = rows.join(lagged(hourly, lag, f"_{name}", keys), [*keys, "DateTime"], "left")
    known = [F.col(f"_{n}").alias(n) for n in LAGS]
    known += [F.col("history_mean"), F.col("_last_value").alias("last_value")]
    cells = F.struct(*known, *cal.hour_week_features("DateTime"))
    return rows.withColumn("_x", cells).drop("_last_value", *[f"_{n}" for n in LAGS])


def regression_rows(
    hourly: DataFrame, lookback: int = 168, min_history: int | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Training rows of ``linear``: every observed hour as seen from the midnight before it.

    Days with fewer than ``min_history`` non-empty hours of look-back have none.
    """
    keys = list(keys)
    days = hourly.select(*keys, cal.day_floor("DateTime").alias("origin")).distinct()
    stats = history_stats(hourly, days, lookback, keys).where(
        F.col("n_history") >= (lookback if min_history is None else min_history)
    )
    actual = hourly.withColumnRenamed("Vehicles", "Actual")
    rows = forecast_hours(stats).join(actual, [*keys, "DateTime"])
    return regressors(rows, hourly, keys).select(
        *keys, "origin", "DateTime", "Actual", *[F.col(f"_x.{n}").alias(n) for n in REGRESSORS]
    )


def fit_linear(
    hourly: DataFrame, origins: DataFrame, lookback: int = 168, min_history: int | None = None,
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Fits of ``linear`` for every origin, and each route's own means, by ``pooled.fit``.

    Routes of a city share a fit where City is among the keys; otherwise all routes do.
    """
    rows = regression_rows(hourly, lookback, min_history, keys)
    return pooled.fit(rows, origins, REGRESSORS, "Actual", keys, _family(keys))


def _family(keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k == "City"]


def _with_linear(rows: DataFrame, hourly: DataFrame, fitted, keys: Sequence[str]) -> DataFrame:
    fits, centres = fitted
    fits = fits.select(*_family(keys), "origin", "slopes")
    found = (
        regressors(rows, hourly, keys)
        .join(centres, [*keys, "origin"], "left")
        .join(fits, [*_family(keys), "origin"], "left")
    )
    x = [F.col(f"_x.{n}") for n in REGRESSORS]
    value = pooled.predicted(x, F.col("slopes"), F.col("means"))
    return found.withColumn("linear", value).drop("_x", "slopes", "means")


def forecast(
    hourly: DataFrame,
    origins: DataFrame,
    models: Sequence[str] = ("seasonal_naive",),
    lookback: int = 168,
    horizon: int = 24,
    min_history: int | None = None,
    known_routes: DataFrame | None = None,
    season: int = 24,
    fill_first: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Hourly forecasts of several models for every origin.

    Sequence models need ``min_history`` non-empty hours in the look-back window, all of them by
    default, and a route among ``known_routes`` when that is given. Fitted models need a fit.
    Otherwise the row carries the history's mean and ``model_used`` is ``baseline``. Values are
    never negative.
    """
    keys = list(keys)
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    at_origin = [*keys, "origin"]
    asked = origins.select(*at_origin).distinct()
    plan = asked.join(history_stats(hourly, asked, lookback, keys), at_origin, "left")
    seasons = {m: s for m, s in {"ar1": 0, "sar1": season}.items() if m in models}
    if seasons:
        fits = fit_ar(hourly, asked, seasons, fill_first, keys=keys)
        plan = plan.join(
            fits.withColumnsRenamed({m: f"_{m}" for m in seasons}), at_origin, "left"
        )
    if known_routes is not None:
        known = known_routes.select(*keys).distinct().withColumn("_known", F.lit(True))
        plan = plan.join(known, keys, "left")
    rows = forecast_hours(plan, horizon)
    for name in models:
        if name in LAGS:
            if LAGS[name] < horizon:
                raise ValueError(f"{name} cannot see {horizon} hours ahead")
            rows = rows.join(lagged(hourly, LAGS[name], name, keys), [*keys, "DateTime"], "left")
        elif name == "profile":
            if horizon > 168:
                raise ValueError("profile forecasts at most a week")
            targets = forecast_hours(asked, horizon)
            rows = rows.join(profile_means(hourly, targets, name, keys), [*keys, "DateTime"], "left")
        elif name == "ar1":
            rows = _with_ar(rows, name)
        elif name == "sar1":
            rows = _with_seasonal_ar(rows, hourly, name, season, keys)
        elif name == "linear":
            if horizon > LAGS["daily_naive"]:
                raise ValueError(f"linear cannot see {horizon} hours ahead")
            fitted = fit_linear(hourly, asked, lookback, min_history, keys)
            rows = _with_linear(rows, hourly, fitted, keys)
    enough = F.coalesce(F.col("n_history"), F.lit(0)) >= (
        lookback if min_history is None else min_history
    )
    if known_routes is not None:
        enough = enough & F.coalesce(F.col("_known"), F.lit(False))
    answers = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                (F.col(m) if m in FITTED else F.when(enough, F.col(m))).alias("value"),
            )
            for m in models
        ]
    )
    long = rows.withColumn("_a", F.explode(answers))
    answered = F.col("_a.value").isNotNull() & ~F.isnan("_a.value")
    fallback = F.coalesce(F.col("history_mean"), F.lit(0.0))
    return long.select(
        *keys,
        "origin",
        "DateTime",
        "step",
        F.col("_a.model").alias("model"),
        F.when(answered, F.greatest(F.col("_a.value"), F.lit(0.0)))
        .otherwise(fallback)
        .alias("PredictedVehicles"),
        F.when(answered, F.col("_a.model")).otherwise(F.lit(BASELINE)).alias("model_used"),
        F.coalesce("n_history", F.lit(0)).alias("n_history"),
    )


def forecast_day(
    hourly: DataFrame, day, model: str = "seasonal_naive", keys: Sequence[str] = KEYS, **options
) -> DataFrame:
    """All routes for one calendar day."""
    origins = hourly.select(*keys).distinct().withColumn("origin", cal.day_floor(cal.clock(day)))
    return forecast(hourly, origins, [model], keys=keys, **options)


def batch_forecast(
    obs: DataFrame, lookback: int = 168, horizon: int = 24, model: str = "seasonal_naive",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Every route on every day of the table, from the most recent ``lookback`` non-empty hours.

    Unlike ``forecast`` the history is a number of rows, however far back they reach. A route
    starts on its first day. Forecast hour h of the naive models is row h of the history's first,
    or last, day. Other models answer as in ``forecast``, where those rows exist.
    """
    keys = list(keys)
    if model not in MODELS:
        raise ValueError(f"unknown models {[model]}")
    offset = {"seasonal_naive": lookback, "daily_naive": 24}.get(model)
    hourly = resample.hourly_mean(obs, keys)
    if offset is None:
        hourly = stored(hourly, "hourly")
    days = obs.select(F.to_date("DateTime").alias("_day")).distinct()
    last_day = days.agg(F.max("_day").alias("_last")).scalar()
    first_days = obs.groupBy(*keys).agg(F.to_date(F.min("DateTime")).alias("_first"))
    origins = (
        first_days.withColumn("_day", F.explode(F.sequence("_first", last_day)))
        .join(days, "_day", "left_semi")
        .select(*keys, F.col("_day").cast("timestamp_ntz").alias("DateTime"), F.lit(0).alias("_side"))
    )
    w = Window.partitionBy(*keys).orderBy("DateTime")
    placed = hourly.withColumn("_pos", F.row_number().over(w)).withColumn(
        "_mean", F.avg("Vehicles").over(w.rowsBetween(1 - lookback, 0))
    )
    state = F.struct("_pos", "_mean")
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("DateTime", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    asked = (
        placed.select(*keys, "DateTime", state.alias("_s"), F.lit(1).alias("_side"))
        .unionByName(origins, allowMissingColumns=True)
        .repartition(*keys)
        .withColumn("_s", F.last("_s", ignorenulls=True).over(so_far))
        .where(F.col("_side") == 0)
        .select(
            *keys,
            F.col("DateTime").alias("origin"),
            F.coalesce(F.col("_s._pos"), F.lit(0)).alias("_seen"),
            F.col("_s._mean").alias("_mean"),
        )
    )
    if offset is None:
        asked = stored(asked, "origins")
        own = forecast(hourly, asked, [model], lookback, horizon, min_history=0, keys=keys)
        on = [*keys, "origin", "DateTime"]
        values = own.where(F.col("model_used") == model).select(
            *on, F.col("PredictedVehicles").alias("_value")
        )
        rows = forecast_hours(asked, horizon)
    else:
        on = [*keys, "_pos"]
        values = placed.select(*on, F.col("Vehicles").alias("_value"))
        rows = forecast_hours(asked, horizon).withColumn(
            "_pos", F.col("_seen") - offset + F.col("step") + 1
        )
    answered = F.col("_value").isNotNull() & (F.col("_seen") >= lookback)
    return rows.join(values, on, "left").select(
        F.col("DateTime"),
        *keys,
        F.when(answered, F.greatest("_value", F.lit(0.0)))
        .otherwise(F.coalesce("_mean", F.lit(0.0)))
        .alias("PredictedVehicles"),
        F.to_date("origin").alias("BaseDate"),
        F.when(answered, F.lit(model)).otherwise(F.lit(BASELINE)).alias("ModelUsed"),
    )


def rollout(
    obs: DataFrame,
    model: str = "seasonal_naive",
    n_days: int = 7,
    lookback: int = 168,
    min_history: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Days after the last data day, each forecast from data and the earlier forecast days.

    A day is skipped, and the rollout stops, when fewer than ``lookback`` raw rows lie in its
    look-back window; with enough rows but fewer than ``min_history`` non-empty hours the mean
    answers. The feedback is a fold over one array of ``lookback`` hours per route.

    ``ar1`` and ``sar1`` are fitted once, on all history up to the last data day, and go on from the
    array's last value (for ``sar1``: its last difference to the day before), which after the first
    day is a forecast. A route without a stationary fit is answered by the mean.
    """
    keys = list(keys)
    if lookback % 24:
        raise ValueError("rollout needs a look-back of whole days")
    needed = lookback if min_history is None else min_history
    hourly = hourly_totals(obs, keys)
    if model == "profile" or model in ROLLOUT_SEASONS:
        hourly = stored(hourly, "hourly")
    last_day = F.to_date(F.max("DateTime").over(Window.partitionBy(*keys)))
    start = cal.plus_hours(F.date_add("anchor", 1).cast("timestamp_ntz"), -lookback)
    recent = (
        hourly.withColumn("anchor", last_day)
        .where(F.col("DateTime") >= start)
        .withColumn("_i", cal.hours_between(start, F.col("DateTime")))
    )
    cells = F.map_from_entries(F.collect_list(F.struct("_i", F.struct("Vehicles", "Rows"))))
    history = recent.groupBy(*keys, "anchor").agg(cells.alias("_cells"))
    hours = F.sequence(F.lit(0), F.lit(lookback - 1))

    def cell(field: str) -> Column:
        return F.transform(hours, lambda i: F.try_element_at(F.col("_cells"), i)[field])

    history = history.withColumn("_values", cell("Vehicles")).withColumn(
        "_rows", F.transform(cell("Rows"), lambda c: F.coalesce(c, F.lit(0)))
    )
    if model == "profile":
        means = hourly.groupBy(
            *keys, (F.weekday("DateTime") * 24 + F.hour("DateTime")).alias("_i")
        ).agg(F.avg("Vehicles").alias("_m"))
        table = means.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("_i", "_m"))).alias("_profile")
        )
        history = history.join(table, keys)
    elif model in ROLLOUT_SEASONS:
        known = hourly.where("Vehicles IS NOT NULL").select(*keys, "DateTime", "Vehicles")
        after = F.date_add(F.to_date(F.max("DateTime")), 1).cast("timestamp_ntz")
        ends = hourly.groupBy(*keys).agg(after.alias("origin"))
        fits = fit_ar(known, ends, {model: ROLLOUT_SEASONS[model]}, keys=keys)
        history = history.join(fits.select(*keys, F.col(model).alias("_fit")), keys, "left")
    elif model not in LAGS:
        raise ValueError(f"no rollout for {model!r}")

    def recurrence(values: Column, h: Column) -> Column:
        """The fitted recurrence from the last complete level of the array to hour ``h`` after it."""
        season = ROLLOUT_SEASONS[model]

        def level(i: Column) -> Column:
            return F.get(values, i) - F.get(values, i - season) if season else F.get(values, i)

        places = F.sequence(F.lit(season), F.lit(lookback - 1))
        last = F.array_max(F.transform(places, lambda i: F.when(level(i).isNotNull(), i)))
        step = ar_step(F.col("_fit.phi"), F.col("_fit.mu"), level(last), F.lit(lookback) + h - last)
        return F.get(values, F.lit(lookback - season) + h) + step if season else step

    def answer(values: Column, h: Column, k: Column) -> Column:
        if model in ROLLOUT_SEASONS:
            return recurrence(values, h)
        if model == "profile":
            weekday = F.pmod(F.weekday("anchor") + k, F.lit(7))
            return F.try_element_at(F.col("_profile"), weekday * 24 + h)
        return F.get(values, F.lit(lookback - LAGS[model]) + h)

    def day(state: Column, k: Column) -> Column:
        values, rows = state["values"], state["rows"]
        present = F.filter(values, lambda v: v.isNotNull())
        mean = F.aggregate(present, F.lit(0.0), lambda a, v: a + v) / F.greatest(
            F.size(present), F.lit(1)
        )
        goes_on = state["running"] & (
            F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, c: a + c) >= lookback
        )
        by_model = F.size(present) >= needed
        predicted = F.transform(
            F.sequence(F.lit(0), F.lit(23)),
            lambda h: F.struct(
                F.greatest(
                    F.coalesce(F.when(by_model, answer(values, h, k)), mean), F.lit(0.0)
                ).alias("value"),
                (by_model & answer(values, h, k).isNotNull()).alias("by_model"),
            ),
        )
        new_values = F.transform(predicted, lambda p: p["value"])
        ones = F.array_repeat(F.lit(1).cast("bigint"), 24)
        moved = F.struct(
            F.slice(F.concat(values, new_values), 25, lookback).alias("values"),
            F.slice(F.concat(rows, ones), 25, lookback).alias("rows"),
            F.concat(state["days"], F.array(predicted)).alias("days"),
            F.lit(True).alias("running"),
        )
        stopped = F.struct(
            values.alias("values"), rows.alias("rows"), state["days"].alias("days"),
            F.lit(False).alias("running"),
        )
        return F.when(goes_on, moved).otherwise(stopped)

    start_state = F.struct(
        F.col("_values").alias("values"),
        F.col("_rows").alias("rows"),
        F.array().cast("array<array<struct<value: double, by_model: boolean>>>").alias("days"),
        F.lit(True).alias("running"),
    )
    days = F.aggregate(
        F.sequence(F.lit(1), F.lit(n_days)), start_state, day, lambda state: state["days"]
    )
    return (
        history.select(*keys, "anchor", days.alias("_days"))
        .select(*keys, "anchor", F.posexplode("_days").alias("_d", "_hours"))
        .select(*keys, "anchor", "_d", F.posexplode("_hours").alias("_h", "_p"))
        .select(
            *keys,
            "anchor",
            cal.plus_hours(
                F.date_add("anchor", F.col("_d") + 1).cast("timestamp_ntz"), F.col("_h")
            ).alias("DateTime"),
            F.lit(model).alias("model"),
            F.col("_p.value").alias("PredictedVehicles"),
            F.when(F.col("_p.by_model"), model).otherwise(BASELINE).alias("model_used"),
        )
    )


def mean_of_present(columns: Sequence[str]) -> Column:
    """Row mean of the columns that are neither null nor NaN."""
    values = F.filter(
        F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull() & ~F.isnan(v)
    )
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.try_divide(total, F.nullif(F.size(values), F.lit(0)))


def ensemble(
    forecasts: DataFrame,
    models: Sequence[str],
    pair: tuple[str, str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean of the models on the hours all of them forecast, and optionally of one pair."""
    wide = joins.models_side_by_side(forecasts, models, keys)
    wide = wide.withColumn("Pred_ENSEMBLE", mean_of_present([f"Pred_{m}" for m in models]))
    if pair and set(pair) <= set(models):
        wide = wide.withColumn("Pred_PAIR_AVG", mean_of_present([f"Pred_{m}" for m in pair]))
    return wide.withColumn("PredictedVehicles", F.col("Pred_ENSEMBLE"))


def week_ahead(
    obs: DataFrame,
    today,
    now,
    models: Sequence[str] = ("seasonal_naive", "daily_naive"),
    n_days: int = 8,
    min_history: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Ensemble rollout moved onto the week from ``today``, past hours dropped, hours merged."""
    parts = union_all([rollout(obs, m, n_days, min_history=min_history, keys=keys) for m in models])
    merged = ensemble(parts, models, keys=keys)
    shifted = merged.withColumn("DateTime", cal.shift_to_week_of("DateTime", today))
    values = [c for c in merged.columns if c.startswith("Pred")]
    return rollups.collapse_hours(drop_past(shifted, now), values, keys)


def daily_actual_vs_models(
    obs: DataFrame,
    models: Sequence[str] = MODELS,
    days_back: int = 30,
    min_history: int | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Daily totals of the last days next to each model's, one column per model.

    A day without any history before it has no forecast. Actuals add up raw rows, forecasts
    hourly means.
    """
    hourly = stored(hourly_totals(obs, keys), "hourly")
    daily = hourly.groupBy(*keys, F.to_date("DateTime").alias("Date")).agg(
        F.sum("Total").alias("DailyActual")
    )
    last = F.max("Date").over(Window.partitionBy(*keys))
    actual = daily.withColumn("_last", last).where(
        F.col("Date") >= F.date_sub("_last", days_back)
    ).drop("_last")
    origins = actual.select(*keys, F.col("Date").cast("timestamp_ntz").alias("origin"))
    predicted = forecast(hourly, origins, models, min_history=min_history, keys=keys)
    per_day = (
        predicted.where(F.col("n_history") > 0)
        .groupBy(*keys, F.to_date("origin").alias("Date"), "model")
        .agg(F.sum("PredictedVehicles").alias("DailyPred"))
    )
    return joins.daily_with_models(actual, per_day, models, keys)
