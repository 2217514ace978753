"""Row filters and catalog lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.session import stored

ALL_ZONES = "(All)"


def clean_observations(df: DataFrame, ts: str = "DateTime", value: str = "Vehicles") -> DataFrame:
    """Cast time and count, then drop rows where either, or the route, is missing.

    Text times are read as UTC. A row never raises: what does not parse is dropped.
    """
    kind = dict(df.dtypes)[ts]
    if kind == "string":
        time = cal.parse_utc(ts)
    elif kind == "timestamp":
        time = cal.instant_to_utc(F.col(ts))
    else:
        time = F.col(ts).cast("timestamp_ntz")
    cleaned = df.withColumns({ts: time, value: cal.number(value)})
    if "RouteId" in df.columns:
        cleaned = cleaned.withColumn("RouteId", F.col("RouteId").cast("string"))
    return cleaned.dropna(subset=[c for c in (ts, value, "RouteId") if c in cleaned.columns])


def in_time_range(df: DataFrame, start=None, end=None, ts: str = "DateTime") -> DataFrame:
    """Rows with ``start <= ts < end``; a missing bound is open, a zoned bound becomes UTC."""
    if start is not None:
        df = df.where(F.col(ts) >= cal.clock(start))
    if end is not None:
        df = df.where(F.col(ts) < cal.clock(end))
    return df


def on_routes(df: DataFrame, routes: Sequence[str] | DataFrame | None) -> DataFrame:
    """Keep given routes. A list becomes a pushed-down IN, a table a semi join."""
    if routes is None:
        return df
    if isinstance(routes, DataFrame):
        wanted = stored(routes.select("RouteId").distinct(), "routes")
        return df.join(wanted, "RouteId", "left_semi")
    return df.where(F.col("RouteId").isin([str(r) for r in routes])) if routes else df


def in_city_zone(
    df: DataFrame, city: str, zone: str | None = None, city_col="City", zone_col="Zone"
) -> DataFrame:
    """Rows of a city and, unless the zone is missing or ``(All)``, of a zone."""
    df = df.where(F.col(city_col) == city)
    return df if zone in (None, "", ALL_ZONES) else df.where(F.col(zone_col) == zone)


def list_cities(df: DataFrame) -> DataFrame:
    return df.select("City").distinct().orderBy("City")


def list_zones(df: DataFrame, city: str) -> DataFrame:
    """``(All)`` first, then the zones of the city in order. Empty when the city is unknown."""
    zones = df.where(F.col("City") == city).select("Zone").distinct()
    entries = zones.select(F.explode(F.array(F.lit(ALL_ZONES), F.col("Zone"))).alias("Zone"))
    ranked = entries.distinct().withColumn("rank", (F.col("Zone") != ALL_ZONES).cast("int"))
    return ranked.orderBy("rank", "Zone")


def list_routes(df: DataFrame, city: str, zone: str | None = None) -> DataFrame:
    return in_city_zone(df, city, zone).select("RouteId").distinct().orderBy("RouteId")


def find_route(df: DataFrame, text: str, column: str = "route_id") -> DataFrame:
    """Route lookup that ignores case and outer spaces."""
    return df.where(F.lower(F.trim(F.col(column))) == text.strip().lower())


def trained_routes(metrics: DataFrame, min_f1: float = 0.0) -> DataFrame:
    """Streets with a trained model whose F1, or 0 when missing, reaches the floor."""
    return metrics.where(
        (F.col("status") == "trained") & (F.coalesce(F.col("f1"), F.lit(0.0)) >= min_f1)
    )


def keep_long_series(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Drop series with fewer than ``min_rows`` rows.

    Counting combines map-side and the semi join reads a table with one row per series,
    so a series that holds most rows is never gathered in one task.
    """
    keys = list(keys)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    long_enough = stored(counted.where(F.col("_rows") >= min_rows).select(*keys), "long-series")
    return df.join(long_enough, keys, "left_semi")


def training_status(
    df: DataFrame, keys: Sequence[str], lookback: int = 16, min_extra: int = 10,
    train_ratio: float = 0.8, min_test: int = 10,
) -> DataFrame:
    """Per series: row count, window counts and whether it can be trained."""
    n_windows = F.greatest(F.col("timesteps") - lookback, F.lit(0))
    n_train = F.floor(n_windows * F.lit(float(train_ratio))).cast("bigint")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("timesteps"))
    split = counted.withColumn("n_train", n_train).withColumn("n_test", n_windows - n_train)
    status = (
        F.when(F.col("timesteps") <= lookback + min_extra, "skipped_too_short")
        .when(F.col("n_test") < min_test, "skipped_small_test")
        .otherwise("trained")
    )
    return split.withColumn("status", status)


def _from_start(
    df: DataFrame, start: Column, keys: Sequence[str], ts: str
) -> DataFrame:
    """Rows from a start computed per series. The starts are one row per series.

    The least of them is a scalar subquery, which the scan receives as a value, so the second
    reading skips what lies before every series' start. No series has rows if none has a start.
    """
    starts = stored(df.groupBy(*keys).agg(start.alias("_start")), "starts")
    least = starts.agg(F.min("_start")).scalar()
    late = df.where(F.col(ts) >= least)
    return late.join(starts, list(keys)).where(F.col(ts) >= F.col("_start")).drop("_start")


def last_days(
    df: DataFrame, days: int, keys: Sequence[str] = ("RouteId",), ts: str = "DateTime"
) -> DataFrame:
    """Rows from ``days`` before each series' own last day on, which is ``days + 1`` dates."""
    start = F.date_sub(F.max(F.to_date(ts)), days).cast("timestamp_ntz")
    return _from_start(df, start, keys, ts)


def last_month(
    df: DataFrame, keys: Sequence[str] = ("RouteId",), ts: str = "DateTime"
) -> DataFrame:
    """Rows from one calendar month before each series' last time on, month end clamped."""
    start = F.max(ts) - F.make_ym_interval(months=F.lit(1))
    return _from_start(df, start, keys, ts)


def drop_past(df: DataFrame, now, ts: str = "DateTime") -> DataFrame:
    """Rows from the current hour on."""
    return df.where(F.col(ts) >= cal.hour_floor(cal.clock(now)))


def _family_candidates(city: Column, zone: Column) -> Column:
    """Family names to try, most specific first; the empty name is the shared root."""
    city, zone = F.trim(F.coalesce(city, F.lit(""))), F.trim(F.coalesce(zone, F.lit("")))
    special = (F.lower(city) == "minneapolis") | (F.upper(zone) == "I94")

    def underscored(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit("_"))

    named_zone = (zone != "") & (zone != ALL_ZONES)
    return F.array_compact(
        F.array(
            F.when(special, F.struct(F.lit(1).alias("priority"), F.lit("I94").alias("family"))),
            F.when(
                named_zone,
                F.struct(
                    F.lit(2).alias("priority"),
                    underscored(F.concat_ws("_", city, zone)).alias("family"),
                ),
            ),
            F.when(
                city != "", F.struct(F.lit(3).alias("priority"), underscored(city).alias("family"))
            ),
            F.struct(F.lit(4).alias("priority"), F.lit("").alias("family")),
        )
    )


def resolve_family(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The most specific registered model family for each (city, zone); null when none fits.

    ``registry`` has one row per complete family, column ``family``.
    """
    candidates = requests.select("city", "zone").distinct().withColumn(
        "c", F.explode(_family_candidates(F.col("city"), F.col("zone")))
    )
    matched = candidates.select("city", "zone", "c.priority", "c.family").join(
        registry.select("family").distinct().withColumn("known", F.lit(True)), "family", "left"
    )
    return matched.groupBy("city", "zone").agg(
        F.min_by("family", F.when(F.col("known"), F.col("priority"))).alias("family")
    )


def family_for_training(city: Column | str, zone: Column | str) -> Column:
    """The family a trainer writes to: the most specific candidate, ``default`` for no city."""
    first = F.element_at(_family_candidates(cal.col(city), cal.col(zone)), 1)["family"]
    return F.when(first == "", "default").otherwise(first)


def with_zone_fallback(requests: DataFrame, zones: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolve families; an ``(All)`` request without one uses the first zone that has one."""
    own = resolve_family(requests, registry)
    per_zone = resolve_family(zones.where(F.col("zone") != ALL_ZONES), registry).dropna(
        subset=["family"]
    )
    first = per_zone.groupBy("city").agg(
        F.min("zone").alias("first_zone"), F.min_by("family", "zone").alias("first_family")
    )
    fallback = (F.col("zone") == ALL_ZONES) & F.col("family").isNull()
    return own.join(first, "city", "left").select(
        "city",
        "zone",
        F.when(fallback, F.col("first_zone")).otherwise(F.col("zone")).alias("zone_used"),
        F.when(fallback, F.col("first_family")).otherwise(F.col("family")).alias("family"),
    )
