"""Street congestion in half-hour slots, from level-of-service letters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions import calendar as cal
from lanewise.functions import slugs

CONGESTED = ("D", "E", "F")


def with_slot_time(los: DataFrame) -> DataFrame:
    """Add DateTime from ``date`` and ``period_<h>_<m>``; rows that do not parse are dropped."""
    timed = los.withColumn("DateTime", cal.period_timestamp("date", "period"))
    return timed.where(F.col("DateTime").isNotNull())


def is_congested_letter(los: Column | str = "LOS") -> Column:
    """Whether a letter is D, E or F. A missing letter counts as not congested."""
    return F.coalesce(cal.col(los).isin(*CONGESTED), F.lit(False))


def is_congested_row(los: Column | str = "LOS") -> Column:
    """Row-level flag for letters of either case, or for numeric grades from 4 on."""
    c = cal.col(los)
    grade = c.try_cast("double")
    letter = F.upper(c.cast("string")).isin(*CONGESTED)
    return F.coalesce(F.when(grade.isNotNull(), grade >= 4).otherwise(letter), F.lit(False)).cast(
        "double"
    )


def congested_slots(
    los: DataFrame, keys: Sequence[str] = ("street_name",), slug_of: str | None = None
) -> DataFrame:
    """1 for a slot in which at least half of the rows are congested, else 0.

    Input without DateTime is first added up by its own date and period texts, so that times are
    parsed once per slot and not once per row. ``slug_of`` names a column to replace by its slug,
    which merges streets that share one; that too is done on the sums.

    The share is a pair of sums, so it combines map-side however many rows a street has. A
    street then has at most 48 slots a day.
    """
    keys = [slug_of] if slug_of else list(keys)
    hits, rows = F.sum(is_congested_letter().cast("long")), F.count(F.lit(1))
    time = ["DateTime"] if "DateTime" in los.columns else ["date", "period"]
    sums = los.groupBy(*keys, *time).agg(hits.alias("_hits"), rows.alias("_rows"))
    if time != ["DateTime"]:
        sums = with_slot_time(sums)
    if slug_of:
        sums, keys = sums.withColumn("slug", slugs.slug(slug_of)), ["slug"]
    share = F.sum("_hits") / F.sum("_rows")
    return sums.groupBy(*keys, "DateTime").agg((share >= 0.5).cast("int").alias("is_congested"))


def class_balance(slots: DataFrame, keys: Sequence[str] = ("street_name",)) -> DataFrame:
    """Slots per class and their shares."""
    flag = F.col("is_congested")
    return slots.groupBy(*keys).agg(
        F.count(flag).alias("timesteps"),
        F.count_if(flag == 1).alias("n_congested"),
        F.count_if(flag == 0).alias("n_free"),
        F.avg((flag == 1).cast("double")).alias("ratio_congested"),
        F.avg((flag == 0).cast("double")).alias("ratio_free"),
    )


def eligible_streets(
    slots: DataFrame,
    keys: Sequence[str] = ("street_name",),
    min_timesteps: int = 80,
    min_share: float = 0.05,
) -> DataFrame:
    """Streets with enough slots of both classes, most slots first."""
    return (
        class_balance(slots, keys)
        .where(
            (F.col("timesteps") >= min_timesteps)
            & (F.col("ratio_congested") >= min_share)
            & (F.col("ratio_free") >= min_share)
        )
        .orderBy(F.col("timesteps").desc(), *keys)
    )


def weekly_pattern(slots: DataFrame, keys: Sequence[str] = ("street_name",)) -> DataFrame:
    """Congestion percent by weekday (7 rows per street) and hour (columns 00:00 to 23:00)."""
    hours = [f"{h:02d}:00" for h in range(24)]
    pct = F.bround(F.avg("is_congested") * 100.0, 1)
    cells = slots.groupBy(
        *keys,
        F.weekday("DateTime").alias("weekday"),
        cal.time_label(F.hour("DateTime"), F.lit(0)).alias("HourStr"),
    ).agg(pct.alias("pct"))
    wide = cells.groupBy(*keys, "weekday").pivot("HourStr", hours).agg(F.first("pct"))
    # At most seven rows per street are gathered, to add the weekdays it lacks.
    by_day = wide.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("weekday", F.struct(*[F.col(f"`{h}`") for h in hours])))
        ).alias("_days")
    )
    names = F.array(*[F.lit(n) for n in cal.WEEKDAY_NAMES])
    day = F.try_element_at("_days", F.col("weekday"))
    return by_day.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6)))).select(
        *keys,
        "weekday",
        F.element_at(names, F.col("weekday") + 1).alias("weekday_label"),
        *[day[h].alias(h) for h in hours],
    )


def slot_means(
    slots: DataFrame,
    today_weekday: int,
    keys: Sequence[str] = ("street_name",),
    min_samples: int = 5,
) -> DataFrame:
    """Mean congestion per slot of day: today's weekday when it has enough samples, else all."""
    flag = F.col("is_congested").cast("double")
    today = F.when(F.weekday("DateTime") == today_weekday, flag)
    return slots.groupBy(
        *keys, F.hour("DateTime").alias("hour"), F.minute("DateTime").alias("minute")
    ).agg(
        F.when(F.count(today) >= min_samples, F.avg(today))
        .otherwise(F.avg(flag))
        .alias("MeanCongestion")
    )


def window_slots(
    means: DataFrame, start_hour: int, end_hour: int, keys: Sequence[str] = ("street_name",)
) -> DataFrame:
    """Slot means on the half hours of a window. A slot never seen has no mean and no row."""
    in_window = (F.col("hour") >= start_hour) & (F.col("hour") < end_hour)
    return (
        means.where(in_window & F.col("minute").isin(0, 30))
        .withColumn("TimeLabel", cal.time_label("hour", "minute"))
        .withColumn("CongestionPct", F.bround(F.col("MeanCongestion") * 100.0, 1))
    )


def _extreme_slots(
    slots: DataFrame, keys: Sequence[str], passes: Column, score: Column, allowed: Column
) -> DataFrame:
    """All slots that pass, or the two with the smallest score when none does."""
    group = Window.partitionBy(*keys)
    ranked = (
        slots.withColumn("_pass", passes)
        .withColumn("_any", F.max("_pass").over(group))
        .withColumn("_max", F.max("CongestionPct").over(group))
        .withColumn("rank", F.row_number().over(group.orderBy(score, "TimeLabel")))
    )
    keep = F.when(F.col("_any"), F.col("_pass")).otherwise((F.col("rank") <= 2) & allowed)
    return ranked.where(keep).drop("_pass", "_any", "_max")


def best_slots(
    slots: DataFrame, keys: Sequence[str] = ("street_name",), good: float = 30.0
) -> DataFrame:
    """Slots at most ``good`` percent congested, else the two least congested."""
    pct = F.col("CongestionPct")
    return _extreme_slots(slots, keys, pct <= good, pct, F.lit(True))


def worst_slots(
    slots: DataFrame, keys: Sequence[str] = ("street_name",), bad: float = 70.0
) -> DataFrame:
    """Slots at least ``bad`` percent congested, else the two worst unless all are at 0."""
    pct = F.col("CongestionPct")
    return _extreme_slots(slots, keys, pct >= bad, -pct, F.col("_max") > 0)


def street_centroids(los: DataFrame, keys: Sequence[str] = ("street_name",)) -> DataFrame:
    """Midpoint of the mean start node and the mean end node."""
    return los.groupBy(*keys).agg(
        ((F.avg("lat_snode") + F.avg("lat_enode")) / 2.0).alias("lat"),
        ((F.avg("long_snode") + F.avg("long_enode")) / 2.0).alias("lon"),
    )


def route_geo(los: DataFrame, metrics: DataFrame, city: str, zone: str, min_f1=0.0) -> DataFrame:
    """Map entries of trained streets, placed at their centroid."""
    from lanewise.operators.filters import trained_routes

    trained = trained_routes(metrics, min_f1).select("street_name", "slug")
    return trained.join(street_centroids(los), "street_name").select(
        F.lit(city).alias("city"),
        F.lit(zone).alias("zone"),
        F.col("slug").alias("route_id"),
        F.concat("street_name", F.lit(" (HCMC)")).alias("name"),
        "lat",
        "lon",
    )


def bounding_box(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Extent of the points whose coordinates are both finite numbers."""

    def finite(c: str) -> Column:
        v = F.col(c).try_cast("double")
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)

    return points.where(finite(lat) & finite(lon)).agg(
        F.min(F.col(lat).cast("double")).alias("min_lat"),
        F.max(F.col(lat).cast("double")).alias("max_lat"),
        F.min(F.col(lon).cast("double")).alias("min_lon"),
        F.max(F.col(lon).cast("double")).alias("max_lon"),
    )
