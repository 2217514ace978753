"""Congestion level and travel time from a congestion probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.calendar import col

# Street lengths in km, and the speed model.
STREET_LENGTH_KM = {
    "ly_thuong_kiet": 4.3,
    "nguyen_kiem": 3.8,
    "quang_trung": 5.6,
    "nguyen_dinh_chieu": 3.2,
    "le_duc_tho": 7.2,
    "quoc_lo_1a": 51.0,
    "to_hien_thanh": 2.1,
    "truong_chinh": 8.5,
}
DEFAULT_LENGTH_KM = 4.0
FREE_FLOW_KMH = 40.0
MIN_SPEED_KMH = 5.0


def congestion_level(p: Column | str) -> Column:
    """Slot label: high from 0.7, medium from 0.4."""
    p = col(p)
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def street_length_km(slug: Column | str, lengths: dict[str, float] | None = None) -> Column:
    """Length of a street, with the default for unknown ones."""
    table = STREET_LENGTH_KM if lengths is None else lengths
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(slug)), F.lit(DEFAULT_LENGTH_KM))


def clipped(p: Column | str) -> Column:
    return F.greatest(F.least(col(p), F.lit(1.0)), F.lit(0.0))


def slowdown_level(p: Column | str) -> Column:
    """Travel-time label: low up to 0.3, medium up to 0.7, else high."""
    p = clipped(p)
    return F.when(p <= 0.3, "low").when(p <= 0.7, "medium").otherwise("high")


def free_flow_minutes(length_km: Column | str, speed: float = FREE_FLOW_KMH) -> Column:
    return F.lit(60.0) * col(length_km) / F.lit(max(speed, 1e-6))


def travel_minutes(
    p: Column | str, length_km: Column | str, speed: float = FREE_FLOW_KMH
) -> Column:
    """Minutes to drive the street at the speed its congestion probability allows."""
    p = clipped(p)
    factor = F.when(p <= 0.3, 0.9).when(p <= 0.7, 0.6).otherwise(0.3)
    return F.lit(60.0) * col(length_km) / F.greatest(factor * speed, F.lit(MIN_SPEED_KMH))


def with_travel_time(
    df: DataFrame, p: str = "p", slug: str = "slug", lengths: dict[str, float] | None = None
) -> DataFrame:
    """Add length, free-flow time, travel time, delay and slowdown level."""
    return (
        df.withColumn("length_km", street_length_km(slug, lengths))
        .withColumn("free_minutes", free_flow_minutes("length_km"))
        .withColumn("travel_minutes", travel_minutes(p, "length_km"))
        .withColumn("delay_minutes", F.col("travel_minutes") - F.col("free_minutes"))
        .withColumn("slowdown", slowdown_level(p))
    )
