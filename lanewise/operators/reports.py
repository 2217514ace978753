"""Summaries of a two-hour congestion forecast and of travel times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import travel


def next_hours_summary(
    forecast: DataFrame, keys: Sequence[str], p: str = "p", label: str = "TimeLabel",
    minutes: int = 30,
) -> DataFrame:
    """Expected congested minutes, mean probability, and the slots to avoid or prefer.

    A street has one row per forecast slot, four of them, so the lists are short.
    """
    prob = F.col(p)
    chance = travel.clipped(p)

    def slots(condition):
        kept = F.collect_list(F.when(condition, F.struct("DateTime", label)))
        return F.transform(F.array_sort(kept), lambda s: s[label])

    return forecast.groupBy(*keys).agg(
        (F.sum(chance) * float(minutes)).alias("expected_congested_minutes"),
        F.avg(chance).alias("mean_probability"),
        slots(prob >= 0.7).alias("avoid_slots"),
        slots(prob <= 0.3).alias("good_slots"),
        F.count(F.lit(1)).alias("n_slots"),
    )


def travel_table(
    slots: DataFrame, keys: Sequence[str], p: str = "p", slug: str = "slug",
    lengths: dict[str, float] | None = None,
) -> DataFrame:
    """Travel time, delay and level per slot, one decimal."""
    timed = travel.with_travel_time(slots, p, slug, lengths)
    return timed.select(
        *keys,
        F.col("TimeLabel").alias("slot"),
        F.bround(F.col(p) * 100.0, 1).alias("p_pct"),
        F.bround("travel_minutes", 1).alias("travel_minutes"),
        F.bround("delay_minutes", 1).alias("delay_minutes"),
        "slowdown",
        "free_minutes",
        "length_km",
    )


def travel_summary(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and worst travel time, and the first slot that is worst."""
    t = F.col("travel_minutes")
    return table.groupBy(*keys).agg(
        F.avg(t).alias("mean_minutes"),
        F.max(t).alias("worst_minutes"),
        F.min_by("slot", F.struct(-t, "slot")).alias("worst_slot"),
        F.max("free_minutes").alias("free_minutes"),
        F.max("length_km").alias("length_km"),
    )
