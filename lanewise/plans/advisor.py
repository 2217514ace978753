"""Departure advice from the congestion history of a street."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators import congestion

# The two windows of the day that can be asked about.
WINDOWS = {"morning": (6, 9), "evening": (16, 19)}


def departure_advice(
    slots: DataFrame, today_weekday: int, window: str = "morning", keys: Sequence[str] = ("street_name",)
) -> DataFrame:
    """Slots to prefer, slots to avoid and the mean congestion of a window, per street."""
    start, end = WINDOWS[window]
    keys = list(keys)
    offered = congestion.window_slots(
        congestion.slot_means(slots, today_weekday, keys), start, end, keys
    )

    def labels(chosen: DataFrame, name: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("rank", "TimeLabel")))
        return chosen.groupBy(*keys).agg(F.transform(ordered, lambda s: s["TimeLabel"]).alias(name))

    none = F.array().cast("array<string>")
    average = offered.groupBy(*keys).agg(F.avg("CongestionPct").alias("mean_pct"))
    return (
        average.join(labels(congestion.best_slots(offered, keys), "best"), keys, "left")
        .join(labels(congestion.worst_slots(offered, keys), "worst"), keys, "left")
        .withColumns({"best": F.coalesce("best", none), "worst": F.coalesce("worst", none)})
    )
