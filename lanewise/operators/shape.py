"""Unions, distinct values, and reshaping between long and wide."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a missing column is null.

    Repartition before grouping or windowing a union by keys its parts are already partitioned
    by: a union may report their common partitioning, which adaptive execution can then change
    in one part only.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sources_long(
    wide: DataFrame, prefix: str, time: str, keys: Sequence[str] = ("RouteId",)
) -> DataFrame:
    """``<prefix>Actual`` and ``<prefix>_<model>`` columns to (time, Source, value) rows.

    A model without any value is left out entirely, decided by a count per source.
    """
    actual = f"{prefix}Actual"
    names = {actual: "Actual"} | {
        c: c.removeprefix(f"{prefix}_") for c in wide.columns if c.startswith(f"{prefix}_")
    }
    value = f"{prefix}Value"
    renamed = wide.select(
        *keys, time, *[F.col(c).cast("double").alias(names[c]) for c in names]
    )
    long = renamed.unpivot([*keys, time], list(names.values()), "Source", value)
    present = long.where(F.col(value).isNotNull()).select(*keys, "Source").distinct()
    always = long.where(F.col("Source") == "Actual")
    models = long.where(F.col("Source") != "Actual").join(present, [*keys, "Source"], "left_semi")
    return always.unionByName(models)


def labels_wide(
    long: DataFrame, keys: Sequence[str], label: Column, labels: Sequence[str], value: Column
) -> DataFrame:
    """One row per key with a column per label; equal labels are averaged."""
    cells = long.select(*keys, label.alias("_label"), value.alias("_value"))
    return cells.groupBy(*keys).pivot("_label", list(labels)).agg(F.avg("_value"))
