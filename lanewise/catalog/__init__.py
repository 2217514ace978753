"""The registered queries: one per operator, each over whole test tables."""

from lanewise.catalog import (  # noqa: F401
    filter_queries,
    forecast_queries,
    metric_queries,
    rollup_queries,
    source_queries,
    street_queries,
    window_queries,
)
from lanewise.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
