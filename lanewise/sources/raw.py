"""Raw feeds: the interstate counter, the wide bridge counter, street level of service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schemas
from lanewise.functions import calendar as cal
from lanewise.operators import congestion, filters, resample

# The interstate route and the bridge counter's columns with their routes.
INTERSTATE_ROUTE = "I-94-WB"
BRIDGE_COLUMNS = {
    "Fremont Bridge Total": "Fremont-Total",
    "Fremont Bridge East Sidewalk": "Fremont-East",
    "Fremont Bridge West Sidewalk": "Fremont-West",
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, matched by header. Spark drops a byte-order mark itself."""
    return spark.read.option("header", "true").csv(path)


def read_interstate(spark: SparkSession, path: str, route: str = INTERSTATE_ROUTE) -> DataFrame:
    """Observations of one route; extra columns are ignored, bad rows dropped."""
    raw = read_csv(spark, path).withColumnsRenamed(
        {"date_time": "DateTime", "traffic_volume": "Vehicles"}
    )
    missing = {"DateTime", "Vehicles"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    rows = raw.select("DateTime", "Vehicles", F.lit(route).alias("RouteId"))
    return filters.clean_observations(rows).select("DateTime", "RouteId", "Vehicles")


def read_interstate_hourly(
    spark: SparkSession, path: str, route: str = INTERSTATE_ROUTE
) -> DataFrame:
    """Hourly means on a complete grid, gaps filled for at most three hours."""
    hourly = resample.hourly_mean(read_interstate(spark, path, route))
    return resample.fill_hourly(hourly, "limit3")


def wide_to_observations(
    wide: DataFrame, columns: dict[str, str], time: str = "Date"
) -> DataFrame:
    """Wide counts to one series per column; columns that are absent are skipped."""
    present = [c for c in columns if c in wide.columns]
    counts = wide.select(time, *[F.col(f"`{c}`").cast("string").alias(columns[c]) for c in present])
    long = counts.unpivot([time], [columns[c] for c in present], "RouteId", "Vehicles")
    rows = long.select(F.col(time).alias("DateTime"), "RouteId", "Vehicles")
    return filters.clean_observations(rows).select("DateTime", "RouteId", "Vehicles")


def read_bridge(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None
) -> DataFrame:
    return wide_to_observations(read_csv(spark, path), columns or BRIDGE_COLUMNS)


def read_level_of_service(spark: SparkSession, path: str, slot_time: bool = True) -> DataFrame:
    """Street rows with their slot time. A file without the needed columns is an error.

    ``congested_slots`` parses times itself, once per slot; read without them for it.
    """
    raw = read_csv(spark, path)
    missing = {"date", "period", "street_name", "LOS"} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    numbers = [
        c for c in ("lat_snode", "long_snode", "lat_enode", "long_enode") if c in raw.columns
    ]
    typed = raw.withColumns({c: cal.number(c) for c in numbers})
    return congestion.with_slot_time(typed) if slot_time else typed


def read_level_of_service_declared(spark: SparkSession, path: str) -> DataFrame:
    """The same with the declared schema, for files known to have its column order."""
    raw = spark.read.option("header", "true").schema(schemas.LEVEL_OF_SERVICE_CSV).csv(path)
    return congestion.with_slot_time(raw)
