"""The observation table: parquet under City and Zone folders."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise import schemas
from lanewise.operators import filters

COLUMNS = ("DateTime", "RouteId", "Vehicles")

MICROS = {"s": "{0} * 1000000", "ms": "{0} * 1000", "us": "{0}", "ns": "{0} div 1000"}


def _schema(found: T.StructType | None, declared: T.StructType) -> T.StructType:
    """The declared columns with the types that the files have; folder names stay text."""
    kinds = {f.name: f.dataType for f in found or []}
    return T.StructType([
        T.StructField(f.name, f.dataType if f.name in ("City", "Zone") else kinds.get(f.name, f.dataType))
        for f in declared
    ])


def _typed(rows: DataFrame, unit: str | None = None) -> DataFrame:
    """Counts as doubles, routes as text, times as clock readings; whole numbers count ``unit``."""
    kinds = dict(rows.dtypes)
    out = {}
    if kinds["DateTime"] in ("bigint", "int"):
        seconds = f"CAST(CAST({MICROS[unit].format('CAST(DateTime AS bigint)')} AS decimal(18, 0)) * 0.000001BD AS decimal(18, 6))"
        out["DateTime"] = F.expr(f"TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})")
    elif kinds["DateTime"] != "timestamp_ntz":
        out["DateTime"] = F.expr("try_cast(DateTime AS timestamp_ntz)")
    if kinds["Vehicles"] != "double":
        out["Vehicles"] = F.expr("try_cast(Vehicles AS double)")
    if kinds["RouteId"] != "string":
        out["RouteId"] = F.col("RouteId").cast("string")
    return rows.withColumns(out) if out else rows


def _footer(path: str):
    """The Arrow schema of a file on an executor, or None in a store that only Spark opens."""
    from urllib.parse import quote

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    if path.startswith("file:"):
        return pq.read_schema("/" + path.removeprefix("file:").lstrip("/"))
    try:
        system, name = fs.FileSystem.from_uri(quote(path, safe="/:=@%"))
    except (pa.ArrowInvalid, OSError):
        return None
    return pq.read_schema(name, filesystem=system)


def describe_files(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``kinds`` and ``problem`` of every parquet file under ``root``.

    ``kinds`` are the types of DateTime, RouteId and Vehicles in the file's footer, which tasks
    read; it is null where the store is one that only Spark opens. ``problem`` says which columns
    are absent or why the footer cannot be read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(root).select("path")
    )

    def describe(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path in batch["path"]:
                kinds = problem = None
                try:
                    schema = _footer(path)
                except Exception as error:  # any damage of a file is that file's problem
                    problem = f"unreadable: {error}"
                else:
                    absent = [c for c in COLUMNS if schema is not None and c not in schema.names]
                    if absent:
                        problem = f"lacks {', '.join(absent)}"
                    elif schema is not None:
                        kinds = "|".join(str(schema.field(c).type) for c in COLUMNS)
                out.append((path, kinds, problem))
            yield pd.DataFrame(out, columns=["path", "kinds", "problem"], dtype=object)

    return files.mapInPandas(describe, "path string, kinds string, problem string")


def _asked_of_spark(spark: SparkSession, path: str) -> str:
    """The kinds of one file by Spark's own reader; it refuses nanoseconds unless told otherwise."""
    try:
        found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    except Exception as error:
        if "NANOS" not in str(error):
            raise
        return "timestamp[ns]||"
    return "|".join(found.get(c, "") for c in COLUMNS)


def read_observations(
    spark: SparkSession, root: str, layout: str = "hive", skip_broken: bool = False,
    time_unit: str | None = None, mixed_types: bool = True,
) -> DataFrame:
    """DateTime, RouteId, Vehicles, City, Zone of every file.

    ``layout="hive"`` expects ``City=.../Zone=...`` folders and prunes them from filters.
    ``layout="plain"`` expects ``<city>/<zone>/`` folders and takes the names from the path.
    Counts may be stored as integers, floats or text, routes as integers or text, times as clock
    readings, zoned times, text, nanoseconds or whole numbers since 1970 of ``time_unit`` (``s``,
    ``ms``, ``us``, ``ns``; an error when it is not said). Files of one root may differ: tasks read
    the footers, and files of equal types are one scan. A file without the required columns is left
    out with a warning that names it. A file that cannot be read is an error unless ``skip_broken``
    asks to leave it out. With ``mixed_types=False`` no footers are read first: all files must
    have the first one's types. Reading nanoseconds sets ``spark.sql.legacy.parquet.nanosAsLong``
    in the session, since Spark has no reader option for it.
    """
    if layout not in ("hive", "plain"):
        raise ValueError(f"unknown layout {layout!r}")
    groups: dict[str, list[str]] = {}
    try:
        files = describe_files(spark, root).collect() if mixed_types else []  # a row per file, as in Spark's own listing
    except AnalysisException:  # no such folder
        files = []
    broken = [f for f in files if f["problem"] and f["problem"].startswith("unreadable")]
    if broken and not skip_broken:
        raise ValueError(f"{len(broken)} files cannot be read, e.g. {broken[0]['path']}: {broken[0]['problem']}")
    left_out = [f for f in files if f["problem"]]
    if left_out:
        warnings.warn("left out: " + "; ".join(f"{f['path']} {f['problem']}" for f in left_out), stacklevel=2)
    for f in files:
        if not f["problem"]:
            groups.setdefault(f["kinds"] or _asked_of_spark(spark, f["path"]), []).append(f["path"])
    if any("ns" in kinds.split("|")[0] for kinds in groups):
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    whole = len(groups) < 2 and not left_out
    parts = []
    for kinds, paths in sorted(groups.items()) or [("", [])]:
        time_kind = kinds.split("|")[0]
        unit = "ns" if time_kind.startswith("timestamp[ns") else time_unit
        if time_kind in ("int64", "int32", "bigint", "int") and unit is None:
            raise ValueError(f"times are whole numbers in {len(paths)} files, e.g. {paths[0]}: say time_unit")
        rows = _scan(spark, root, [] if whole else paths, paths[:1], layout, skip_broken)
        parts.append(_typed(rows, unit))
    return reduce(DataFrame.unionByName, parts)


def _scan(spark, root: str, paths: list[str], one: list[str], layout: str, skip_broken: bool) -> DataFrame:
    """One scan of the paths, or of the whole root, with the types that the one file has."""
    reader = spark.read.option("ignoreCorruptFiles", str(skip_broken).lower())
    declared = schemas.OBSERVATION_PARTITIONED if layout == "hive" else schemas.OBSERVATION
    try:
        found = reader.parquet(*(one or [root])).schema
    except AnalysisException:  # no file to tell the types
        found = None
    if layout == "hive":
        return reader.schema(_schema(found, declared)).option("basePath", root).parquet(*(paths or [root]))
    if not paths:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    path = F.col("_metadata.file_path")
    parts = F.split(F.split_part(path, F.lit(f"{root.rstrip('/')}/"), F.lit(2)), "/")
    return reader.schema(_schema(found, declared)).parquet(*(paths or [root])).select(
        "*",
        F.get(parts, F.lit(0)).alias("City"),
        F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("Zone"),
    )


def load_slice(
    spark: SparkSession,
    root: str,
    city: str,
    zone: str | None = None,
    routes: Sequence[str] | None = None,
    start=None,
    end=None,
    layout: str = "hive",
    skip_broken: bool = False,
    time_unit: str | None = None,
) -> DataFrame:
    """Clean observations of a city, zone, routes and half-open time range.

    All four conditions are plain column predicates: the folders are pruned, and route and time
    reach the parquet scan. Sort the result with ``orderBy`` only where a reader needs it.
    """
    rows = filters.in_city_zone(read_observations(spark, root, layout, skip_broken, time_unit), city, zone)
    rows = filters.in_time_range(filters.on_routes(rows, routes), start, end)
    return filters.clean_observations(rows).select("DateTime", "RouteId", "Vehicles")


def load_all(
    spark: SparkSession, root: str, layout: str = "hive", skip_broken: bool = False, time_unit: str | None = None
) -> DataFrame:
    """Every partition, rows with all three columns only."""
    return filters.clean_observations(read_observations(spark, root, layout, skip_broken, time_unit))


def write_observations(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """Store observations under City and Zone.

    The rebalance hint lets adaptive execution split a zone that holds much of the data over
    several tasks and files, and merge small ones.
    """
    (
        df.select("DateTime", "RouteId", "Vehicles", "City", "Zone")
        .hint("rebalance", F.col("City"), F.col("Zone"))
        .write.mode(mode)
        .partitionBy("City", "Zone")
        .parquet(root)
    )
