"""Session settings, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "lanewise", **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` unset and let spark-submit decide it; sizes such as
    executor memory also belong there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: ``spark.checkpoint.dir``, else one in the warehouse.

    Both are places that a cluster's driver and executors share. Which one it is depends on the
    setting alone, never on the kind of master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lanewise-scratch"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lanewise-{label}-{uuid.uuid4().hex}"
    if spark._jvm is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        system.deleteOnExit(target)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used for a reduced table that a job reads more than once, so that the raw rows behind it are
    scanned once and a lost executor costs no recomputation of them. The files also give the
    planner the table's true size: it broadcasts the table only when it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles otherwise, and it decides that before
    it would start to shuffle the other, large side. The shuffle files behind the table are
    removed as soon as it is written; nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that no plan will read again; other tables stay."""
    for df in tables:
        path = df.__dict__.get("_stored_at")
        if path is not None and df.sparkSession._jvm is not None:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target.getFileSystem(conf).delete(target, True)
