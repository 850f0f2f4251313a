"""Session helper for tests, the bench and local use."""

from __future__ import annotations

import os

import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Enough where workers see the driver's folders; elsewhere the package is to
    be installed or passed by --py-files, as any other.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def materialised(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, for what is used several times; a local master may do without a named one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-ckpt-"))
    return df.checkpoint(eager=True)


def local_session(cores: int | str = 8, app: str = "lectern", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for.

    On a cluster the caller brings a session of its own; no operator depends
    on what is set here, apart from the time zone being UTC.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("LECTERN_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "4g"))
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
