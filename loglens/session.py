"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_spark(app: str = "loglens", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session; on a cluster the submitter's master and sizes are kept."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Time keys are UTC text, so every plan runs in a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def for_workers(rows: DataFrame) -> DataFrame:
    """Rows for a function of this package: Python workers import it from where the driver has it.

    Without this they find it only where the session was started in its folder or with it on
    PYTHONPATH. A path that the session names for its executors is kept."""
    rows.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return rows


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one the session names.

    Only a local session that names none falls back to a temporary folder:
    on a cluster the executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="loglens-")
    return f"{base.rstrip('/')}/loglens/{name}-{uuid.uuid4().hex}"


def store_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared folder and read it back.

    For an intermediate result that several branches of one plan read: it is
    computed once, and a lost executor does not send the work back to the log.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
