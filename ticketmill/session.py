"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "ticketmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; ``conf`` overrides any of them.

    Reports do their calendar work on TIMESTAMP_NTZ and do not depend on the
    session zone; UTC keeps user-written casts between the two types shift-free.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/ticketmill/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, path: str) -> DataFrame:
    """The rows written once and read back by column, for plans that read them more than once."""
    schema = rows.schema
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)
