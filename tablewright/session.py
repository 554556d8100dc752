"""Spark session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine expects; extra settings use '_' for '.'.

    ANSI mode stays on: every cast of cell values in this package is a ``try_cast``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.caseSensitive": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # The JVM does not compile a method above 8000 bytes; beyond that Spark then generates
        # smaller methods per operator. No effect was measured yet on the queries tried.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Recording the Python call site of every column function slows down wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("_", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the warehouse folder.

    Both are places the cluster itself names; a machine-local temporary folder would lose the data
    together with its executor.
    """
    for key in (CHECKPOINT_DIR, "spark.sql.warehouse.dir"):
        folder = spark.conf.get(key, None)
        if folder:
            return folder
    raise ValueError(f"set {CHECKPOINT_DIR} to a shared folder before staging tables")


def new_path(spark: SparkSession, label: str) -> str:
    """Fresh path below the shared folder; never an existing one."""
    return f"{shared_dir(spark).rstrip('/')}/tablewright/{label}-{uuid.uuid4().hex}"
