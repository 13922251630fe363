"""Session factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", app: str = "flickerlake", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on; keyword settings use ``__`` for dots."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
