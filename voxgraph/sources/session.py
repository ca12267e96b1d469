"""A Spark session with the settings the engine relies on."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

#: Settings unless the caller or the cluster says otherwise.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(name: str = "voxgraph", master: str | None = None, settings: Mapping[str, str] | None = None) -> SparkSession:
    """The session of that name; settings, as pairs of key and value, come before the defaults. Without master, the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | dict(settings or {})).items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()
