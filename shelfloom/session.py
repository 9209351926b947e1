"""Session settings that the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("shelfloom")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | more).getOrCreate()
