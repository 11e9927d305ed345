"""Sessions with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Of keys that an object repeats the last one counts; without this such a document is malformed.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: For sessions that are made here; these can't be changed later. A column operation would look up the line that it stands on, for messages of errors: a second for a batch's rules.
AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings on a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidelog")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **AT_START, **more}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
