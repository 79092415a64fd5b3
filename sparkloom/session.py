"""A session with the settings that the library expects."""

from pathlib import Path

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "sparkloom", **settings) -> SparkSession:
    """Double underscores in the names of settings stand for dots.

    Workers on this machine find the package wherever they are started; on other machines it must be installed, or sent along
    with --py-files.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.executorEnv.PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    return builder.config(map=defaults | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
