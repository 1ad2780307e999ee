"""Sessions with the settings that the operators expect."""

from pyspark.sql import SparkSession


def session(name: str = "graphloom", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
