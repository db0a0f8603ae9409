"""The session every entry point shares."""

from pyspark.sql import SparkSession


def build_session(name: str = "sessionlens", master: str | None = None) -> SparkSession:
    """UTC, adaptive execution with skew handling; the cluster's own settings otherwise."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
