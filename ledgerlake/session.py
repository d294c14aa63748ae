"""Session settings shared by the bench, the tests and ad-hoc use."""

from pyspark.sql import SparkSession


def build_session(app: str = "ledgerlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC dates and skew handling on.

    On a cluster leave ``master`` and the shuffle width to the submit settings; adaptive
    execution coalesces the partitions that turn out small.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
