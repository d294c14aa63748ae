"""Writing report results."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.functions.workspace import removed


def write_report(report: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """A report as files, optionally one folder per key value (K1)."""
    writer = report.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_report(report: DataFrame, name: str, path: str | None = None) -> None:
    """A report under a name for later browsing, replacing the last one (K2).

    Every run writes a table of its own (below ``path``, or in the warehouse) and then turns the view ``name`` to it in one step; older tables are
    dropped afterwards. A run that fails leaves the report as it was and no table behind.
    """
    spark = report.sparkSession
    space, _, plain = name.rpartition(".")
    prefix = f"{space}." if space else ""
    version = f"{plain}__{uuid.uuid4().hex[:12]}"
    writer = report.write.option("path", f"{path}/{version}") if path else report.write
    try:
        writer.saveAsTable(prefix + version)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {prefix}{version}")
    except Exception:
        _dropped(spark, prefix, version, path)
        raise
    for table in spark.catalog.listTables(space or None, f"{plain}__*"):
        if table.name != version:
            _dropped(spark, prefix, table.name, path)


def _dropped(spark: SparkSession, prefix: str, version: str, path: str | None) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {prefix}{version}")
    if path:
        removed(spark, f"{path}/{version}")
