"""Where jobs put files that all executors must reach."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="ledgerlake-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only where driver and executors are one process (a plain local session, as in tests) may it be left unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of its own for one run."""
    return f"{shared_folder(spark)}/ledgerlake/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a written table: computed once, with a short plan for what builds on them."""
    path = fresh_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and its file system, whichever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    where, fs = _at(spark, path)
    fs.delete(where, True)


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the ``version=N`` folders that were written to the end, in order."""
    where, fs = _at(spark, folder)
    if not fs.exists(where):
        return []
    found = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("version=")]
    return sorted(int(x.getName().split("=")[1]) for x in found if fs.exists(_at(spark, f"{x.toString()}/_SUCCESS")[0]))
