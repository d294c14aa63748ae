"""Helpers shared by the text operators."""

import ctypes
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerlake
from ledgerlake.functions.workspace import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A folder of its own for one run, below the folder that all executors share."""
    return f"{shared_folder(spark)}/llm/{purpose}-{uuid.uuid4().hex}"


ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they need no copy on their path.

    Rows hold whole texts, so batches to the workers are kept to fewer rows than Spark's default, unless the session asks for fewer still.
    """
    if int(spark.conf.get(ROWS_SETTING)) > BATCH_ROWS:
        spark.conf.set(ROWS_SETTING, BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "_ledgerlake_sent", False):
        return
    root = Path(ledgerlake.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="ledgerlake-code-")) / "ledgerlake_code.zip"  # the driver serves it from there
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._ledgerlake_sent = True


@contextmanager
def large_batches(spark: SparkSession):
    """Batches of as many rows as Spark gives by default, but few bytes: for steps whose rows are numbers. They must be written within."""
    before = {name: spark.conf.get(name) for name in (ROWS_SETTING, BYTES_SETTING)}
    spark.conf.set(ROWS_SETTING, 10 * BATCH_ROWS)
    spark.conf.set(BYTES_SETTING, "4m")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` as a written table in the shared folder.

    Cuts lineage: what is read twice is computed once, and a lost executor costs no earlier step.
    """
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    For pure ASCII (as many bytes as characters) the plain ``lower`` does just that, and is much faster.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


class Remembered:
    """Results by key in two generations: when the younger is full it becomes the older one, and what is found there moves up again.

    So frequent keys stay and the size is bounded, in bytes of keys and values.
    """

    def __init__(self, most_bytes: int):
        self.most, self.size, self.young, self.old = most_bytes // 2, 0, {}, {}

    def get(self, key: bytes | str, find) -> bytes:
        """What is known of a key that is not among the young ones; else what ``find`` says."""
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = find(key)
            if self.size >= self.most:
                self.old, self.young, self.size = self.young, {}, 0
            self.young[key] = value
            self.size += len(key) + len(value) + 200  # with what the objects themselves take
        return value


def hand_back() -> None:
    """Gives freed memory of a Python worker back to the system: the next task may be that of another operator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass
