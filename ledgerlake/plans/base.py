"""Registration of runnable queries together with their checking SQL."""

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.sources.testbed import Testbed

Query = Callable[[SparkSession, str], DataFrame]

START, END = date(1998, 1, 1), date(1998, 12, 31)
ASOF = date(2001, 8, 1)


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that any engine's result compares by value."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


_TESTBEDS: dict[str, Testbed] = {}


def testbed(spark: SparkSession, sf_dir: str) -> Testbed:
    """The derived tables of a directory, analysed once per session (they are plans, not data)."""
    known = _TESTBEDS.get(sf_dir)
    if known is None or known.spark is not spark:
        known = _TESTBEDS[sf_dir] = Testbed(spark, sf_dir)
    return known


class Family:
    """Queries of one report family: ``@family.query(name, sql)`` over a ``Testbed``."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        def register(build: Callable[[Testbed], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return plain_numbers(build(testbed(spark, sf_dir)))

            self.queries[name] = run
            if oracle:
                self.oracle[name] = oracle
            return build

        return register
