"""Structured Streaming forms of the vehicle feed and of the day book."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.functions.workspace import complete_versions, removed
from ledgerlake.operators.ledger import MONEY
from ledgerlake.sources.vehicles import FIELDS, parse_feed

REGISTER_SCHEMA = "car_id string, vin_sn string, title_en string, batch long"
TOTALS_SCHEMA = f"date date, debit {MONEY}, credit {MONEY}, line_count long"
KEPT_VERSIONS = 2
# Keyed state on disk, so that its size is not bound by an executor's memory.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def daily_totals(lines: DataFrame, delay: str = "2 days") -> DataFrame:
    """Debit and credit per day, emitted once the watermark has passed the day (A24 as a stream).

    Rows later than the watermark are dropped.
    """
    stamped = lines.withColumn("event_time", F.col("date").cast("timestamp")).withWatermark("event_time", delay)
    per_day = stamped.groupBy(F.window("event_time", "1 day")).agg(
        F.sum("debit").cast(MONEY).alias("debit"), F.sum("credit").cast(MONEY).alias("credit"), F.count(F.lit(1)).alias("line_count"))
    return per_day.select(F.to_date("window.start").alias("date"), "debit", "credit", "line_count")


def _snapshot(spark: SparkSession, folder: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], TOTALS_SCHEMA)
    return spark.read.schema(TOTALS_SCHEMA).parquet(f"{folder}/version={version}")


def add_daily_totals(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the day book (A24) as a snapshot with one row a day, so that back-dated lines count and every day is there.

    Each batch adds its changes to the snapshot before it and writes the next one under its own number; a snapshot counts only once it
    is complete, so readers go from one to the next at once, and a batch that is run again starts from the same one.
    Older snapshots are deleted. A read or a batch costs as many rows as there are days, however many batches there were.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in complete_versions(spark, folder) if v < batch_id]
        changes = batch.groupBy("date").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), F.count(F.lit(1)).alias("line_count"))
        both = _snapshot(spark, folder, before[-1] if before else None).unionByName(changes)
        totals = both.groupBy("date").agg(F.sum("debit").cast(MONEY).alias("debit"), F.sum("credit").cast(MONEY).alias("credit"),
                                          F.sum("line_count").alias("line_count"))
        totals.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        for old in complete_versions(spark, folder)[:-KEPT_VERSIONS]:
            removed(spark, f"{folder}/version={old}")

    needed = lines.select("date", "debit", "credit")
    return needed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Debit, credit and number of lines per day, over all batches so far."""
    versions = complete_versions(spark, folder)
    return _snapshot(spark, folder, versions[-1] if versions else None)


def distinct_vins(documents: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """VINs of a feed without repeats inside the watermark delay, for watching arrivals."""
    return parse_feed(documents.withWatermark(event_time, delay), (event_time,)).select(event_time, "vin_sn").dropDuplicatesWithinWatermark(["vin_sn"])


def register_feed(documents: DataFrame, register_path: str, checkpoint: str, order: list[str],
                  existing: DataFrame | None = None) -> StreamingQuery:
    """Append the first record of every new VIN to the register (S6 as a stream); VINs of ``existing`` are known already.

    The VINs seen so far are keyed state of the stream, and ``existing`` enters it once, in the first batch, through a copy beside the
    checkpoint. So no batch reads what earlier ones wrote. A record is new if its VIN came with this batch first: the time of a batch is
    part of its plan, so a batch that is run again after a failure gives the same rows and replaces its own folder.
    """
    spark = documents.sparkSession
    record = F.struct("car_id", "title_en").alias("record")
    arrivals = parse_feed(documents, tuple(c for c in order if c != "position")).select(
        "vin_sn", record, F.lit(False).alias("known"), F.current_timestamp().alias("arrival"), *order)
    if existing is not None:
        copy = f"{checkpoint}-known"
        existing.select("vin_sn").write.mode("ignore").parquet(copy)
        known = spark.readStream.schema("vin_sn string").parquet(copy)
        kinds = {f.name: f.dataType for f in arrivals.schema.fields}
        arrivals = arrivals.unionByName(known.select(
            "vin_sn", F.lit(None).cast(kinds["record"]).alias("record"), F.lit(True).alias("known"), F.timestamp_seconds(F.lit(0)).alias("arrival"),
            *[F.lit(None).cast(kinds[c]).alias(c) for c in order]))
    seen = arrivals.groupBy("vin_sn").agg(
        F.min_by("record", F.struct("arrival", *order)).alias("record"), F.max("known").alias("known"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))

    def add(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter(~F.col("known") & (F.col("first") == F.col("last"))).select("vin_sn", "record.*")
        new.select(*FIELDS).write.mode("overwrite").parquet(f"{register_path}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        return seen.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
