"""Exact deduplication as a stateful stream.

Rows are landed as narrow capture rows (digest, identifier, locator) and streamed into keyed state on
disk (RocksDB) that never expires: per digest the largest identifier seen, where its content lies, and
how many rows had the digest. The count and the maximum are combined inside each map task before the
shuffle, so a text that a third of all rows hold sends one row per task. A digest seen more than once
is a hit; the full bytes of all its rows are then compared, spread by row identifier and again combined
inside the task. Texts that share a digest but not their bytes are split into classes by their bytes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ascii_lower, new_folder, settle

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated files
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of ended streams are closed soon
    "spark.sql.streaming.minBatchesToRetain": "2",
}
FILES_PER_BATCH = 10_000


def normalised(text: Column) -> Column:
    """What equality is decided on: A-Z lower-cased, null as the empty text."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def stream_state(landed: str, schema, spark, files_per_batch: int) -> DataFrame:
    """Runs the landed capture rows through the keyed state; one row per digest: n, keep_id, keep_at."""
    updates, checkpoint = new_folder(spark, "dedup-updates"), new_folder(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        state = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landed)
                 .groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "locator")).alias("keep")))
        # A repeated batch replaces what it had written before.
        query = (state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
                 .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{updates}/batch={batch}")).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = f"digest binary, n long, keep struct<doc_id: bigint, locator: {dict(schema_types(schema))['locator']}>"
    seen = spark.read.schema(kind).parquet(updates)
    return seen.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select(
        "digest", F.col("s.n").alias("n"), F.col("s.keep.doc_id").alias("keep_id"), F.col("s.keep.locator").alias("keep_at"))


def schema_types(schema) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema]


def dedup(docs: DataFrame, text: str = "text", locator: Column | None = None, digest=sha256,
          files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, keep_at.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts
    form one group. Of equal texts the row with the largest ``doc_id`` stays. ``locator`` tells where a
    row's content lies (the identifier itself unless given, e.g. ``_metadata`` columns). An empty table
    gives an empty result. Rows that repeat a ``doc_id`` are counted each, and a repeated largest one is
    kept as often as it occurs. A null ``doc_id`` loses against any other; alone it keeps itself. Other
    columns are not looked at. ``digest`` may be any function of the normalised text, weak ones included:
    bytes decide.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(norm).alias("digest"),
                       (F.col("doc_id").cast("string") if locator is None else locator).alias("locator"))
    path = new_folder(spark, "dedup-landing")
    rows.write.parquet(path)
    landed = spark.read.schema(rows.schema).parquet(path)
    state = settle(stream_state(path, rows.schema, spark, files_per_batch), "dedup-classes")

    hits = state.filter("n > 1").select("digest")
    hit_ids = landed.join(hits, "digest", "left_semi").select("doc_id").distinct()
    content = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    same_id = content["doc_id"].eqNullSafe(hit_ids["doc_id"])
    # One plan for every size: the list of hits grows with the table, so it is never sent to all tasks.
    by_bytes = content.join(hit_ids.hint("merge"), same_id, "left_semi").groupBy(digest(F.col("norm")).alias("digest"), "norm").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
    checked = settle(by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_bytes")), "dedup-checked")

    clash = checked.filter("texts > 1").select("digest")
    result = landed.select("doc_id", "digest").join(state, "digest")
    if not clash.isEmpty():
        # Different bytes under one digest: such rows take their class from their bytes.
        parted = by_bytes.join(clash, "digest", "left_semi").withColumnRenamed("n", "n_same")
        own = content.withColumn("digest", digest(F.col("norm"))).join(clash, "digest", "left_semi").join(parted, ["digest", "norm"]).select(
            "doc_id", "digest", F.col("n_same").alias("n"), "keep_id", F.lit(None).cast(state.schema["keep_at"].dataType).alias("keep_at"))
        result = result.join(clash, "digest", "left_anti").select(*own.columns).unionByName(own)
    return result.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         "digest", "keep_at")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return dedup(docs, locator=where).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
