"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows of each source partition go to each target cell is drawn first, from the counts alone;
then rows are permuted inside their partition, cut by the drawn counts, exchanged, and permuted again
inside their cell. Every arrangement of rows over slots is equally likely, and every shard gets its
exact size. A shard consists of several cells, so that no task has to order a whole shard.

The matrix is drawn on the driver: partitions times cells numbers, whatever the number of rows.
"""

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import table

MAX_CELLS = 1024


def hypergeometric(rng: np.random.Generator, marked: int, total: int, draws: int) -> int:
    """How many of ``draws`` out of ``total`` are among the ``marked``.

    By inverting the distribution over 12 standard deviations around its mean (what lies outside has less
    than 1e-30 of it), so any number of rows will do.
    """
    low, high = max(0, draws + marked - total), min(marked, draws)
    if low == high:
        return low
    mean = draws * marked / total
    spread = math.sqrt(mean * (1 - marked / total) * (total - draws) / max(1, total - 1))
    a, b = max(low, math.floor(mean - 12 * spread - 12)), min(high, math.ceil(mean + 12 * spread + 12))
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log((marked - k) / (k + 1)) + np.log((draws - k) / (total - marked - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    cumulative = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(cumulative, rng.random() * cumulative[-1], side="right"))


def even_parts(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def communication_matrix(counts: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """Rows: source partitions; columns: target cells. Row and column sums are exact."""
    rng, left, matrix = np.random.default_rng(seed), list(cells), []
    for n in counts:
        rest, total, row = n, sum(left), []
        for c, size in enumerate(left):
            take = hypergeometric(rng, size, total, rest)
            total, rest = total - size, rest - take
            left[c] -= take
            row.append(take)
        matrix.append(row)
    return matrix


def noise(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_into_shards(rows: DataFrame, key: str, shards: int = 16, seed: int = 20_240_501, partitions: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard); shard sizes differ by one at most.

    The row decides its source partition and its place in the permutations, ``key`` first and then all other columns, so a recomputed task
    agrees with the lost one whatever the order in which rows reach it, and a key that many rows share is spread. Repeated and
    null keys are allowed; rows that agree in every column are alike. Very long texts are best left out and joined by ``key`` afterwards. An empty table gives an empty result. Further columns are carried along; columns named ``shard``,
    ``slot`` are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot", "_part", "_bounds", "_at", "_cell")
    width = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_shard = max(1, min(math.ceil(width / shards), MAX_CELLS // shards))
    plain = lambda f: F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() or isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`")
    whole = [plain(f) for f in sorted(rows.schema.fields, key=lambda f: f.name != key)]
    part = F.pmod(noise(seed, *whole), F.lit(width)).cast("int")
    found = {r["_part"]: r["n"] for r in rows.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(width)]
    cells = [c for size in even_parts(sum(counts), shards) for c in even_parts(size, per_shard)]
    matrix = communication_matrix(counts, cells, seed)
    bounds = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(np.cumsum(matrix, axis=1).tolist())), "array<array<bigint>>")).alias("_part", "_bounds"))
    starts = F.from_json(F.lit(json.dumps([sum(cells[c - c % per_shard:c]) for c in range(len(cells))])), "array<bigint>")

    local = Window.partitionBy("_part").orderBy(noise(seed + 1, *whole), *whole)
    sent = rows.withColumn("_part", part).withColumn("_at", F.row_number().over(local) - 1).join(bounds, "_part")
    sent = sent.withColumn("_cell", F.size(F.filter("_bounds", lambda b: b <= F.col("_at")))).drop("_part", "_bounds", "_at")
    again = Window.partitionBy("_cell").orderBy(noise(seed + 2, *whole), *whole)
    return sent.withColumn("slot", F.get(starts, F.col("_cell")) + F.row_number().over(again) - 1).withColumn(
        "shard", F.floor(F.col("_cell") / per_shard).cast("int")).drop("_cell")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    done = shuffle_into_shards(docs, "doc_id")
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
