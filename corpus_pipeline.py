"""Corpus pipeline: language identification, exact and near deduplication, packing.

Every stage is a function (spark, docs, sf_dir) to a DataFrame, written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import settle, table
from ledgerlake.llm.exact_dedup import dedup, normalised, sha256
from ledgerlake.llm.language_id import UNKNOWN, fit, language_id
from ledgerlake.llm.ngram_join import similar_classes, with_digests
from ledgerlake.llm.packing import pack


def stage_language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops null texts and texts without a letter, and fills in the language of those that have none. Learns from the labelled rows of ``docs``.

    Lettered texts stay, also if nothing could be learned or ``und`` is among the labels; then a missing language stays missing. Rows that repeat, null
    ids and further columns go through as they are.
    """
    done = language_id(docs, fit(docs), only_lettered=True)
    return done.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit(UNKNOWN)))).select(*docs.columns)


def keep_by_id(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``kept``; null matches null."""
    ids = kept.select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")


def free_name(docs: DataFrame) -> str:
    """A column name for digests that ``docs`` does not have."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    return name


def keep_one_by_digest(docs: DataFrame, digested: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest) is in ``kept``, and of repeats of such a pair one.

    Where no ``doc_id`` occurs twice among the kept rows their ids say it all; only the others are looked at by digest (``digested`` has
    the columns of ``docs`` and, last, the digest).
    """
    digest = digested.columns[-1]
    kept = settle(kept.select("doc_id", "digest"), "kept")
    twice = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return keep_by_id(docs, kept)
    once = kept.join(twice, F.col("doc_id").eqNullSafe(F.col("_twice")), "left_anti")
    pairs = kept.join(twice, F.col("doc_id").eqNullSafe(F.col("_twice")), "left_semi").distinct().select(F.col("doc_id").alias("_kept"), "digest")
    own = digested.join(pairs, digested["doc_id"].eqNullSafe(pairs["_kept"]) & (digested[digest] == pairs["digest"]), "left_semi")
    return keep_by_id(docs, once).unionByName(own.dropDuplicates(["doc_id", digest]).select(*docs.columns))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z one row with the largest ``doc_id`` stays.

    A null ``doc_id`` is smaller than any other; of rows that repeat the largest one any stays. Different texts under one ``doc_id`` are told apart.
    """
    done = settle(dedup(docs), "exact-classes")
    digested = docs.withColumn(free_name(docs), sha256(normalised(F.col("text"))))
    # A repeated largest id and an id of several texts are settled by id and digest.
    return keep_one_by_digest(docs, digested, safe(docs, done))


def safe(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Kept rows, twice over where another row with the same ``doc_id`` goes, so that they are looked at by digest."""
    kept = done.filter("kept").select("doc_id", "digest")
    gone = done.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return kept.unionByName(kept.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi"))


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents one with the smallest ``doc_id`` stays; of several with that id, the one whose words have the smallest digest.

    Documents without links stay, whatever others have their ``doc_id``; a group without any ``doc_id`` keeps one document.
    """
    done = settle(similar_classes(docs), "similar-classes")
    first = done.filter(F.col("component_id").eqNullSafe(F.col("doc_id")))
    best = first.groupBy("group", "doc_id").agg(F.min("digest").alias("digest"))
    gone = done.join(best.select("digest", F.col("doc_id").alias("_best"), F.lit(True).alias("stays")), [
        "digest"], "left").filter(~F.coalesce(F.col("stays") & F.col("doc_id").eqNullSafe(F.col("_best")), F.lit(False)))
    again = best.join(gone.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_semi")
    kept = first.select("doc_id", "digest").join(best.select("digest", F.col("doc_id").alias("_best")), "digest").filter(
        F.col("doc_id").eqNullSafe(F.col("_best"))).select("doc_id", "digest")
    return keep_one_by_digest(docs, with_digests(docs, free_name(docs)), kept.unionByName(again.select("doc_id", "digest")))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return pack(docs)


STAGES = [
    ("language_id", stage_language_id),
    ("exact_dedup", stage_exact_dedup),
    ("ngram_join", stage_ngram_join),
    ("best_fit_packing", stage_packing),
]

# Models, similarity classes and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
