"""Token counts from the exact histogram of encoded lengths.

Documents are encoded in the tasks and reduced there to (length, documents) counts. Suffix sums along
the histogram, which has a row per distinct length and not per document, answer totals, quantiles and
the total that is left when every document is cut at a limit.
"""

import base64
from collections import Counter
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import ship, table

RANKS = "byte_bpe_50k.tiktoken"


@cache
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def length_histogram(docs: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """length, n_docs: how many documents have that many tokens.

    Whole texts are encoded; control strings in them are ordinary text. A null or empty text has length 0.
    Rows count as often as they occur. An empty table gives an empty histogram.
    """
    path = ranks_path or public_tokenizers.path(RANKS)

    def count(batches):
        encode, seen = encoder(path, pattern).encode_ordinary, Counter()
        for batch in batches:
            seen.update(len(encode(t)) if (t := v.as_py()) else 0 for v in batch.column(0))
        yield pa.RecordBatch.from_pydict({"length": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    ship(docs.sparkSession)
    return docs.select(text).mapInArrow(count, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def length_report(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, the exact answers.

    n_docs, n_tokens of just that length; n_docs_from, n_tokens_from: of that length or more (suffix sums);
    quantile: share of documents not longer; truncated_total: tokens left when every document is cut at it;
    n_cut: documents that are cut.
    """
    suffix = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("length") * F.col("n_docs")
    sums = histogram.select(
        "length", "n_docs", tokens.alias("n_tokens"), F.sum("n_docs").over(suffix).alias("n_docs_from"), F.sum(tokens).over(suffix).alias("n_tokens_from"),
        F.sum("n_docs").over(whole).alias("_docs"), F.sum(tokens).over(whole).alias("_tokens"))
    return sums.select(
        "length", "n_docs", "n_tokens", "n_docs_from", "n_tokens_from",
        ((F.col("_docs") - F.col("n_docs_from") + F.col("n_docs")) / F.col("_docs")).alias("quantile"),
        (F.col("_tokens") - F.col("n_tokens_from") + F.col("length") * F.col("n_docs_from")).alias("truncated_total"),
        (F.col("n_docs_from") - F.col("n_docs")).alias("n_cut"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit_tokens, total, n_cut for any limits, whether or not a document has that length."""
    return histogram.agg(*[f(i, limit) for i, limit in enumerate(limits) for f in (
        lambda i, limit: F.coalesce(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias(f"t{i}"),
        lambda i, limit: F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias(f"c{i}"))]).select(
        F.inline(F.array(*[F.struct(F.lit(limit).cast("long").alias("limit_tokens"), F.col(f"t{i}").alias("total"), F.col(f"c{i}").alias("n_cut"))
                           for i, limit in enumerate(limits)])))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return length_report(length_histogram(table(spark, sf_dir, "documents")))
