"""Ranked lexical search by NRA over impact-sorted lists.

Documents are indexed in segments. A segment holds, for each term asked for, the documents that have it and how often. Counts over
all segments give the weight of every term; then each list is sorted by impact, and each query reads its lists in step from the
top, a longer stretch each round, never at random. Per document it keeps the sum of what was read (lower bound) and
adds the next impact of every list in which the document has not turned up (upper bound). Documents whose upper
bound is below the k-th lower bound drop out; reading ends when no unseen document can enter and the bounds of
all that are left meet, so that membership, ties and scores are exact. The k best of earlier segments of a task bound later ones.
The best of all tasks are merged per query.

Queries are taken in blocks of a bounded number of terms, so what is sent to all tasks is bounded; documents are read whole.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import settle, ship, table

SEGMENT_WORDS = 1 << 22
BLOCK_TERMS, BLOCK_QUERIES = 1 << 16, 4096  # of one block of queries; a longer query is a block of its own
FIRST_READ = 64  # entries of each list in the first round, twice as many in each later one
CELLS = 1 << 26  # documents times lists that one search looks at together
PIECE = 1 << 20
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

POSTINGS = ("n_docs long, n_words long, terms array<int>, held array<int>, starts binary, places binary, counts binary, ids binary, lengths binary")
FOUND = "query int, doc_id long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, in pieces of bounded size."""
    data = (text or "").encode().translate(TERM_BYTES)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + PIECE)
        cut = len(data) if cut < 0 else cut
        yield data[at:cut].split()
        at = cut


def blocks(queries: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Queries (id, text) as lists of (id, {term: times}), each with a bounded number of distinct terms."""
    block, seen = [], set()
    for key, text in queries:
        times: dict[bytes, int] = {}
        for piece in terms(text):
            for word in piece:
                times[word] = times.get(word, 0) + 1
        if block and (len(seen | times.keys()) > BLOCK_TERMS or len(block) >= BLOCK_QUERIES):
            yield block
            block, seen = [], set()
        block.append((key, times))
        seen |= times.keys()
    if block:
        yield block


def build_segment(ids: list, found: list[np.ndarray], lengths: list[int]) -> pa.RecordBatch:
    """One row: the lists of a segment. Documents without number are counted but not listed."""
    n = len(ids)
    sizes = [len(f) for f in found]
    key, counts = np.unique(np.concatenate(found).astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
    term, place = key // n, key % n
    names, held = np.unique(term, return_counts=True)
    listed = np.array([i is not None for i in ids])[place]
    term, place, counts = term[listed], place[listed], counts[listed]
    starts = np.searchsorted(term, np.concatenate([names, [np.iinfo(np.int64).max]]))
    row = {"n_docs": sum(x > 0 for x in lengths), "n_words": sum(lengths), "terms": names.tolist(), "held": held.tolist(),
           "starts": starts.astype(np.int64).tobytes(), "places": place.astype(np.int32).tobytes(), "counts": counts.astype(np.int64).tobytes(),
           "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "lengths": np.array(lengths, np.int64).tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=SEGMENT)


SEGMENT = pa.schema([("n_docs", pa.int64()), ("n_words", pa.int64()), ("terms", pa.list_(pa.int32())), ("held", pa.list_(pa.int32())),
                     *((name, pa.binary()) for name in ("starts", "places", "counts", "ids", "lengths"))])


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The segments of ``docs`` (doc_id, text), restricted to the terms of ``vocabulary``."""
    def run(batches):
        ids, found, lengths, words = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                own, n = [], 0
                for piece in terms(text.as_py()):
                    n += len(piece)
                    own += [v for v in map(vocabulary.get, piece) if v is not None]
                ids.append(key.as_py())
                found.append(np.array(own, np.int32))
                lengths.append(n)
                words += n + 1
                if words >= SEGMENT_WORDS:
                    yield build_segment(ids, found, lengths)
                    ids, found, lengths, words = [], [], [], 0
        if ids:
            yield build_segment(ids, found, lengths)

    return docs.mapInArrow(run, POSTINGS)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the documents (0 to n - 1) that may be among the ``k`` best with ``floor`` or more.

    ``lists`` has, per term, places and impacts, highest impact first. Documents level with the k-th come back, too.
    """
    lower = np.zeros(n, np.int64)
    seen = np.zeros((len(lists), n), bool)
    bound = np.array([impacts[0] for _, impacts in lists], np.int64)
    at, step = 0, FIRST_READ
    alive = np.zeros(0, np.int64)
    admitting = True
    while True:
        for t, (places, impacts) in enumerate(lists):
            if bound[t]:
                read = places[at:at + step]
                lower[read] += impacts[at:at + step]
                seen[t, read] = True
                bound[t] = impacts[at + step] if at + step < len(impacts) else 0
        at, step = at + step, 2 * step
        rest = int(bound.sum())
        if admitting:
            alive = np.flatnonzero(lower)
        low = lower[alive]
        if len(low) >= k:
            floor = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
        gap = rest - (bound[:, None] * seen[:, alive]).sum(axis=0) if rest else np.zeros(len(alive), np.int64)
        open_ = low + gap >= floor
        if rest < floor:  # nothing unseen can enter any more
            admitting = False
            alive, gap = alive[open_], gap[open_]
            if not gap.any():
                return alive, lower[alive]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def search(segments: DataFrame, asked: list[list[tuple[int, int]]], weights: dict[int, int], n: int, words: int, k: int) -> DataFrame:
    """The ``k`` best per task and query (number within the block); ``asked`` has each query's terms with how often."""
    def run(batches):
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        for batch in batches:
            for row in batch.to_pylist():
                starts, counts, ids, lengths = (np.frombuffer(row[c], np.int64) for c in ("starts", "counts", "ids", "lengths"))
                places = np.frombuffer(row["places"], np.int32)
                m = 75 + (25 * lengths * n) // words
                impact = (1_000_000_000 * counts) // (1000 * counts + 12 * m[places])
                order = np.lexsort((-impact, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                places, impact = places[order], impact[order]
                slot = {t: i for i, t in enumerate(row["terms"]) if starts[i + 1] > starts[i]}
                for q, wanted in enumerate(asked):
                    own = [(slot[t], times * weights[t]) for t, times in wanted if t in slot and weights[t]]
                    if not own:
                        continue
                    lists = [(places[starts[i]:starts[i + 1]], w * impact[starts[i]:starts[i + 1]]) for i, w in own]
                    stride = max(1, CELLS // len(lists))
                    for a in range(0, len(ids), stride):
                        part = lists
                        if stride < len(ids):
                            inside = [(p >= a) & (p < a + stride) for p, _ in lists]
                            part = [(p[i] - a, s[i]) for (p, s), i in zip(lists, inside) if i.any()]
                        if part:
                            floor = max(1, int(top[q][1][-1])) if len(top[q][1]) == k else 1
                            at, scores = nra(part, min(stride, len(ids) - a), k, floor)
                            top[q] = best(np.concatenate([top[q][0], ids[at + a]]), np.concatenate([top[q][1], scores]), k)
        sizes = [len(i) for i, _ in top]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), sizes), pa.int32()), pa.array(np.concatenate([i for i, _ in top])),
                                          pa.array(np.concatenate([s for _, s in top]))], ["query", "doc_id", "score"])

    return segments.select("terms", "starts", "places", "counts", "ids", "lengths").mapInArrow(run, FOUND)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the ``k`` highest-scoring documents above 0 for every row of ``queries``.

    Equal scores go by ascending ``doc_id``. Null and empty texts have no terms; a query without a term that occurs gets no row.
    Each row of ``queries`` is a query of its own, also where ids repeat or are null, and each row of ``docs`` a document of its own.
    Documents without ``doc_id`` are counted in the statistics and never returned. Texts of any length are read whole.
    An empty table on either side gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    listed = queries.select(F.col(query_id).cast("long").alias("q"), F.col(text).alias("t")).orderBy("q", "t")
    result = None
    for block in blocks((r["q"], r["t"]) for r in listed.toLocalIterator()):
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(times for _, times in block))))}
        segments = settle(index(narrow, vocabulary), "postings")
        n, words = segments.agg(F.sum("n_docs"), F.sum("n_words")).first()
        if not n:
            break
        held = segments.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy("x.terms").agg(F.sum("x.held"))
        weights = {t: weight(n, df) for t, df in held.collect()}  # at most one row per term of the block
        asked = [[(vocabulary[t], times) for t, times in own.items() if vocabulary[t] in weights] for _, own in block]
        found = search(segments, asked, weights, n, words, k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
        keys = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], f"query int, {query_id} long")
        own = settle(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(F.broadcast(keys), "query").select(
            query_id, "rank", "doc_id", "score"), "ranked")  # keys: BLOCK_QUERIES rows at most
        result = own if result is None else result.unionByName(own)
    return spark.createDataFrame([], f"{query_id} long, rank int, doc_id long, score long") if result is None else result


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


OP12_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, big_n),
impacts AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) AS s
  FROM tf JOIN weights USING (term) JOIN lengths ON lengths.doc_id = tf.doc_id, totals),
scores AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id HAVING sum(s) > 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
