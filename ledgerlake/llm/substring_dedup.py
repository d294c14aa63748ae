"""Removal of long passages that also occur in an earlier document, by fixed-block anchors.

Every document is cut into blocks of ``block`` words that do not overlap; any window of 2 * block - 1 words or more holds a whole block of
wherever else it occurs. The blocks are the index, with the smallest document of each; the probes are all rolling
stretches of ``block`` words of all documents. A probe that meets a block of a smaller document is an anchor, in that document and, for
its own block, in the smallest one. Anchors are extended: the windows around an anchor are known by fingerprints of 80 bits, of
which the smallest document is found in the same way, and neighbouring repeated windows join to maximal repeats.

Index and probes meet in buckets of their hash. A map task sends one packed row per bucket, five bytes a probe, the bucket standing for
more bits. Inside a bucket the index comes first and is reduced to one entry per hash as it is read, then the probes stream
by, so a passage that a third of all documents share costs memory for one entry and no pair of documents is ever formed.
Anchors and repeated windows go back to their documents in packed rows, too, one for a bucket and a group of documents: in
each partition of texts the rows of a group come first and then its texts stream by.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import settle, ship, table
from ledgerlake.llm.shingles import mix
from ledgerlake.llm.word_arrays import hash_words

WINDOW = 50
BUCKET_BYTES = 1 << 29  # of text for each bucket of blocks and probes
BUCKET_WINDOWS = 1 << 22  # windows in each bucket of windows
PACK_ENTRIES, MOST_WORDS = 8192, 1 << 22  # a task packs documents together until a bucket gets so many entries, within so many words
GROUP_BYTES = 1 << 26  # of text for each group of documents that anchors are sent back to
COMPACT = 1 << 22  # index entries that are read before equal ones are merged
_STEP, _LEFT, _RIGHT, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
PACK = "bucket int, kind int, docs binary, sizes binary, prints binary"
HITS = "group int, docs binary, sizes binary, prints binary"
WIDE = np.dtype([("a", "<u8"), ("b", "<u2")])  # the fingerprint of a window, packed into ten bytes


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of ``width`` words, from those of half its width."""
    if width == 1:
        return words
    if len(words) < width:
        return words[:0]
    half = width // 2
    part = rolling(words, half)
    joined = part[:-half] * np.uint64(pow(int(_STEP), half, 2**64)) + part[half:]
    return joined if width % 2 == 0 else joined[:-1] * _STEP + words[width - 1:]


class Stretches:
    """All rolling stretches of a batch of documents: hashes, their documents (rows of the batch) and places."""

    def __init__(self, texts: pa.Array, block: int, window: int):
        words, self.first = hash_words(texts)
        self.block, self.window, self.words = block, window, len(words)
        n = np.diff(self.first)
        hashes = rolling(words, block)
        owner = np.repeat(np.arange(len(n)), n)[:len(hashes)]
        place = np.arange(len(hashes)) - self.first[owner]
        self.whole = place + block <= n[owner]  # within one document
        self.owner, self.place, self.hashes, self.n = owner, place, hashes, n

    def keys(self) -> np.ndarray:
        return mix(self.hashes)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place where a window starts: the place over the batch and two parts of its fingerprint."""
        at = np.flatnonzero(self.place + self.window <= self.n[self.owner])
        left, right = self.hashes[at], self.hashes[at + self.window - self.block]
        both = left * _LEFT + right * _RIGHT
        return at, mix(both), mix((left ^ mix(right)) * _SECOND)


def pack(kind: int, ids: np.ndarray, owner: np.ndarray, bucket: np.ndarray, prints: np.ndarray, buckets: int) -> list[tuple]:
    """One row per bucket: documents, how many entries each has, and the entries."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    owner, bucket, prints = owner[order], bucket[order], prints[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(bucket) != 0)])) if len(owner) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([new, [len(owner)]])).astype(np.int32)
    docs, of = ids[owner[new]], bucket[new]
    groups = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0])) if len(of) else new
    ends = np.concatenate([groups[1:], [len(of)]])[:len(groups)]
    entry = np.concatenate([new, [len(owner)]])
    return [(int(of[g]), kind, docs[g:e].tobytes(), sizes[g:e].tobytes(), prints[entry[g]:entry[e]].tobytes()) for g, e in zip(groups, ends)]


def rows_of(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * len(schema), schema)], schema=schema)


PACK_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("prints", pa.binary())])
HITS_SCHEMA = pa.schema([("group", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("prints", pa.binary())])
LOW = np.uint64((1 << 24) - 1)


def _narrow(keys: np.ndarray) -> np.ndarray:
    """The upper 40 bits of each key as five bytes."""
    return np.ascontiguousarray((keys >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])


def _widen(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view(np.uint64)


class Firsts:
    """The smallest document of each fingerprint of a bucket."""

    def __init__(self):
        self.prints, self.extra, self.docs, self.pending, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.int64), [], 0

    def add(self, prints: np.ndarray, extra: np.ndarray, docs: np.ndarray) -> None:
        self.pending.append((prints, extra, docs))
        self.waiting += len(prints)
        if self.waiting > max(COMPACT, len(self.prints)):
            self.merge()

    def merge(self) -> None:
        if not self.pending:
            return
        prints, extra, docs = (np.concatenate(x) for x in zip((self.prints, self.extra, self.docs), *self.pending))
        order = np.lexsort((docs, extra, prints))
        prints, extra, docs = prints[order], extra[order], docs[order]
        new = np.concatenate([[True], (np.diff(prints) != 0) | (np.diff(extra) != 0)])[:len(prints)]
        self.prints, self.extra, self.docs, self.pending, self.waiting = prints[new], extra[new], docs[new], [], 0
        self.used = np.zeros(len(self.prints), bool)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[mix(self.prints) >> np.uint64(44)] = True

    def earlier(self, prints: np.ndarray, extra: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The entries whose fingerprint occurs in a smaller document."""
        self.merge()
        if not len(self.prints):
            return np.zeros(0, np.int64)
        near = np.flatnonzero(self.maybe[mix(prints) >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.prints, prints[near]), len(self.prints) - 1)
        hit = (self.prints[at] == prints[near]) & (self.extra[at] == extra[near]) & (self.docs[at] < docs[near])
        self.used[at[hit]] = True
        return near[hit]


def _by_group(docs: np.ndarray, prints: np.ndarray, groups: int) -> list[tuple]:
    """One row per group of documents: documents, how many fingerprints each has, and these."""
    order = np.argsort(docs, kind="stable")
    docs, prints = docs[order], prints[order]
    new = np.flatnonzero(np.concatenate([[True], np.diff(docs) != 0])[:len(docs)])
    names = docs[new]
    sizes = np.diff(np.concatenate([new, [len(docs)]]))
    group = np.array([zlib.crc32(b"%d" % d) % groups for d in names.tolist()], np.int64)
    rows = pack(0, names, np.repeat(np.arange(len(names)), sizes), np.repeat(group, sizes), prints, 1 << 20)
    return [(of, *rest) for of, _, *rest in rows]


def _met(rows: DataFrame, buckets: int, groups: int, wide: bool) -> DataFrame:
    """The fingerprints of documents that a smaller document has, too; for blocks also those of the smallest document itself."""
    def run(batches):
        now, firsts, found, size = None, Firsts(), [], 0

        def owners() -> list:
            """The index entries that were met, for the documents that they come from."""
            if wide or not len(firsts.prints) or not firsts.used.any():
                return []
            return [(firsts.docs[firsts.used], (firsts.prints[firsts.used] << np.uint64(24)) | np.uint64(now))]

        def flushed() -> pa.RecordBatch:
            return rows_of(_by_group(*(np.concatenate(x) for x in zip(*found)), groups) if found else [], HITS_SCHEMA)

        for batch in batches:
            for bucket, kind, docs, sizes, prints in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    found += owners()
                    now, firsts = bucket, Firsts()
                docs = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.int32))
                if wide:
                    entries = np.frombuffer(prints, WIDE)
                    prints, extra = np.ascontiguousarray(entries["a"]), np.ascontiguousarray(entries["b"])
                else:
                    prints = _widen(prints)
                    extra = np.zeros(len(prints), np.uint16)
                if kind == 0:
                    firsts.add(prints, extra, docs)
                    continue
                hit = firsts.earlier(prints, extra, docs)
                found.append((docs[hit], prints[hit] if wide else (prints[hit] << np.uint64(24)) | np.uint64(now)))
                size += len(hit)
                if size >= COMPACT:
                    yield flushed()
                    found, size = [], 0
        found += owners()
        yield flushed()

    dealt = rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, HITS)


def _with_texts(hits: DataFrame, texts: DataFrame, groups: int) -> DataFrame:
    """Hits and texts by group, the hits of each group first."""
    none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "sizes", "prints")]
    group = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % groups, F.lit(0)).cast("int")
    both = hits.select("group", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
                       "docs", "sizes", "prints").unionByName(texts.select(group.alias("group"), F.lit(1).alias("kind"), "doc_id", "text", *none))
    return both.repartitionById(groups, "group").sortWithinPartitions("group", "kind")


class Held:
    """The fingerprints that were sent back to the documents of one group."""

    def __init__(self):
        self.group, self.parts, self.docs, self.prints = None, [], np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def read(self, batches):
        """Batches of texts (doc_id, text) with the hits of their group at hand."""
        for batch in batches:
            group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if group[a] != self.group:
                    self.group, self.parts = group[a], []
                    self.docs, self.prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    self.parts += zip(*(part.column(c).to_pylist() for c in (4, 5, 6)))
                    continue
                if self.parts:
                    docs = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(n, np.int32)) for d, n, _ in self.parts])
                    order = np.argsort(docs, kind="stable")
                    self.docs, self.parts, prints = docs[order], [], np.concatenate([np.frombuffer(p, np.uint64) for _, _, p in self.parts])
                    self.prints = prints[order]
                yield part.select([2, 3])

    def of(self, docs: list) -> list[np.ndarray]:
        """The fingerprints of each document; none for those without number."""
        known = np.array([d or 0 for d in docs], np.int64)
        a, b = np.searchsorted(self.docs, known, "left"), np.searchsorted(self.docs, known, "right")
        return [self.prints[x:y] if d is not None else self.prints[:0] for d, x, y in zip(docs, a.tolist(), b.tolist())]


def _gathered(batches, buckets: int):
    """Batches of numbered documents, put together until each bucket gets a fair number of entries."""
    held, size = [], 0
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= 6 * min(MOST_WORDS, PACK_ENTRIES * buckets):
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(rows: pa.Table, i: int) -> pa.Array:
    column = rows.column(i)
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def anchors(docs: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """The blocks and all rolling stretches, packed by bucket."""
    def run(batches):
        for rows in _gathered(batches, buckets):
            ids, s = _column(rows, 0).to_numpy(zero_copy_only=False), Stretches(_column(rows, 1), block, window)
            keys = s.keys()
            bucket, prints = ((keys & LOW) % np.uint64(buckets)).astype(np.int64), _narrow(keys)
            worth = s.whole & (s.n[s.owner] >= window)
            index = worth & (s.place % block == 0)
            packs = pack(0, ids, s.owner[index], bucket[index], prints[index], buckets)
            yield rows_of(packs + pack(1, ids, s.owner[worth], bucket[worth], prints[worth], buckets), PACK_SCHEMA)

    return docs.mapInArrow(run, PACK)


def around(rows: DataFrame, block: int, window: int, anchor_buckets: int, buckets: int) -> DataFrame:
    """Texts with their anchors to the fingerprints of all windows that hold an anchor, packed by bucket."""
    def packed(ids: list, texts: list[pa.Array], hits: list[np.ndarray]) -> pa.RecordBatch:
        ids, s = np.array(ids, np.int64), Stretches(pa.concat_arrays(texts), block, window)
        keys = s.keys()
        keys = (keys & ~LOW) | (keys & LOW) % np.uint64(anchor_buckets)
        live = np.zeros(len(keys), bool)
        for i, own in enumerate(hits):
            a, b = s.first[i], min(s.first[i + 1], len(keys))
            live[a:b] = np.isin(keys[a:b], own)
        live &= s.whole
        before = np.concatenate([[0], np.cumsum(live)])
        at, a, b = s.windows()
        held = before[np.minimum(at + window - block + 1, len(live))] > before[at]
        at, a, b = at[held], a[held], b[held]
        prints = np.empty(len(at), WIDE)
        prints["a"], prints["b"] = a, b >> np.uint64(48)
        bucket = ((b & LOW) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ids[s.owner[at]], prints["b"], a))
        first = order[np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(prints["b"][order]) != 0)])[:len(order)]]
        packs = pack(0, ids, s.owner[at[first]], bucket[first], prints[first], buckets)
        return rows_of(packs + pack(1, ids, s.owner[at], bucket, prints, buckets), PACK_SCHEMA)

    def run(batches):
        held = Held()
        ids, texts, hits, size = [], [], [], 0
        for batch in held.read(batches):
            docs = batch.column(0).to_pylist()
            own = held.of(docs)
            some = [i for i, x in enumerate(own) if len(x)]
            ids += [docs[i] for i in some]
            hits += [own[i] for i in some]
            texts.append(batch.column(1).take(pa.array(some, pa.int64())))
            size += texts[-1].nbytes
            if size >= 6 * min(MOST_WORDS, PACK_ENTRIES * buckets):
                yield packed(ids, texts, hits)
                ids, texts, hits, size = [], [], [], 0
        if ids:
            yield packed(ids, texts, hits)

    return rows.mapInArrow(run, PACK)


SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64())])


def cut(rows: DataFrame, block: int, window: int) -> DataFrame:
    """Texts with their repeated windows to their words without the repeats."""
    def run(batches):
        held = Held()
        for batch in held.read(batches):
            texts, own = batch.column(1), held.of(batch.column(0).to_pylist())
            some = [i for i, x in enumerate(own) if len(x)]
            spans: list[list] = [[] for _ in range(len(texts))]
            if some:
                s = Stretches(texts.take(pa.array(some)), block, window)
                at, a, _ = s.windows()
                bounds = np.searchsorted(at, s.first)
                for i, row in enumerate(some):
                    part = slice(bounds[i], bounds[i + 1])
                    starts = at[part][np.isin(a[part], own[row])] - s.first[i]
                    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > window])[:len(starts)])
                    ends = starts[np.concatenate([new[1:], [len(starts)]])[:len(new)] - 1] + window
                    spans[row] = list(zip(starts[new].tolist(), ends.tolist()))
            n, kept = [], []
            for text, own in zip(texts, spans):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                rest, upto = [], 0
                for a, b in own:
                    rest += words[upto:a]
                    upto = b
                kept.append(b" ".join(rest + words[upto:]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(
                [[{"start": a, "length": b - a} for a, b in own] for own in spans], pa.list_(SPAN)), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, removed array<struct<start: long, length: long>>, kept string")


def substring_dedup(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, removed (spans of words: start, length), kept (the other words, joined by one space).

    A window is ``window`` (2 or more) consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document, compared as they are. A word goes if a window that covers
    it has the same words as one of a document with a smaller ``doc_id``; the input decides, not what is left of it. Windows are told apart by
    fingerprints of 80 bits and the bits of their bucket. Null and empty texts have no words; shorter texts than a window are kept. Very long
    texts are taken whole, repeats within one document stay. Rows that repeat a ``doc_id`` are documents each and not earlier than each other; rows without one
    are kept whole and make no other row lose words. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    block = (window + 1) // 2
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchor_buckets, groups = max(partitions, -(-size // BUCKET_BYTES)), max(partitions, -(-size // GROUP_BYTES))
    hits = settle(_met(anchors(texts, block, window, anchor_buckets), anchor_buckets, groups, wide=False), "anchors")
    most = min(size, block * (hits.agg(F.sum(F.octet_length("prints") / 8)).first()[0] or 0))
    buckets = max(partitions, int(-(-most // BUCKET_WINDOWS)))
    windows = around(_with_texts(hits, texts, groups), block, window, anchor_buckets, buckets)
    repeated = settle(_met(windows, buckets, groups, wide=True), "repeats")
    return cut(_with_texts(repeated, texts, groups), block, window)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
word AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
win AS (SELECT r, doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS k FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
starts AS (SELECT r, k FROM win JOIN firsts USING (s) WHERE first < doc_id),
marked AS (SELECT word.r, word.k, word, max(CASE WHEN starts.k IS NOT NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY word.r ORDER BY word.k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM word LEFT JOIN starts ON starts.r = word.r AND starts.k = word.k),
cut AS (SELECT r, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (gone = 0) AS kept
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
