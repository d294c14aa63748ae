"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

1. Documents are encoded in the tasks and cut into pieces of at most the capacity.
2. Pieces are range-sorted by length: every piece gets its rank among the pieces of its length. Ranks are
   counted in salted blocks, so that a length which a third of all pieces share is not one task's work.
3. Supersteps run from the longest length down. In each, the pieces of that length sweep over the gaps
   in ascending order; each takes its successor, the smallest gap that holds it. Pieces of equal length are
   in conflict for the same gaps; rank decides, so a run of pieces takes a run of gaps. Gaps are updated,
   what is left over opens new sequences, and the next superstep follows. Pieces and gaps of equal size move
   as runs (length, first rank, how many), so the sweeps need the histogram only: at most ``capacity`` lengths.
4. Every piece finds its run, and in it its sequence and offset, by length and rank, in its own task.
"""

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass, fields
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import Remembered, hand_back, settle, ship, table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
CACHED_BYTES = 128 << 20
# A comma or stop after a letter (ASCII or Latin-1) at the end of a word; words of such letters in lower case.
STOPPED = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,]$")
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# First bytes of combining marks that join ASCII letters; without them lower-casing ASCII first changes no composition.
MARKS = re.compile(rb"[\xcc\xcd]")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
PIECE = "piece int, start long, length long, ids_crc32 long"


@cache
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


# What the tokenizer does to a text before its model (fixed values), if its ids are those of the text's words one after the other.
BY_WORDS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class TextEncoder:
    """Encodes whole texts: right for any tokenizer. Ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)

    def __call__(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()


class WordEncoder(TextEncoder):
    """Encodes texts word by word and remembers words.

    Right for tokenizers that lower-case, drop white space, never join across it, and take a run of letters as one
    unit: a text's ids are then those of its words, one after the other. ASCII letters are lower-cased here already, and a word that ends in a
    letter with a comma or stop is taken apart, so that more words are alike; the ids stay the same. A word of plain
    lower-case letters goes straight to the model.
    """

    def __init__(self, path: str, most_bytes: int = CACHED_BYTES):
        super().__init__(path)
        from tokenizers.pre_tokenizers import ByteLevel

        self.known = Remembered(most_bytes)
        self.model, self.as_bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __call__(self, text: bytes) -> bytes:
        words = (text if MARKS.search(text) else text.lower()).split()
        parts = list(map(self.known.young.get, words))
        if None in parts:
            get, find = self.known.get, self.word
            for i in [i for i, part in enumerate(parts) if part is None]:
                parts[i] = get(words[i], find)
        return b"".join(parts)

    def word(self, word: bytes) -> bytes:
        if LETTERS.fullmatch(word):
            plain = word.decode()
            ids = [t.id for t in self.model.tokenize(plain if word.isascii() else self.as_bytes(plain)[0][0])]
            return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()
        if STOPPED.search(word, max(0, len(word) - 3)):
            return self.known.get(word[:-1], self.word) + self.known.get(word[-1:], self.word)
        return super().__call__(word)


@cache
def encoder(path: str) -> TextEncoder:
    """Word by word where the tokenizer is known to allow it, else by whole texts."""
    steps = json.loads(load_tokenizer(path).to_str())
    before = [*((steps["normalizer"] or {}).get("normalizers", [])), *((steps["pre_tokenizer"] or {}).get("pretokenizers", []))]
    return WordEncoder(path) if before == BY_WORDS else TextEncoder(path)




def pieces_of(docs: DataFrame, text: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallelism
        encode = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                ids, doc = encode(value.as_py() or b"") + end, doc_id.as_py()
                out += [(doc, i, i * capacity, len(part) // 4, zlib.crc32(part)) for i, part in enumerate(
                    ids[at:at + 4 * capacity] for at in range(0, len(ids), 4 * capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, (
                pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        hand_back()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(cut, f"doc_id long, {PIECE}")


@dataclass
class Run:
    """Pieces of one length with ranks from ``rank`` on: ``each`` to a sequence from ``sequence`` on, the first at ``offset``."""
    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def superstep(length: int, count: int, gaps: dict[int, list[tuple[int, int]]], sizes: list[int], opened: int, capacity: int) -> tuple[list[Run], int]:
    """Places ``count`` pieces of one length. ``gaps``: size of gap -> runs (first sequence, how many); ``sizes``: its keys, sorted."""
    runs, rank = [], 0

    def put_back(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((sequence, n))

    while count:
        at = bisect_left(sizes, length)
        if at < len(sizes):
            gap = sizes[at]
            sequence, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
        else:  # no gap is large enough
            gap, sequence, n = capacity, opened, -(-count // (capacity // length))
            opened += n
        each = gap // length
        full, rest = min(n, count // each), 0
        if full:
            runs.append(Run(length, rank, full * each, sequence, each, capacity - gap))
            put_back(gap - each * length, sequence, full)
        if full < n and (rest := count - full * each):
            runs.append(Run(length, rank + full * each, rest, sequence + full, rest, capacity - gap))
            put_back(gap - rest * length, sequence + full, 1)
        put_back(gap, sequence + full + (rest > 0), n - full - (rest > 0))
        rank, count = rank + full * each + rest, count - full * each - rest
    return runs, opened


def plan_runs(histogram: dict[int, int], capacity: int) -> list[Run]:
    gaps, sizes, opened, runs = {}, [], 0, []
    for length in sorted(histogram, reverse=True):
        more, opened = superstep(length, histogram[length], gaps, sizes, opened, capacity)
        runs += more
    return runs


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, blocks: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length of 1 to ``capacity``, more columns) with ``sequence_id`` and ``offset``.

    The result does not depend on how rows are spread over tasks. Repeated rows are placed each.
    """
    spark = pieces.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    cells = pieces.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    runs = sorted(plan_runs(histogram, capacity), key=lambda r: (r.length, r.rank))
    plan = {f.name: np.array([getattr(r, f.name) for r in runs], dtype=np.int64) for f in fields(Run)}
    shared = spark.sparkContext.broadcast(plan)  # bounded by the capacity, not by the number of documents
    before = cells.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("_rank", inside).join(before.drop("_n"), ["length", "_block"]).withColumn(
        "_rank", F.col("_rank") + F.coalesce("_before", F.lit(0)))

    def place(batches):
        p = shared.value
        # Runs are sorted by length and rank; both fit into one number.
        width = int(p["rank"].max(initial=0) + p["count"].max(initial=0)) + 1
        keys = p["length"] * width + p["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            at = np.searchsorted(keys, length * width + rank, side="right") - 1
            i = rank - p["rank"][at]
            done = [p["sequence"][at] + i // p["each"][at], p["offset"][at] + i % p["each"][at] * length]
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], *map(pa.array, done)],
                                             names=[*kept, "sequence_id", "offset"])

    ship(spark)
    ranked = ranked.drop("_block", "_before")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{kept}, sequence_id long, offset long")


def pack(docs: DataFrame, text: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is just the end token. Only documents longer than ``capacity`` are cut. Rows that repeat a ``doc_id``
    are packed each. An empty table gives an empty result; other columns are not read. Texts of any length are encoded whole, by
    words where the tokenizer allows it.
    """
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    return best_fit(settle(pieces_of(docs, text, path, capacity, end_id), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
