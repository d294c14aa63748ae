"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``MIN_EXPONENT`` periods and ``MIN_WORDS`` words long, that no neighbouring word extends.

Each text is cut into blocks of B words, B = 8, 16, 32, ... A run whose period lies between B and 2B - 1 (below 16 for B = 8)
holds a whole block that occurs again q words later. For every block the sums of squared differences to all
words q apart come from one convolution: words are numbers modulo a prime, and sum(x - y)**2 = sum x**2 + sum y**2 -
2 sum xy, where the last sum for all distances at once is a cyclic correlation, done exactly by a number-theoretic transform.
Where the sum is zero, block and distance seed an extension: neighbouring blocks with the same distance form a chain, which can
reach less than a block further on either side. A sum may be zero modulo the prime by chance, so the words decide at the end.

The transform of the window behind a block is put together from the transforms of the blocks in it, so a scale costs one forward
and one inverse transform a block. All blocks of many texts are transformed together, one column a block.
Work is map-only; a text is held whole by one task, at O(n log^2 n) time and O(n) memory.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import ship, table
from ledgerlake.llm.word_arrays import hash_words, slices

MIN_WORDS, MIN_EXPONENT = 24, 3
LEAST_BLOCK = 8  # 2 * 8 - 1 <= MIN_WORDS - 7, so that runs of the smallest periods hold a whole block, too
SLICE_WORDS = 1 << 16  # texts are transformed together up to so many words, which keeps the arrays in cache
PRIME, GENERATOR = 3_221_225_473, 5  # 3 * 2**30 + 1: products of two residues fit into 64 bits
_P = np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    q = x // _P
    q *= _P
    return np.subtract(x, q, out=q)


def _powers_of_root(size: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    found = np.ones(1, np.uint64)
    while len(found) < size:
        found = np.concatenate([found, _mod(found * np.uint64(pow(root, len(found), PRIME)))])
    return found[:size]


_remembered = cache(_powers_of_root)


def _root_powers(size: int, inverse: bool) -> np.ndarray:
    """The powers 0 to size - 1 of a primitive root of unity of order ``size``; those of very long texts are not kept."""
    return _remembered(size, inverse) if size <= 2 * SLICE_WORDS else _powers_of_root(size, inverse)


def transform(columns: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each column (length a power of two); the inverse is left unscaled."""
    size, count = columns.shape
    roots = _root_powers(size, inverse)
    x, step = np.ascontiguousarray(columns), 1
    while step < size:
        half = size // (2 * step)
        a, b = x.reshape(2, half, step * count)
        y = np.empty((half, 2, step * count), np.uint64)
        up = a + b
        np.minimum(up, up - _P, out=y[:, 0])
        down = a - b
        down = np.minimum(down, down + _P)
        down *= roots[:half * step:step, None]
        y[:, 1] = _mod(down)
        x, step = y, step * 2
    return x.reshape(size, count)


def _seeds(words: np.ndarray, first: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """(text, distance, first word of the block) for every block of ``block`` words that occurs again at a distance of this scale."""
    least = 1 if block == LEAST_BLOCK else block
    counts = np.diff(first)
    texts = np.flatnonzero(counts >= max(MIN_WORDS, MIN_EXPONENT * least))
    none = np.zeros(0, np.int64)
    if not len(texts):
        return none, none, none
    n = counts[texts]
    rows = -(-n // block) + 2
    base = np.concatenate([[0], np.cumsum(rows)])
    place = np.arange(n.sum()) + np.repeat(base[:-1] * block - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    source = np.arange(n.sum()) + np.repeat(first[texts] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    flat = np.zeros(base[-1] * block, np.uint64)
    flat[place] = _mod(words[source])

    size = 4 * block if block == LEAST_BLOCK else 2 * block  # of the transform: no valid distance wraps round
    ahead = (0, 1, 2) if block == LEAST_BLOCK else (1, 2)  # blocks of the window, counted from the block itself
    origin = ahead[0] * block  # of the window
    distances = np.arange(least, 2 * block)
    padded = np.zeros((size, base[-1]), np.uint64)
    padded[:block] = flat.reshape(-1, block).T
    spectrum = transform(padded)
    roots = _root_powers(size, False)
    window = np.zeros((size, base[-1] - 2), np.uint64)
    for i in ahead:
        part = spectrum[:, i:base[-1] - 2 + i]
        turn = (i * block - origin) % size
        window += part if not turn else _mod(part * roots[(np.arange(size) * turn) % size][:, None])
    window = _mod(window)
    window *= np.roll(spectrum[::-1, :-2], 1, axis=0)  # the block's spectrum at negative frequencies
    products = transform(_mod(window), inverse=True)[distances - origin]

    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(flat * flat))])
    at = np.arange(base[-1] - 2) * block
    own = squares[at + block] - squares[at]
    reach = np.minimum(at[None, :] + distances[:, None], len(flat) - block)
    both = squares[reach + block] - squares[reach] + own
    zero = _mod(_mod(both) * np.uint64(size)) == _mod(products + products)

    owner = np.repeat(np.arange(len(texts)), rows)[:-2]
    start = at - base[owner] * block
    zero &= start[None, :] + distances[:, None] + block <= n[owner][None, :]
    which, column = np.nonzero(zero)
    return texts[owner[column]], distances[which], first[texts[owner[column]]] + start[column]


def _reach(words: np.ndarray, at: np.ndarray, distance: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on (way 1) or back (way -1) agree with those ``distance`` later, ``limit`` at most."""
    found = np.zeros(len(at), np.int64)
    active, done, step = np.flatnonzero(limit > 0), 0, 32
    while len(active):
        ahead = done + np.arange(step)
        place = at[active, None] + way * np.minimum(ahead[None, :], limit[active, None] - 1)
        same = (words[place] == words[place + distance[active, None]]) & (ahead[None, :] < limit[active, None])
        run = np.where(same.all(axis=1), step, same.argmin(axis=1))
        found[active] += run
        active, done, step = active[run == step], done + step, min(2 * step, 1024)
    return found


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """All runs as rows (text, start within the text, length, period), sorted; ``first`` has the number of words before each text."""
    known = np.zeros((0, 4), np.int64)  # text, start over all texts, length, period
    longest = int(np.diff(first).max(initial=0))
    block = LEAST_BLOCK
    while longest >= max(MIN_WORDS, MIN_EXPONENT * (1 if block == LEAST_BLOCK else block)):
        text, q, at = _seeds(words, first, block)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(at) != block) | (np.diff(text) != 0)])) if len(q) else q
        last = np.concatenate([new[1:], [len(q)]])[:len(new)] - 1
        text, q, start, end = text[new], q[new], at[new], at[last] + block  # words start to end - 1 agree with those q later
        short = end - start + 2 * (block - 1) + q < np.maximum(MIN_WORDS, MIN_EXPONENT * q)
        text, q, start, end = (x[~short] for x in (text, q, start, end))
        order = np.argsort(start, kind="stable")
        text, q, start, end = (x[order] for x in (text, q, start, end))
        # What lies in a known run at a multiple of its period is that run once more.
        again = np.zeros(len(q), bool)
        for _, s, length, period in known[known[:, 2] >= 2 * block]:
            lo, hi = np.searchsorted(start, [s, s + length])
            again[lo:hi] |= (q[lo:hi] % period == 0) & (end[lo:hi] + q[lo:hi] <= s + length)
        text, q, start, end = (x[~again] for x in (text, q, start, end))
        left = _reach(words, start - 1, q, start - first[text], -1)
        right = _reach(words, end, q, first[text + 1] - q - end, 1)
        length = end - start + left + right + q
        real = length >= np.maximum(MIN_WORDS, MIN_EXPONENT * q)
        known = np.concatenate([known, np.stack([text, start - left, length, q], axis=1)[real]])
        # Of the periods of one stretch the smallest counts.
        known = known[np.lexsort((known[:, 3], known[:, 2], known[:, 1]))]
        same = np.concatenate([[False], (np.diff(known[:, 1]) == 0) & (np.diff(known[:, 2]) == 0)])[:len(known)]
        known = known[~same]
        block *= 2
    known[:, 1] -= first[known[:, 0]]
    return known[np.lexsort((known[:, 3], known[:, 1], known[:, 0]))]


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run covers after its first period."""
    keep, upto = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if b > upto:
            keep += words[upto:max(a, upto)]
            upto = b
    return keep + words[upto:]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _by_text(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    counts, found, collapsed = [], [], []
    hashes, first = hash_words(texts)
    for lo, hi in slices(len(texts), np.diff(first), SLICE_WORDS):
        runs = find_runs(hashes[first[lo]:first[hi]], first[lo:hi + 1] - first[lo])
        cut = np.searchsorted(runs[:, 0], np.arange(hi - lo + 1))
        for i, text in enumerate(texts.slice(lo, hi - lo)):
            words = (text.as_py() or "").encode().split()
            own = [(s, length, q) for s, length, q in runs[cut[i]:cut[i + 1], 1:].tolist()
                   if words[s:s + length - q] == words[s + q:s + length]]
            counts.append(len(words))
            found.append([{"start": s, "length": length, "period": q} for s, length, q in own])
            collapsed.append(b" ".join(collapse(words, own)).decode())
    return pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.string())


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    ``collapsed`` has the words that no run covers after its first period, joined by one space. Words are
    ``[^\\x20\\x09-\\x0D]+``, compared byte by byte. A null or empty text has no words and no runs, its collapsed text is empty. Texts of any
    length are taken whole. Runs may overlap; where stretches are equally long all of them are listed. Repeated rows and ids, null
    ids among them, are documents each, in any order. An empty table gives an empty result; other columns are not looked at.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            counts, runs, collapsed = _by_text(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, runs, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeat_some(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, chosen by the CRC of its number, repeats its tail with a period made from that CRC."""
    word = F.filter(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, word).alias("w"))
    parts = parts.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    parts = parts.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    parts = parts.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(
        "w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return parts.select("doc_id", F.when(F.col("n") > 0, turned).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeat_some(table(spark, sf_dir, "documents")))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
