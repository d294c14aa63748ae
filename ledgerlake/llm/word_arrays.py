"""Words of whole columns of texts as arrays: one pass over the bytes of many documents, no loop over words."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerlake.llm.shingles import mix

SLICE_BYTES = 1 << 18  # texts are hashed in slices of about this many bytes; a longer text is a slice of its own
_rng = np.random.Generator(np.random.PCG64(20_250_117))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... (n numbers, modulo 2**64)."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_SHORT = powers(_BASE, 256)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row begins and ends (rows + 1 numbers); null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32).astype(np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _hash_slice(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    inside = ~space
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]  # a word never runs on into the next text
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    lengths = stops - starts
    longest = int(lengths.max())
    power = _SHORT if longest <= len(_SHORT) else powers(_BASE, longest)
    before = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(before[-1]) - np.repeat(before[:-1], lengths)
    sums = np.zeros(before[-1] + 1, np.uint64)
    np.cumsum(_BYTE[data[inside]] * power[place], out=sums[1:])
    hashes = mix(sums[before[1:]] - sums[before[:-1]] + lengths.astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word ``[^\\x20\\x09-\\x0D]+`` of all rows, in order, and the number of words before each row (rows + 1 numbers)."""
    data, bounds = text_bytes(column)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    row, words = 0, 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, "right")) - 1)
        upto = min(upto, len(column))
        found, first = _hash_slice(data[bounds[row]:bounds[upto]], bounds[row:upto + 1] - bounds[row])
        hashes.append(found)
        counts.append(first[1:] + words)
        words += len(found)
        row = upto
    return np.concatenate(hashes), np.concatenate(counts)


def slices(rows: int, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``limit`` at most; a larger row is a range of its own."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < rows:
        upto = min(rows, max(row + 1, int(np.searchsorted(total, total[row] + limit, "right")) - 1))
        yield row, upto
        row = upto
