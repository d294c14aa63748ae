"""Fingerprints of word shingles, computed on whole arrays."""

import hashlib

import numpy as np

SHINGLE = 5
_rng = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a lower-cased text, in order."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = (p[:len(data) + 1] for p in _powers_to(len(data) + 1))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """A hash for each run of ``width`` words; with fewer words, one for all of them."""
    n = len(words)
    width = min(width, n)
    if not n:
        return words
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += words[i:n - width + 1 + i] * _PLACE[i]
    return mix(total)


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The set of shingle fingerprints of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), width))


def sequence_digest(text: bytes) -> bytes:
    """16 bytes that stand for the sequence of lower-cased words."""
    return hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest()


def exact_overlap(a: bytes, b: bytes, width: int = SHINGLE) -> tuple[int, int, int]:
    """Sizes of the two shingle sets and of their intersection, decided on the words themselves."""
    sets = []
    for words in (a.lower().split(), b.lower().split()):
        sets.append(set(zip(*(words[i:] for i in range(width)))) if len(words) >= width else {tuple(words)} if words else set())
    x, y = sets
    return len(x), len(y), len(x & y)


def parities(prints: np.ndarray) -> bytes:
    """Which of some 4 to 8 times as many places an odd number of the fingerprints of a set falls on, as bits; the width is a power of two.

    What two sets share cancels out, so that only members of one of them can share a place, and sets which differ by a little more than they may are told apart.
    """
    if not len(prints):
        return b""
    power = len(prints).bit_length() + 2
    return np.packbits((np.bincount((prints >> np.uint64(64 - power)).astype(np.int64), minlength=1 << power) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A sketch of at least ``width`` bytes, as one of that width: neighbouring places are added up."""
    own = np.frombuffer(bits, np.uint8)
    return own if len(own) == width else np.packbits(np.bitwise_xor.reduce(np.unpackbits(own).reshape(width * 8, -1), axis=1))


def least_difference(a: bytes, b: bytes) -> int:
    """In how many members two sets differ at least: a place with an odd number in only one of them holds a member of only one."""
    width = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, width) ^ folded(b, width)).sum())
