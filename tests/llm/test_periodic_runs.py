import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from text_data import SF, awkward, frame

from ledgerlake.llm.periodic_runs import PRIME, collapse, find_runs, op13_periodic_runs, periodic_runs, transform
from ledgerlake.llm.word_arrays import hash_words


def brute(words):
    """Runs by comparing every word with every other: (start, length, period)."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_words(text):
    return (text or "").encode().split()


def dropped(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def periodic_texts():
    r = random.Random(7)
    texts = [["x"] * 2000, ["a", "b"] * 700 + ["c"] * 500, ["x"] * 23, ["x"] * 24, ["a", "b", "c", "d", "e", "f", "g"] * 3 + ["a", "b"], list("abcdefgh") * 3]
    for _ in range(120):
        words = [f"w{r.randrange(r.choice([1, 2, 3, 60]))}" for _ in range(r.randint(0, 400))]
        for _ in range(r.randint(0, 3) if len(words) > 30 else 0):
            a = r.randrange(len(words))
            p = r.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a, min(len(words), a + r.randint(0, 300))):
                words[i] = words[a + (i - a) % p]
        texts.append(words)
    return [" ".join(w) for w in texts]


@pytest.mark.parametrize("size", [2, 8, 64])
def test_transform_is_an_exact_cyclic_convolution(size):
    a, b = np.random.default_rng(1).integers(0, PRIME, (2, size, 3), dtype=np.uint64)
    product = transform(transform(a) * transform(b) % np.uint64(PRIME), inverse=True)
    for c in range(3):
        want = [sum(int(a[i, c]) * int(b[(k - i) % size, c]) for i in range(size)) * size % PRIME for k in range(size)]
        assert product[:, c].tolist() == want


def test_runs_against_brute_force():
    texts = periodic_texts()
    hashes, first = hash_words(pa.array(texts))
    got = find_runs(hashes, first).tolist()
    for i, text in enumerate(texts):
        assert [(s, n, q) for d, s, n, q in got if d == i] == brute(text.split())
    assert got


def test_collapse():
    words = list(range(60))
    assert collapse(words, []) == words
    assert collapse(words, [(0, 30, 5), (10, 24, 8), (40, 24, 2)]) == [0, 1, 2, 3, 4, *range(34, 42)]


def test_awkward_rows(spark):
    rows = awkward() + list(enumerate(periodic_texts(), 1000)) + [(None, "a " * 40), (5, "a " * 40), (5, "a " * 40)]
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame(spark, rows)).collect())
    want = []
    for i, text in rows:
        words = plain_words(text)
        runs = brute(words) if len(words) < 3000 else []
        want.append((str(i), len(words), runs, dropped(words, runs)))
    assert got == sorted(want)


def test_empty_table(spark):
    assert periodic_runs(frame(spark, [])).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(docs)
    for r in got:
        words, h = plain_words(docs[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(dropped(words, runs).encode()).hexdigest()
    assert sum(r.n_runs for r in got) > 10
