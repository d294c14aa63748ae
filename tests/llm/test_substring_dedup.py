import random

import numpy as np
import pytest
from text_data import awkward, frame, words

from ledgerlake.llm import substring_dedup as module
from ledgerlake.llm.substring_dedup import Firsts, rolling, substring_dedup


def brute(rows, window):
    """(id, n_words, removed words, kept text) per row, from a table of all windows."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k:k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r.doc_id, r.n_words, sum(s.length for s in r.removed), r.kept) for r in df.collect()), key=str)


def passages():
    """Documents around passages of 48 to 52 words, shifted, nested and in few different words."""
    r = random.Random(11)
    shared = [words(700 + n, n) for n in (48, 49, 50, 51, 52, 120)]
    rows = []
    for i in range(60):
        parts = [words(800 + i * 10 + j, r.randint(0, 60)) for j in range(3)]
        rows.append((400 + i, " ".join([parts[0], r.choice(shared), parts[1], r.choice(shared), parts[2]])))
    rows += [(500 + i, " ".join(r.choice("ab") for _ in range(r.randint(0, 150)))) for i in range(30)]
    rows += [(600 + i, "x " * (40 + 7 * i)) for i in range(10)]
    return rows


def test_rolling_hash_depends_on_the_stretch_alone():
    w = np.random.default_rng(1).integers(0, 2**64, 200, dtype=np.uint64)
    w[100:160] = w[20:80]
    for width in (1, 2, 5, 25, 31):
        h = rolling(w, width)
        assert len(h) == 200 - width + 1 and (h[100:161 - width] == h[20:81 - width]).all()
        assert len(np.unique(h)) == len(h) - (61 - width)
    assert len(rolling(w[:3], 5)) == 0


def test_firsts_are_merged_as_they_come(monkeypatch):
    monkeypatch.setattr(module, "COMPACT", 10)
    f, r = Firsts(), np.random.default_rng(2)
    prints, docs = r.integers(0, 50, 500).astype(np.uint64), r.integers(0, 90, 500)
    for i in range(0, 500, 7):
        f.add(prints[i:i + 7], np.zeros(len(prints[i:i + 7]), np.uint16), docs[i:i + 7])
    hit = f.earlier(prints, np.zeros(500, np.uint16), docs)
    least = {p: docs[prints == p].min() for p in prints}
    assert hit.tolist() == [i for i in range(500) if least[prints[i]] < docs[i]]


@pytest.mark.parametrize("window", [50, 7, 2])
def test_awkward_rows(spark, window):
    rows = awkward() + passages() + [(None, awkward()[9][1]), (10, awkward()[9][1]), (10, words(1, 60)), (9999, awkward()[9][1])]
    assert plain(substring_dedup(frame(spark, rows).repartition(3), window=window)) == brute(rows, window)


def test_packs_of_few_documents(spark, monkeypatch):
    monkeypatch.setattr(module, "PACK_ENTRIES", 20)
    monkeypatch.setattr(module, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(module, "BUCKET_WINDOWS", 300)
    monkeypatch.setattr(module, "GROUP_BYTES", 9000)
    monkeypatch.setattr(module, "COMPACT", 50)
    rows = awkward() + passages()
    assert plain(substring_dedup(frame(spark, rows).repartition(3))) == brute(rows, 50)


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
