import math
import re
from collections import Counter

import numpy as np
import pytest
from text_data import awkward, frame, words

from ledgerlake.llm import lexical_search
from ledgerlake.llm.lexical_search import best, blocks, nra, ranked_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERIES = "item_id long, text string, doc_id long, score string, term int, query int, rank string"


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, k):
    """(item, rank, doc, score) with every document scored for every query."""
    counted = [(i, Counter(t), len(t)) for i, t in ((i, plain_terms(text)) for i, text in docs)]
    n, length = sum(m > 0 for _, _, m in counted), sum(m for _, _, m in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c, m in counted:
            if i is None:
                continue
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * m * n // length)))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def asked():
    return [(1, words(2, 30)), (2, None), (3, ""), (4, "no such term 4711"), (5, "one ONE two same"), (6, "ünï Àé x"), (7, words(1, 120)), (7, "same"),
            (None, "a b c"), (9, "one " * 50)]


def plain(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def query_frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "s", 1, 2, "r") for i, t in rows], QUERIES)


def test_terms():
    text = "A-b_Ç9 x y\t€Z/:@[`{\x7f0"
    assert [w.decode() for piece in terms(text) for w in piece] == plain_terms(text)
    assert list(terms(None)) == [] and [w for piece in terms("") for w in piece] == []


def test_terms_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE", 10)
    text = words(4, 500) + " " + "x" * 100
    assert [w.decode() for piece in terms(text) for w in piece] == plain_terms(text)


@pytest.mark.parametrize("first_read", [1, 7, 64])
def test_search_loop_with_ties(monkeypatch, first_read):
    monkeypatch.setattr(lexical_search, "FIRST_READ", first_read)
    r = np.random.default_rng(3)
    for trial in range(60):
        n, k = int(r.integers(1, 400)), int(r.integers(1, 25))
        full, lists = np.zeros(n, np.int64), []
        for _ in range(int(r.integers(1, 9))):
            places = r.choice(n, int(r.integers(1, n + 1)), replace=False)
            impacts = np.sort(r.integers(1, (3, 50, 1000)[trial % 3], len(places)))[::-1]
            full[places] += impacts
            lists.append((places, impacts))
        ids, any_ = r.permutation(n), np.flatnonzero(full)
        places, scores = nra(lists, n, k, 1)
        assert (full[places] == scores).all()
        assert [x.tolist() for x in best(ids[places], scores, k)] == [x.tolist() for x in best(ids[any_], full[any_], k)]


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 5)
    found = list(blocks([(1, "a b c"), (2, "c d e"), (3, "f"), (4, "g h i j k l m"), (5, None)]))
    assert [[key for key, _ in b] for b in found] == [[1, 2], [3], [4], [5]]


@pytest.mark.parametrize("segment, block, cells", [(1 << 22, 1 << 16, 1 << 26), (3000, 40, 300)])
def test_awkward_rows(spark, monkeypatch, segment, block, cells):
    for name, value in (("SEGMENT_WORDS", segment), ("BLOCK_TERMS", block), ("CELLS", cells)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = awkward() + [(None, "one two three"), (16, "same"), (300, "One, two; THREE ünï")]
    got = plain(ranked_search(frame(spark, docs).repartition(3), query_frame(spark, asked()), 5))
    assert got == sorted(brute(docs, asked(), 5), key=str)


def test_empty_tables(spark):
    assert ranked_search(frame(spark, []), query_frame(spark, asked()), 5).count() == 0
    assert ranked_search(frame(spark, [(1, None), (2, " ")]), query_frame(spark, asked()), 5).count() == 0
    assert ranked_search(frame(spark, awkward()), query_frame(spark, []), 5).count() == 0
