import random

import numpy as np
import pytest
from text_data import SF, awkward, classes, frame, shingles, words

from ledgerlake.llm import components as stars
from ledgerlake.llm import ngram_join
from ledgerlake.llm.components import components
from ledgerlake.llm.ngram_join import ENTRY, PROBE2, SEGMENTS, SIMILARITY, SPARE, shared_rows, signature_rows, similar_classes
from ledgerlake.llm.shingles import exact_overlap, least_difference, parities, shingle_set


def plain(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.select("doc_id", "n_shingles", "component_id").collect()}


# (100, 1): so few segments that most bands are run again with the empty ones.
@pytest.mark.parametrize("plenty", [SEGMENTS, (100, 1)])
def test_awkward_rows(spark, plenty):
    rows = awkward()
    assert plain(similar_classes(frame(spark, rows).repartition(4), plenty=plenty)) == classes(rows)


@pytest.mark.parametrize(("similarity", "seed"), [((75, 100), 1), ((60, 100), 2), ((9, 10), 3)])
def test_texts_around_the_threshold(spark, similarity, seed):
    r, rows = random.Random(seed), []
    for g in range(12):
        base = words(g + 1000 * seed, r.choice([6, 8, 12, 20, 33, 70, 150])).split()
        for _ in range(7):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 30))):
                at = r.randrange(len(own))
                own[at:at + r.choice([0, 1])] = [f"n{r.randrange(50)}"] * r.choice([0, 1])
            rows.append((len(rows), " ".join(own)))
    assert plain(similar_classes(frame(spark, rows), similarity=similarity)) == classes(rows, *similarity)


def test_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert plain(similar_classes(docs)) == classes([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_table_and_repeated_rows(spark):
    assert similar_classes(frame(spark, [])).count() == 0
    got = similar_classes(frame(spark, [(1, "a b"), (1, "a b"), (2, "A b"), (None, "a b"), (None, "z"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 1)]


def test_repeated_doc_ids_with_different_texts(spark):
    """Document 1 is the smallest of two classes with links of their own; each row comes out once."""
    a, b = words(7, 60), words(8, 60)
    rows = [(1, a), (1, b), (5, a + " x"), (6, b + " y"), (7, words(9, 60)), (0, b + " y z")]
    got = similar_classes(frame(spark, rows)).collect()
    plain_rows = classes([(i, t) for i, (_, t) in enumerate(rows)])  # by place
    least = {c: min(rows[i][0] for i in plain_rows if plain_rows[i][1] == c) for _, c in plain_rows.values()}
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((rows[i][0], n, least[c]) for i, (n, c) in plain_rows.items())


def test_a_text_without_doc_id_links_two_others(spark):
    # 40 shingles; the ends differ by more than a quarter, each end from the middle by less.
    w = words(11, 60).split()
    rows = [(8, " ".join(w[:44])), (None, " ".join(w[5:49])), (9, " ".join(w[10:54])), (None, "alone here")]
    by_place = classes([(i, t) for i, (_, t) in enumerate(rows)])
    assert [c for _, c in by_place.values()] == [0, 0, 0, 3] and classes([(8, rows[0][1]), (9, rows[2][1])])[9][1] == 9
    got = similar_classes(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 8), (8, 8), (9, 8)]


def test_pigeonhole_budgets_cover_every_pair():
    """A probe of each larger set meets an entry of each similar smaller one, whichever units are spared."""
    r = random.Random(8)
    for n in (1, 3, 4, 7, 13, 40, 90, 300):
        x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        for cut in range((n - -(-3 * n // 4)) + 1):
            y = np.delete(x, r.sample(range(n), cut))
            rows = {i: signature_rows([s], np.array([i]), SIMILARITY, None) for i, s in ((1, x), (2, y))}
            flat = {i: [(int(k), int(w) & 7, int(u)) for a, b, c in v for k, w, u in zip(a, b, c)] for i, v in rows.items()}
            entries = {k for k, kind, _ in flat[2] if kind in (0, 1)}
            low = n.bit_length() != len(y).bit_length()
            single = [(k, u) for k, kind, u in flat[1] if kind == (3 if low else 0)]
            double = [(k, u) for k, kind, u in flat[1] if kind == (4 if low else 2)]
            [spare] = [u for _, kind, u in flat[1] if kind == SPARE + low]
            assert spare >= 0 or n > 1
            # Give up as many of the hitting units as may be spared: some must be left.
            hits = sum(k in entries for k, _ in single) + len({u for k, u in double if k in entries} | {u for k, u in single if u >= 0 and k in entries})
            assert spare < 0 or hits > spare


def test_overlap_on_words_and_fingerprints():
    texts = [t or "" for _, t in awkward()]
    for a in texts[:14]:
        for b in texts[4:20:3]:
            x, y = shingles(a), shingles(b)
            assert exact_overlap(a.encode(), b.encode()) == (len(x), len(y), len(x & y))
            assert len(shingle_set(a.encode())) == len(x)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (60, 59)]
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketches_are_small_and_bound_the_difference():
    r = random.Random(5)
    for n in (1, 2, 7, 60, 127, 128, 500, 3000):
        x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        for cut, more in ((0, 0), (n // 7, n // 7), (n // 3, 0), (0, n), (n, 5)):
            y = np.unique(np.concatenate([np.delete(x, r.sample(range(n), cut)), np.array([r.getrandbits(64) for _ in range(more)], np.uint64)]))
            apart = len(np.setxor1d(x, y))
            if len(y):
                least = least_difference(parities(x), parities(y))
                assert least == least_difference(parities(y), parities(x)) <= apart and (apart > n // 3 or least >= 0.7 * apart - 3)
        assert len(parities(x)) <= max(n, 1)


def test_rows_of_copies_in_other_tasks_are_told_once(spark):
    """Key 1: entries of classes 5 and 6, told by two tasks each; key 2: one class only; the spare counts always stay, once."""
    told = [(1, 5 << 3 | ENTRY, -1), (1, 6 << 3 | ENTRY, -1), (1, 6 << 3 | PROBE2, 3), (2, 5 << 3 | ENTRY, -1), (5, 5 << 3 | SPARE, 7)]
    got = shared_rows(spark.createDataFrame(told * 2, "key long, who long, unit int").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(1, 5, ENTRY, -1, 2), (1, 6, ENTRY, -1, 2), (1, 6, PROBE2, 3, 2), (5, 5, SPARE, 7, 0)]


def test_finished_components_and_rounds_without_links_write_nothing(spark, monkeypatch):
    """Every table written is several stages that the driver keeps: none for what is settled already."""
    written = []

    def settle(df, purpose, real=ngram_join.settle):
        written.append(purpose)
        return real(df, purpose)

    monkeypatch.setattr(stars, "settle", settle)
    monkeypatch.setattr(ngram_join, "settle", settle)
    assert {r.u: r.v for r in components(spark.createDataFrame([(2, 1), (3, 1), (9, 8)], "u long, v long")).collect()} == {2: 1, 3: 1, 9: 8}
    assert written == ["links"]
    written.clear()
    rows = [(1, words(1, 60)), (2, words(1, 60) + " x"), (3, words(2, 60))]
    assert plain(similar_classes(frame(spark, rows))) == classes(rows)
    assert written.count("labels") == 1 and written.count("pairs") == ngram_join.HUB_ROUNDS + 1
