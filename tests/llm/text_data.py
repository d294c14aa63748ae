"""Small inputs with awkward rows, and plain reference computations."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _part string, cls int, norm string, n int, rep string, tree int, _kept int"
SF = "/root/testdata/sf0.001"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple[int, str | None]]:
    """Null, empty, blank, short and very long texts, ties, copies, near copies and a passage that many share."""
    base, passage = words(1, 120), words(2, 60)
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "One"), (6, "one two three"), (7, "one  two\nthree"), (8, "Ünï ÀÉ ß"), (9, "ünï àé ß"),
            (10, base), (11, base.upper()), (12, base + " tail"), (13, " ".join(base.split()[3:])), (14, words(3, 9000)), (15, words(3, 9000) + " x"),
            (16, "same"), (17, "same"), (18, "same"), (19, "!!! ... 123"), (20, "a b c d e"), (21, "a b c d e f"), (22, "x" * 50_000)]
    rows += [(100 + i, words(50 + i, 40) + " " + passage + " " + words(90 + i, 40)) for i in range(15)]
    near = base.split()
    rows += [(200 + i, " ".join(near[:i * 3] + [f"w{i}"] + near[i * 3 + 1:])) for i in range(15)]
    return rows


def frame(spark, rows: list[tuple[int | None, str | None]], lang: str | None = "en"):
    """A documents table with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "p", 1, "n", 2, "r", 3, 4) for i, t in rows], DOCS)


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def classes(rows: list[tuple[int, str | None]], num: int = 75, den: int = 100) -> dict[int, tuple[int, int]]:
    """doc_id -> (size of the shingle set, smallest linked doc_id), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}
