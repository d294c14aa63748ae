import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm.topk_search import products, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, tree string, v int"


def brute(rows, k, step):
    best = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        best[i] = max(best.get(i, w), w)
    out = set()
    for q in (i for i in best if i % step == 0):
        scored = sorted((-sum(a * b for a, b in zip(best[q], best[i])), i) for i in best if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def found(spark, rows, k, step, **sizes):
    df = spark.createDataFrame([(i, v, 1, "t", 2) for i, v in rows], SCHEMA)
    return {tuple(r) for r in top_k(df, F.col("vec_id") % step == 0, k, **sizes).collect()}


@pytest.mark.parametrize("sizes", [{"tree_size": 40, "page_size": 8}, {"tree_size": 1000, "page_size": 16}])
def test_against_all_pairs(spark, sizes):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, .2) for c in centres[i % 5]]) for i in range(220)]
    rows += [(1000 + i, [1.0] * 6) for i in range(60)]  # one vector many times: ties
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (2004, [])]
    rows += [(2005, [5.0] * 3), (0, [9.0] * 6), (0, [9.0] * 6)]  # a short one; repeated identifiers
    assert found(spark, rows, 7, 20, **sizes) == brute(rows, 7, 20)


def test_few_rows_and_none(spark):
    assert found(spark, [], 5, 1) == set()
    assert found(spark, [(1, [1.0, 0.0])], 5, 1) == set()
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.5])]
    assert found(spark, rows, 20, 1) == brute(rows, 20, 1)


def test_large_components_stay_exact():
    import numpy as np
    v, q = np.array([[2.0**40, 3.0], [2.0**62, 1.0]]), np.array([2.0**20 + 1, 7.0])
    assert products(v, q).tolist() == [2**40 * (2**20 + 1) + 21, 2**63 - 1]
