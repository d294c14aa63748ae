"""Running totals against brute force, over cells on several levels."""

import random
import re
from datetime import date, timedelta

import pytest
from ledger_helpers import money, rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlake.functions.prefix import block, dense_ranks, magnitude, openings, range_sums, row_numbers, running_totals, scan_totals

BASE = date(2020, 1, 1)


def facts(n=400, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # A third of the rows share one key and one day, and half of those one document.
        hot = i % 3 == 0
        out.append((i, 1 if hot else rnd.randint(1, 4), BASE if hot else BASE + timedelta(days=rnd.randint(0, 5)), 7 if i % 6 == 0 else rnd.randint(1, 30),
                    money(rnd.randint(-500, 500) / 100)))
    return out


def brute(data, key, order, fold, inclusive=True):
    out = {}
    for r in data:
        before = [x for x in data if key(x) == key(r) and (order(x) <= order(r) if inclusive else order(x) < order(r))]
        out[r[0]] = fold(before)
    return out


@pytest.mark.parametrize("size", [10**6, 4])
def test_running_sum(spark, size):
    data = facts()
    df = spark.createDataFrame(data, "id long, k long, d date, doc long, v decimal(18,2)")
    out = running_totals(df, ["k"], [F.col("d"), F.col("doc"), F.col("id")], {"t": F.col("v")}, {"day": F.col("d")},
                         {"docs": block("doc", size), "doc": F.col("doc"), "ids": block("id", size)})
    want = brute(data, lambda r: r[1], lambda r: (r[2], r[3], r[0]), lambda b: sum(x[4] for x in b))
    assert {r.id: r.t for r in out.collect()} == want


@pytest.mark.parametrize("how,fold", [("max", max), ("min", min)])
def test_running_extreme_without_own_row(spark, how, fold):
    data = facts(200, 2)
    df = spark.createDataFrame(data, "id long, k long, d date, doc long, v decimal(18,2)")
    out = running_totals(df, ["k"], [F.col("d"), F.col("id")], {"t": F.col("v")}, {"day": F.col("d")}, {"ids": block("id", 8)},
                         how=how, inclusive=False)
    want = brute(data, lambda r: r[1], lambda r: (r[2], r[0]), lambda b: fold((x[4] for x in b), default=None), inclusive=False)
    assert {r.id: r.t for r in out.collect()} == want


def test_row_numbers_from_the_largest(spark):
    data = facts(300, 3)
    df = spark.createDataFrame(data, "id long, k long, d date, doc long, v decimal(18,2)")
    out = row_numbers(df, "n", [F.col("v").desc(), F.col("id")], {"size": magnitude("v")}, {"value": F.col("v"), "ids": block("id", 16)},
                      descending=("size", "value"))
    ordered = sorted(data, key=lambda r: (-r[4], r[0]))
    assert {r.id: r.n for r in out.collect()} == {r[0]: i for i, r in enumerate(ordered, 1)}


def test_range_sums(spark):
    data = facts(200, 4)
    rnd = random.Random(5)
    spans = [(i, rnd.randint(1, 5), BASE + timedelta(days=rnd.randint(-2, 4)), BASE + timedelta(days=rnd.randint(-2, 8))) for i in range(60)]
    f = spark.createDataFrame([(r[1], r[2], r[4]) for r in data], "k long, date date, amount decimal(18,2)")
    r = spark.createDataFrame(spans, "rid long, k long, start date, end date")
    got = {x.rid: x.amount for x in range_sums(f, r, ["k"], "rid").collect()}
    for rid, k, lo, hi in spans:
        assert got.get(rid, 0) == sum((x[4] for x in data if x[1] == k and lo <= x[2] <= hi), money(0))


def test_magnitude_is_monotone(spark):
    values = [float(v) for v in (-1e9, -100.5, -1, -0.01, 0, 0.01, 0.5, 1, 2, 99, 100, 1e9)]
    got = [m for _, m in rows(spark.createDataFrame([(v,) for v in values], "v double").withColumn("m", magnitude("v")))]
    assert got == sorted(got)


def test_missing_keys_and_cells_are_counted(spark):
    data = [(1, None, None, 5, 1), (2, None, BASE, 5, 2), (3, 1, None, None, 4), (4, 1, None, 7, 8), (5, 1, BASE, None, 16), (6, None, None, 5, 32)]
    df = spark.createDataFrame(data, "id long, k long, d date, doc long, v long")
    out = running_totals(df, ["k"], [F.col("d"), F.col("doc"), F.col("id")], {"t": F.col("v")}, {"day": F.col("d")}, {"docs": block("doc", 4), "doc": F.col("doc")})
    assert {r.id: r.t for r in out.collect()} == {1: 1, 6: 33, 2: 35, 3: 4, 4: 12, 5: 28}


def test_no_window_exceeds_its_cell(spark):
    """One account and day with a line per document: each window holds the parts of one cell only, and planning starts no job."""
    n = 20_000
    df = spark.range(n).selectExpr("id", "IF(id % 50 = 0, 2, 1) AS account", "date_add(DATE '2020-01-01', IF(id % 70 = 0, 1, 0)) AS date", "id AS move_id", "id % 3 AS v")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    levels = {"documents": block("move_id", 100), "lines": F.struct(F.col("move_id").alias("m"), block("id").alias("l"))}
    out = running_totals(df, ["account"], [F.col("date"), F.col("move_id"), F.col("id")], {"t": F.col("v")}, {"day": F.col("date")}, levels)
    assert not tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("", "")
    plain = Window.partitionBy("account").orderBy("date", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert out.withColumn("want", F.sum("v").over(plain)).filter("t <> want").count() == 0
    parts = re.findall(r"Window \[.*\], \[(_k[^\]]*)\], \[", out.select("t")._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(len(p.split(", ")) for p in parts) == [1, 2, 3, 4] and all("_k" in p for p in parts)


@pytest.mark.parametrize("pieces", [1, 5, 64])
def test_prefix_scan_over_ranges(spark, pieces):
    r = random.Random(4)
    data = [(r.choice([None, 7, r.randint(-50, 50)]), i, r.choice([None, r.randint(0, 9)])) for i in range(500)]
    df = spark.createDataFrame(data, "v int, id long, m int").repartition(7)
    got = {x.id: x.t for x in scan_totals(df, {"v": -F.col("v"), "i": F.col("id")}, F.col("m"), "t", pieces, 40).collect()}
    total = 0
    for v, i, m in sorted(data, key=lambda x: (x[0] is not None, -(x[0] or 0), x[1])):
        total += m or 0
        assert (got[i] or 0) == total
    assert scan_totals(df.filter("id < 0"), {"i": F.col("id")}, F.col("m"), "t").count() == 0


def test_carried_rows_only_add_to_the_others(spark):
    df = spark.createDataFrame([(1, None, 5, 1), (1, 0, 7, 0), (1, 3, 1, 0), (2, 1, 4, 4), (2, None, 2, 0), (3, 0, 9, 9)], "k int, day int, plus int, minus int")
    carried, measure = F.col("day") == 0, (F.col("plus"), F.col("minus"))
    ahead = F.coalesce(carried, F.lit(False))
    run = running_totals(df, ["k"], [F.col("day")], {"t": measure}, {"day": F.col("day")}, {"b": block("plus")}, carried=ahead)
    assert rows(run, "k", "day", "t") == [(1, 3, 12.0), (1, None, 11.0), (2, 1, 2.0), (2, None, 2.0)]
    assert rows(openings(df, ["k"], measure, "t", {"day": F.col("day")}, {"b": block("plus")}, ahead)) == [(1, 7, 0), (3, 9, 9)]


def test_totals_share_the_shuffle_of_the_rows(spark):
    """The same totals, with missing keys and cells and carried rows, also where rows are dealt out once for both."""
    df = spark.createDataFrame([(i, i % 3 or None, i % 5 or None, i % 7, i) for i in range(200)], "id long, k int, day int, doc long, v long")
    carried = F.col("day") == 2
    plain = Window.partitionBy("k").orderBy(~F.coalesce(carried, F.lit(False)), "day", "doc", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = rows(df.withColumn("t", F.sum("v").over(plain)).filter(~F.coalesce(carried, F.lit(False))))
    for whole in (False, True):
        run = running_totals(df, ["k"], [F.col("day"), F.col("doc"), F.col("id")], {"t": F.col("v")}, {"day": F.col("day")},
                             {"docs": block("doc", 3), "ids": F.struct("doc", block("id", 16).alias("b"))}, carried=carried, whole=whole)
        assert rows(run) == want


def test_dense_ranks(spark):
    df = spark.createDataFrame([(n,) for n in ["b", "a", "", None, "b", "\u00e9", "ab", "Z"]], "n string")
    assert rows(dense_ranks(df, "n", "r"), "r", "n") == [(1, ""), (2, "Z"), (3, "a"), (4, "ab"), (5, "b"), (6, "\u00e9")]


def test_numbers_by_document(spark):
    from ledgerlake.functions.prefix import document_numbers
    rnd = random.Random(8)
    # Blocks of documents on both sides of a bound, a day with half of the documents, one without a day and one with two days; a long document.
    documents = {m: None if m == 5 else BASE + timedelta(days=rnd.choice([0, 0, 0, 1, 2, 40])) for m in [*range(20), *range(65_530, 65_550)]}
    data = [(m, i, d, f"x{i}") for m, d in documents.items() for i in range(300 if m == 7 else rnd.randint(1, 4))] + [(9, i, BASE - timedelta(days=1), "y") for i in range(3)]
    df = spark.createDataFrame(data, "doc long, id long, d date, t string")
    want = sorted(data, key=lambda r: (r[2] or date.min, r[0], r[1]), reverse=True)
    out = document_numbers(df, "n", "d", "doc", "id")
    assert out.columns == [*df.columns, "n"]
    assert [tuple(r) for r in out.orderBy("n").collect()] == [(*r, n) for n, r in enumerate(want, 1)]
    assert document_numbers(df.filter("id < 0"), "n", "d", "doc", "id").count() == 0
