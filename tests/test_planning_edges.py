"""Schedules, depreciation, budgets and fiscal years on hand-made rows."""

from datetime import date

from ledger_helpers import day, money, rows
from pyspark.sql import functions as F

from ledgerlake.functions import periods as pd
from ledgerlake.operators import planning as op

ASSET = ("id long, date date, value decimal(18,2), salvage decimal(18,2), method string, method_time string, method_number int, method_period int, "
         "method_end date, factor decimal(4,2), prorata boolean")


def asset(i, on, value, method="linear", n=3, period=1, prorata=False, end=None, salvage=0, factor=0.3):
    return (i, day(on), money(value), money(salvage), method, "end" if end else "number", n, period, day(end), money(factor), prorata)


def board(spark, *assets, **kw):
    return op.depreciation_board(spark.createDataFrame(list(assets), ASSET), **kw)


def amounts(df, i=1):
    return [(r.date.isoformat(), float(r.amount)) for r in df.filter(F.col("asset_id") == i).orderBy("sequence").collect()]


def test_schedule_keeps_the_clamped_day(spark):
    templates = spark.createDataFrame([(1, day("2023-01-31"), day("2023-05-01"), "months", 1), (2, day("2020-02-29"), day("2024-03-01"), "years", 1),
                                       (3, day("2023-01-01"), day("2023-01-01"), "days", 1), (4, day("2023-01-01"), day("2023-01-16"), "weeks", 1)],
                                      "id long, date_begin date, date_end date, period string, interval int")
    got = rows(op.recurring_dates(templates), "id", "date")
    assert [d.isoformat() for i, d in got if i == 1] == ["2023-01-31", "2023-02-28", "2023-03-28", "2023-04-28"]
    assert [d.isoformat() for i, d in got if i == 2] == ["2020-02-29", "2021-02-28", "2022-02-28", "2023-02-28", "2024-02-28"]
    assert [i for i, _ in got if i == 3] == [] and [d.day for i, d in got if i == 4] == [1, 8, 15]
    today = rows(op.recurring_dates(templates, day("2023-01-01")).filter("id = 3"), "date")
    assert today == [(day("2023-01-01"),)]


def test_linear_board_rounds_and_closes(spark):
    df = board(spark, asset(1, "2020-01-17", 100), asset(2, "2020-01-17", 100, period=12))
    assert amounts(df) == [("2020-01-01", 33.33), ("2020-02-01", 33.33), ("2020-03-01", 33.34)]
    assert [d for d, _ in amounts(df, 2)] == ["2020-01-01", "2021-01-01", "2022-01-01"]


def test_prorata_first_period(spark):
    df = board(spark, asset(1, "2020-01-17", 310, n=1, prorata=True), asset(2, "2020-07-02", 366, n=1, period=12, prorata=True))
    assert amounts(df) == [("2020-01-17", 150.0), ("2020-02-17", 160.0)]
    assert amounts(df, 2) == [("2020-07-02", 183.0), ("2021-07-02", 183.0)]


def test_degressive_end_date_and_zero_amounts(spark):
    df = board(spark, asset(1, "2020-01-05", 100, "degressive"), asset(2, "2020-01-31", 50, end="2020-03-15"), asset(3, "2020-01-01", 0.01, n=3), asset(4, "2020-01-01", 10, salvage=10))
    assert [a for _, a in amounts(df)] == [30.0, 21.0, 49.0]
    assert [d for d, _ in amounts(df, 2)] == ["2020-01-01", "2020-02-01", "2020-03-01"]
    assert amounts(df, 3) == [("2020-01-01", 0.01)]  # empty periods leave out line and date step
    assert amounts(df, 4) == []


def test_fiscal_year_closing_in_june(spark):
    df = board(spark, asset(1, "2020-03-10", 90, period=12), asset(2, "2020-06-21", 365, n=1, period=12, prorata=True), last_month=6, last_day=30)
    assert amounts(df)[0][0] == "2020-07-01"
    assert amounts(df, 2)[0][1] == round(365 * 10 / 366, 2)


def test_board_adds_up(spark):
    data = [asset(i, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d}", 1000 + i, "linear" if i % 2 else "degressive", 2 + i % 9, (1, 3, 12)[i % 3], i % 4 == 0, salvage=i % 5) for i in range(1, 60)]
    totals = board(spark, *data).groupBy("asset_id").agg(F.sum("amount").alias("s")).collect()
    assert {r.asset_id: float(r.s) for r in totals} == {a[0]: float(a[2] - a[3]) for a in data}


def test_theoretical_budget(spark):
    line = lambda i, lo, hi, paid=None: (i, day(lo), day(hi), day(paid), money(100))
    df = spark.createDataFrame([line(1, "2020-07-01", "2020-07-31"), line(2, "2020-06-01", "2020-06-30"), line(3, "2020-06-20", "2020-07-10"), line(4, "2020-06-30", "2020-06-30"),
                                line(5, "2020-01-01", "2020-12-31", "2020-06-30"), line(6, "2020-01-01", "2020-12-31", "2020-06-29")],
                               "id long, date_from date, date_to date, paid_date date, planned decimal(18,2)")
    got = dict(rows(op.theoretical_amounts(df, date(2020, 6, 30)), "id", "theoretical_amount"))
    assert got == {1: 0.0, 2: 100.0, 3: 50.0, 4: 100.0, 5: 0.0, 6: 100.0}
    by_days = dict(rows(op.theoretical_amounts(df, date(2020, 6, 30), count_days=True), "id", "theoretical_amount"))
    assert by_days[3] == round(100 * 11 / 21, 6) and by_days[6] == 100.0


def test_fiscal_year_overlaps(spark):
    year = lambda i, c, lo, hi: (i, c, day(lo), day(hi))
    df = spark.createDataFrame([year(1, 1, "2020-01-01", "2020-12-31"), year(2, 1, "2020-12-31", "2021-12-30"), year(3, 1, "2022-01-01", "2022-12-31"),
                                year(4, 2, "2020-06-01", "2020-06-30"), year(5, 2, "2020-01-01", "2022-01-01"), year(6, 2, "2021-03-01", "2021-04-01"), year(7, 1, "2025-02-01", "2025-01-01")],
                               "id long, company_id long, date_from date, date_to date")
    assert rows(op.fiscal_year_violations(df), "key", "rule") == [("1", "overlap"), ("2", "overlap"), ("4", "overlap"), ("5", "overlap"), ("6", "overlap"), ("7", "end_before_start")]


def test_periods():
    today = date(2020, 5, 20)
    kind = lambda a, b: pd.classify(day(a), day(b), today, 6, 30)
    assert [kind("2020-02-01", "2020-02-29"), kind("2020-04-01", "2020-06-30"), kind("2020-01-01", "2020-12-31"), kind("2020-05-01", "2020-05-20"),
            kind("2019-07-01", "2020-06-30"), kind("2020-01-02", "2020-01-05")] == ["month", "quarter", "year", "today", "fiscal year", "custom"]
    q = pd.period(day("2020-01-01"), day("2020-03-31"), today)
    assert [p.label for p in pd.earlier(q, 2)] == ["Q4 2019", "Q3 2019"]
    feb = pd.period(day("2020-02-01"), day("2020-02-29"), today)
    assert [(p.start.isoformat(), p.end.isoformat()) for p in pd.same_last_year(feb, 2)] == [("2019-02-01", "2019-02-28"), ("2018-02-01", "2018-02-28")]
