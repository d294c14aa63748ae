"""Hand-made edge rows of the ledger filter, ageing, dunning and statements."""

from datetime import date

import pytest
from ledger_helpers import line, money, rows
from pyspark.sql import functions as F

from ledgerlake.functions.filters import INITIAL, OPEN_START, LedgerFilter
from ledgerlake.functions.labels import bound_labels, ledger_display_name, partner_label, period_labels
from ledgerlake.operators import ledger as gl
from ledgerlake.operators import receivables as rec
from ledgerlake.operators import statements as st
from ledgerlake.functions.periods import Period
from ledgerlake.sources.testbed import NODE_SCHEMA

D = date(2020, 6, 30)


def test_filter_modes(ledger, accounts):
    lines = ledger(
        line(1, 2, "2020-01-01", 10), line(2, 5, "2020-01-01", 0, 10), line(3, 5, "2020-02-01", 0, 5), line(4, 2, "2020-02-01", 5),
        line(5, 2, "2020-02-01", 1, display_type="line_section"), line(6, 2, "2020-02-01", 1, parent_state="cancel"), line(7, 2, "2020-02-02", 1, parent_state="draft"))
    start = date(2020, 1, 15)
    ids = lambda where: [r[0] for r in rows(where.apply(lines, accounts), "id")]
    assert ids(LedgerFilter(date_from=start)) == [3, 4, 7]
    assert ids(LedgerFilter(date_from=start, mode=INITIAL)) == [1, 2]
    assert ids(LedgerFilter(date_from=start, mode=OPEN_START)) == [1, 3, 4, 7]
    assert ids(LedgerFilter(state="posted", date_from=start)) == [3, 4]
    assert ids(LedgerFilter(date_to=date(2020, 1, 1))) == [1, 2]


def test_filter_reconcile_date(ledger, partials, accounts):
    lines = ledger(line(1, 2, "2020-01-01", 10), line(2, 2, "2020-01-01", 10, reconciled=True), line(3, 2, "2020-01-01", 10, reconciled=True))
    links = partials((2, 90, 10, "2020-03-01"), (3, 91, 10, "2020-03-02"))
    kept = LedgerFilter(reconcile_date=date(2020, 3, 1)).apply(lines, accounts, links)
    assert [r[0] for r in rows(kept, "id")] == [1, 3]


def test_trial_balance_display(ledger, accounts):
    lines = ledger(line(1, 2, "2020-01-01", 10), line(2, 2, "2020-01-02", 0, 10), line(3, 5, "2020-01-02", 0, 4))
    shown = {c: [r[0] for r in rows(gl.trial_balance(lines, accounts, LedgerFilter(), c), "account_id")] for c in ("all", "movement", "not_zero")}
    assert shown["all"] == list(range(1, 9)) and shown["movement"] == [2, 5] and shown["not_zero"] == [5]


def test_general_ledger_opening_row_and_running_balance(ledger, accounts, journals, partners):
    lines = ledger(line(1, 2, "2019-12-31", 100), line(2, 2, "2020-01-01", 10, move_id=9), line(3, 2, "2020-01-01", 0, 3, move_id=4), line(4, 5, "2020-02-01", 0, 1))
    where = LedgerFilter(date_from=date(2020, 1, 1), date_to=D)
    out = gl.general_ledger(lines, accounts, journals, where, partners, initial_balance=True)
    assert rows(out, "account_id", "line_id", "date", "running_balance") == [
        (2, 0, None, 100.0), (2, 2, date(2020, 1, 1), 107.0), (2, 3, date(2020, 1, 1), 97.0), (5, 4, date(2020, 2, 1), -1.0)]
    not_zero = gl.general_ledger(lines.filter("id <> 4"), accounts, journals, LedgerFilter(date_from=date(2021, 1, 1)), partners, True, show="not_zero")
    assert rows(not_zero, "account_id", "name", "running_balance") == [(2, "Initial Balance", 107.0)]


def test_trial_balance_identities(ledger, accounts):
    lines = ledger(line(1, 2, "2019-05-01", 100), line(2, 5, "2019-05-01", 0, 100), line(3, 2, "2020-02-01", 7), line(4, 5, "2020-02-01", 0, 7))
    plain = rows(gl.trial_balance_periods(lines, accounts, date(2020, 1, 1), D), "name", "initial_balance", "balance", "ending_balance")
    assert plain == [("Receivable", 100.0, 7.0, 107.0), ("SUBTOTAL", 0.0, 0.0, 0.0), ("Sales", -100.0, -7.0, -107.0)]
    carried = rows(gl.trial_balance_periods(lines, accounts, date(2020, 1, 1), D, carry_profit_to="equity_unaffected"), "name", "initial_balance")
    assert carried == [("Current year earnings", -100.0), ("Receivable", 100.0), ("SUBTOTAL", 0.0), ("Sales", 0.0)]


def aged(ledger_df, accounts, partial_df, partners, **more):
    return rec.aged_balance(ledger_df, accounts, partial_df, partners, rec.AgeingParams(asof=D, period=30, **more))


def test_ageing_band_limits(ledger, accounts, partials, partners):
    due = {1: "2020-06-30", 2: "2020-06-29", 4: "2020-05-31", 8: "2020-05-30", 16: "2020-03-02", 32: "2020-03-01"}
    lines = ledger(*[line(i, 2, "2020-01-01", v, date_maturity=d) for i, (v, d) in enumerate(due.items(), 1)], line(9, 2, "2020-06-10", 64))
    row = aged(lines, accounts, partials((0, 0, 0, "2020-01-01")), partners).collect()[0]
    assert [float(row[c]) for c in ("not_due", "period_5", "period_4", "period_3", "period_2", "period_1")] == [1, 2 + 4 + 64, 8, 0, 16, 32]
    assert float(row.total) == 127


def test_ageing_matches_and_unknown_partner(ledger, accounts, partials, partners):
    lines = ledger(
        line(1, 2, "2020-01-01", 100, reconciled=True), line(2, 2, "2020-02-01", 0, 100, reconciled=True),
        line(3, 2, "2020-01-01", 50, partner_id=None), line(4, 2, "2020-01-01", 20, partner_id=3, reconciled=True), line(5, 2, "2020-01-02", 0, 20, partner_id=3, reconciled=True),
        line(6, 2, "2020-01-01", 8, partner_id=2), line(7, 2, "2020-01-01", 0, 8, partner_id=2), line(8, 2, "2020-07-01", 900))
    on_the_day = partials((1, 2, 100, "2020-06-30"), (4, 5, 20, "2020-06-30"))
    assert rows(aged(lines, accounts, on_the_day, partners), "partner_name", "total") == [("Unknown Partner", 50.0)]
    next_day = partials((1, 2, 60, "2020-06-30"), (1, 2, 40, "2020-07-01"), (4, 5, 20, "2020-07-01"))
    got = rows(aged(lines, accounts, next_day, partners), "partner_name", "total")
    assert got == [("Unknown Partner", 50.0)]  # both sides stay open by 40 and 20 and cancel out per partner
    detail = rows(rec.aged_lines(lines, accounts, next_day, rec.AgeingParams(asof=D)), "line_id", "amount")
    assert (1, 40.0) in detail and (2, -40.0) in detail and (4, 20.0) in detail


def test_ageing_buckets_with_limits(ledger, accounts, partials, partners):
    lines = ledger(*[line(i, 2, "2019-01-01", 1, date_maturity=m) for i, m in enumerate(["2020-06-30", "2020-06-29", "2020-06-20", "2020-06-19", "2019-01-01"], 1)])
    out = rec.aged_buckets(lines, accounts, partials((0, 0, 0, "2020-01-01")), partners, rec.AgeingParams(asof=D), [10, 20, 30, 40, 50], with_total=False)
    assert [float(out.first()[f"range_{i}"]) for i in range(7)] == [1, 2, 1, 0, 0, 0, 1]
    assert bound_labels([10, 20, 30, 40, 50]) == ["Not Due", "1 - 10", "11 - 20", "21 - 30", "31 - 40", "41 - 50", "50 +"]
    assert period_labels(30) == ["1-30", "31-60", "61-90", "91-120", "+120"]


def test_dunning_levels(spark, ledger, accounts):
    levels = spark.createDataFrame([(7, 15, "a"), (3, 45, "b"), (5, 90, "c")], "id long, delay int, description string")
    lines = ledger(
        line(1, 2, "2020-01-01", 1, date_maturity="2020-06-15"), line(2, 2, "2020-01-01", 1, date_maturity="2020-06-16"),
        line(3, 2, "2020-05-16", 1, followup_line_id=7), line(4, 2, "2020-05-17", 1, followup_line_id=7),
        line(5, 2, "2000-01-01", 1, followup_line_id=5), line(6, 2, "2000-01-01", 0, 1), line(7, 2, "2000-01-01", 1, full_reconcile_id=4))
    out = rec.dunning_escalation(lines, accounts, levels, D)
    assert rows(out, "line_id", "next_level") == [(1, 7), (3, 3)]
    moved = rows(rec.apply_escalation(lines, out, D).filter("id < 5"), "id", "followup_line_id", "followup_date")
    assert moved == [(1, 7, D), (2, None, None), (3, 3, D), (4, 7, None)]


def test_search_counts_partners_without_lines(ledger, accounts, partners):
    lines = ledger(line(1, 2, "2020-01-01", 10), line(2, 2, "2020-01-01", 30, partner_id=2, full_reconcile_id=9))
    hit = lambda op, v: [r[0] for r in rows(rec.search_by_amount(lines, accounts, partners, 1, op, v), "partner_id")]
    assert hit("=", 0) == [2, 3] and hit(">", 5) == [1] and hit("!=", 0) == [1]


def test_credit_limit_of_zero_is_off(spark):
    p = spark.createDataFrame([(1, "a", money(0), money(0)), (2, "b", money(100), money(200)), (3, "c", money(100), money(200))],
                              "id long, name string, warning_stage decimal(18,2), blocking_stage decimal(18,2)")
    b = spark.createDataFrame([(1, money(999), money(0)), (2, money(150), money(50)), (3, money(250), money(50))], "partner_id long, credit decimal(18,2), debit decimal(18,2)")
    assert rows(rec.credit_limits(b, p), "partner_id", "is_warning", "is_blocked") == [(1, False, False), (2, True, False), (3, True, True)]


def test_labels(spark):
    df = spark.createDataFrame([("INV/1", "", "/"), (None, "R", "n")], "a string, b string, c string")
    assert sorted(r[0] for r in df.select(ledger_display_name("a", "b", "c")).collect()) == ["INV/1", "R-n"]
    names = spark.createDataFrame([(1, "x" * 44), (2, "x" * 45), (None, "y")], "partner_id long, name string")
    assert sorted(len(r[0]) for r in names.select(partner_label()).collect()) == [len("Unknown Partner"), 43, 44]


def test_report_tree_counts_an_account_in_each_node(spark, ledger, accounts):
    nodes = [(1, None, "Top", 1, "sum", -1, [], [], None, "no_detail"), (2, 1, "A", 1, "accounts", 1, [], [2, 2], None, "no_detail"),
             (3, 1, "B", 2, "accounts", -1, [], [2], None, "detail_flat"), (4, None, "Ref", 2, "account_report", 1, [], [], 1, "no_detail")]
    df = spark.createDataFrame(nodes, NODE_SCHEMA)
    out = st.financial_report(ledger(line(1, 2, "2020-01-01", 10)), accounts, df, LedgerFilter(), [Period("p", None, D)])
    assert rows(out.filter("row_type = 'report'"), "node_id", "balance_0") == [(1, -20.0), (2, 10.0), (3, -10.0), (4, 20.0)]
    assert rows(out.filter("row_type = 'account'"), "node_id", "balance_0") == [(3, -10.0)]
    assert [r.name for r in out.orderBy("sort_path").collect()][:3] == ["Top", "A", "B"]


def test_report_tree_refuses_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "A", 1, "account_report", 1, [], [], 2, "no_detail"), (2, None, "B", 2, "account_report", 1, [], [], 1, "no_detail")], NODE_SCHEMA)
    with pytest.raises(Exception, match="RECURSION"):
        st.node_closure(nodes).collect()


def test_letter_placeholders(spark, partners):
    texts = spark.createDataFrame([(1, "Dear %(partner_name)s, %(date)s: 5%% of %(company_name)s%(user_signature)s 100% %(other)s"), (9, "%(partner_name)s|%(date)s"), (2, None)],
                                  "partner_id long, text string")
    named = partners.withColumn("name", F.when(F.col("id") == 1, "%(date)s %% A").otherwise(F.col("name"))).withColumn("fmt", F.when(F.col("id") == 1, "dd.MM.yyyy"))
    out = rec.filled_letters(texts, named, D, "C & %(date)s", "!", F.col("fmt"))
    assert dict(rows(out)) == {1: "Dear %(date)s %% A, 30.06.2020: 5% of C & %(date)s! 100% %(other)s", 9: "|2020-06-30", 2: None}


def test_credit_limit_switches(spark):
    limits = spark.createDataFrame([(1, "a", 5, 10, True), (2, "b", 5, 10, False), (3, "c", 0, 0, True), (4, "d", 5, 10, None)],
                                   "id long, name string, warning_stage int, blocking_stage int, active_limit boolean")
    due = spark.createDataFrame([(i, money(12), money(0)) for i in range(1, 5)], "partner_id long, credit decimal(18,2), debit decimal(18,2)")
    flags = ("partner_id", "has_due", "is_warning", "is_blocked")
    assert rows(rec.credit_limits(due, limits), *flags) == [(1, True, True, True), (2, False, False, False), (3, True, False, False), (4, False, False, False)]
    assert not any(r[1] or r[2] or r[3] for r in rows(rec.credit_limits(due, limits, enabled=False), *flags))


def test_ageing_in_the_users_currency(spark, ledger, partials, accounts, partners):
    lines = ledger(line(1, 2, "2020-05-01", 10, company_id=1), line(2, 2, "2020-05-01", 0.01, company_id=2), line(3, 2, "2020-05-01", 100, company_id=2))
    links = partials((1, 90, 1, "2020-05-02"), (1, 91, 1, "2020-05-03")).withColumn("company_id", F.lit(1).cast("long"))
    rates = spark.createDataFrame([(1, date(2020, 1, 1), money(3)), (2, date(2020, 1, 1), money(30)), (2, date(2021, 1, 1), money(99))],
                                  "currency_id long, date date, rate decimal(18,2)")
    companies = spark.createDataFrame([(1, 2), (2, 1)], "id long, currency_id long")
    factors = rec.currency_factors(companies, rates, 1, D)
    assert rows(factors) == [(1, 0.1), (2, 1.0)]
    p = rec.AgeingParams(asof=D)
    assert rows(rec.aged_lines(lines, accounts, links, p, factors), "line_id", "amount") == [(1, 0.8), (2, 0.01), (3, 100.0)]
    assert rows(rec.aged_balance(lines, accounts, links, partners, p, factors), "total") == [(100.81,)]


def test_pages_after_a_cursor(spark):
    df = spark.createDataFrame([(None, 3), ("a", 1), ("a", 2), ("b", None), ("b", 0), (None, 1)], "k string, n int")
    order, seen, after = ["k", "n"], [], None
    for _ in range(4):
        page = rec.next_page(df, order, 2, after)
        seen.append([tuple(r) for r in page.collect()])
        after = rec.cursor(page, order)
    assert seen == [[(None, 1), (None, 3)], [("a", 1), ("a", 2)], [("b", None), ("b", 0)], []]


def test_pages_of_accounts_and_partners(ledger, accounts, journals):
    lines = ledger(*[line(i, 2, f"2020-0{1 + i // 10}-01", i, move_id=100 - i) for i in range(30)], line(90, 2, "2021-01-01", 1), line(91, 5, "2020-02-01", 1))
    start, end = date(2020, 2, 1), date(2020, 12, 31)
    before = sum(range(10))
    order = sorted(range(10, 30), key=lambda i: (1 + i // 10, 100 - i))
    want = [(n + 1, i, float(before + sum(order[:n + 1])), 20) for n, i in enumerate(order)]
    columns = ("row_no", "line_id", "running_balance", "line_count")
    for page in range(4):
        assert rows(gl.ledger_page(lines, accounts, journals, 2, start, end, page, 7), *columns) == want[7 * page:7 * page + 7]
    kept = gl.ledger_days(lines)
    assert rows(gl.ledger_page(lines, accounts, journals, 2, start, end, 1, 7, days=kept), *columns) == want[7:14]
    own = [(n + 1, i, float(before + sum(range(10, i + 1))), 20) for n, i in enumerate(range(10, 30))]
    assert rows(gl.partner_page(lines.filter("account_id = 2"), accounts, journals, 1, start, end, 1, 7), *columns) == own[7:14]


def test_payment_accounts_of_journals(spark):
    listed = spark.createDataFrame([(1, [5, None], [6]), (2, None, [5]), (3, [], None)], "id long, inbound_account_ids array<long>, outbound_account_ids array<long>")
    assert rows(gl.journal_payment_accounts(listed)) == [(1, 5), (1, 6), (2, 5)]


def test_balance_by_partner_name(spark, ledger, accounts, journals):
    """Partners of one name are mixed by document; an empty name comes first, none at all last."""
    named = spark.createDataFrame([(1, "Zoe"), (2, "Ann"), (3, "Ann"), (4, ""), (5, None)], "id long, name string")
    lines = ledger(*[line(i, 2, "2020-01-01", i, partner_id=p, move_id=m) for i, p, m in [
        (1, 1, 1), (2, 2, 9), (3, 3, 8), (4, 4, 7), (5, 5, 1), (6, None, 2), (7, 99, 3), (8, 2, 7), (9, 1, 1)]])
    out = gl.general_ledger(lines, accounts, journals, LedgerFilter(), named, sort_by="journal_partner")
    total, want = 0, []
    for i in (4, 8, 3, 2, 1, 9, 5, 6, 7):
        total += i
        want.append((i, float(total)))
    assert rows(out, "line_id", "running_balance") == sorted(want)
