"""Statement and tax queries over the derived tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlake.functions.filters import LedgerFilter
from ledgerlake.functions.periods import earlier, in_periods, period, same_last_year
from ledgerlake.operators import statements as op
from ledgerlake.operators import taxes
from ledgerlake.plans.base import END, START, Family
from ledgerlake.plans.ledger import OK, POSTED, POSTED_OK, YEAR
from ledgerlake.plans.oracle import ratio, sql

FAMILY = Family()
POSTED_ANY = LedgerFilter(state="posted")
TODAY = date(1999, 2, 10)
YEARS = [period(START, END, TODAY), *earlier(period(START, END, TODAY), 2)]
QUARTER = period(date(1999, 4, 1), date(1999, 6, 30), TODAY)
QUARTERS = [QUARTER, *earlier(QUARTER, 2), *same_last_year(QUARTER, 2)]


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


@FAMILY.query("a12_journal_taxes", sql("move_line line_tax journal", f"""
    SELECT b.journal_id, b.tax_id, CAST(base_amount * s AS DOUBLE) AS base_amount, CAST(COALESCE(tax_amount, 0) * s AS DOUBLE) AS tax_amount
    FROM (SELECT journal_id, tax_id, SUM(balance) AS base_amount FROM move_line m JOIN line_tax r ON r.line_id = m.id WHERE {POSTED_OK} AND {YEAR} GROUP BY ALL) b
    LEFT JOIN (SELECT journal_id, tax_line_id, SUM(debit - credit) AS tax_amount FROM move_line WHERE {POSTED_OK} AND {YEAR} AND tax_line_id IS NOT NULL GROUP BY ALL) x
      ON x.journal_id = b.journal_id AND x.tax_line_id = b.tax_id
    JOIN (SELECT id, CASE type WHEN 'sale' THEN -1 ELSE 1 END AS s FROM journal) j ON j.id = b.journal_id"""))
def _(t):
    return taxes.journal_taxes(t.move_line, t.line_tax, t.journal, t.account, POSTED, "posted")


@FAMILY.query("a13_tax_report", sql("move_line line_tax taxes", f"""
    SELECT section, l.tax_id, name, CAST(COALESCE(net, 0) AS DOUBLE) AS net, CAST(tax AS DOUBLE) AS tax FROM (
      SELECT id AS tax_id, name, type_tax_use AS section FROM taxes t WHERE type_tax_use <> 'none' AND NOT EXISTS (SELECT 1 FROM taxes c WHERE c.parent_id = t.id)
      UNION ALL SELECT c.id, c.name, t.type_tax_use FROM taxes c JOIN taxes t ON t.id = c.parent_id WHERE c.type_tax_use = 'none' AND t.type_tax_use <> 'none') l
    JOIN (SELECT tax_line_id, ABS(SUM(debit - credit)) AS tax FROM move_line WHERE {POSTED_OK} AND {YEAR} GROUP BY tax_line_id) x ON x.tax_line_id = l.tax_id
    LEFT JOIN (SELECT tax_id, ABS(SUM(debit - credit)) AS net FROM move_line m JOIN line_tax r ON r.line_id = m.id WHERE {POSTED_OK} AND {YEAR} GROUP BY tax_id) b ON b.tax_id = l.tax_id
    WHERE tax <> 0"""))
def _(t):
    return taxes.tax_report(t.move_line, t.line_tax, t.tax, t.account, POSTED)


def _tax_sql(cell: str) -> str:
    """One (net, tax) pair per period, computed tax by tax with scalar sums."""
    columns = []
    for i, p in enumerate(YEARS):
        span = f"BETWEEN DATE '{p.start}' AND DATE '{p.end}'"
        net = f"COALESCE((SELECT SUM(b) FROM bases WHERE bases.tax_id = t.id AND date {span}), 0)"
        tax = f"COALESCE((SELECT SUM(b) FROM paid WHERE (paid.tax_id = t.id OR paid.parent_id = t.id) AND date {span}), 0)"
        columns += [f"CAST({cell} * {net} AS DOUBLE) AS net_{i}", f"CAST({cell} * {tax} AS DOUBLE) AS tax_{i}"]
    return ", ".join(columns)


_TAX_CTES = dict(
    bases=f"SELECT r.tax_id, m.date, SUM(balance) AS b FROM move_line m JOIN line_tax r ON r.line_id = m.id WHERE {POSTED_OK} GROUP BY ALL",
    paid=f"""SELECT m.tax_line_id AS tax_id, CASE WHEN x.type_tax_use = 'none' THEN x.parent_id END AS parent_id, m.date, SUM(balance) AS b
      FROM move_line m JOIN taxes x ON x.id = m.tax_line_id WHERE {POSTED_OK} GROUP BY ALL""",
    by_tax=f"""SELECT type_tax_use AS section, t.id AS tax_id, CASE WHEN amount_type = 'group' THEN name ELSE name || ' (' || CAST(amount AS STRING) || ')' END AS name, sequence,
      {_tax_sql("CASE WHEN type_tax_use = 'sale' THEN -1 ELSE 1 END")} FROM taxes t WHERE type_tax_use <> 'none'""")


def _by_tax(t):
    return taxes.taxes_by_period(t.move_line, t.line_tax, t.tax, t.account, POSTED_ANY, YEARS)


@FAMILY.query("a14_taxes_by_period", sql("move_line line_tax taxes", "SELECT * FROM by_tax", **_TAX_CTES))
def _(t):
    return _by_tax(t)


_TAX_COLS = [f"{n}_{i}" for i in range(len(YEARS)) for n in ("net", "tax")]


def _tax_sums(sign: str = "1") -> str:
    return ", ".join(f"CAST(SUM({sign} * CAST({c} AS DECIMAL(18,2))) AS DOUBLE) AS {c}" for c in _TAX_COLS)


@FAMILY.query("a29_tax_totals", sql("move_line line_tax taxes", f"""SELECT section, {_tax_sums()} FROM by_tax GROUP BY section
    UNION ALL SELECT 'total', {_tax_sums()} FROM by_tax
    UNION ALL SELECT 'difference', {_tax_sums("CASE section WHEN 'sale' THEN 1 ELSE -1 END")} FROM by_tax""", **_TAX_CTES))
def _(t):
    return taxes.tax_totals(_by_tax(t), len(YEARS), with_difference=True)


@FAMILY.query("a15_tax_grids", sql("move_line line_tag tag report_tag journal", f"""
    SELECT r.report_line_id, CAST(SUM(balance * CASE WHEN g.tax_negate THEN -1 ELSE 1 END * CASE WHEN cash_basis_rec_id IS NULL AND j.type = 'sale' THEN -1 ELSE 1 END
      * CASE WHEN cash_basis_rec_id IS NULL AND move_type IN ('in_refund', 'out_refund') THEN -1 ELSE 1 END) AS DOUBLE) AS balance
    FROM move_line m JOIN line_tag x ON x.line_id = m.id JOIN tag g ON g.id = x.tag_id JOIN report_tag r ON r.tag_id = g.id JOIN journal j ON j.id = m.journal_id
    WHERE {POSTED_OK} AND {YEAR} GROUP BY r.report_line_id"""))
def _(t):
    return taxes.tax_grids(t.move_line, t.line_tag, t.tag, t.report_tag, t.journal, t.account, POSTED)


@FAMILY.query("a15_tax_grids_own_refund_rule", sql("move_line line_tag tag report_tag journal", f"""
    SELECT r.report_line_id, CAST(SUM(balance * CASE WHEN g.tax_negate THEN -1 ELSE 1 END * CASE WHEN cash_basis_rec_id IS NULL AND j.type = 'sale' THEN -1 ELSE 1 END
      * CASE WHEN debit > 0 THEN -1 ELSE 1 END) AS DOUBLE) AS balance
    FROM move_line m JOIN line_tag x ON x.line_id = m.id JOIN tag g ON g.id = x.tag_id JOIN report_tag r ON r.tag_id = g.id JOIN journal j ON j.id = m.journal_id
    WHERE {POSTED_OK} AND {YEAR} GROUP BY r.report_line_id"""))
def _(t):
    return taxes.tax_grids(t.move_line, t.line_tag, t.tag, t.report_tag, t.journal, t.account, POSTED, refund=F.col("debit") > 0)


def _tree_ctes(periods) -> dict[str, str]:
    cols = ", ".join(f"COALESCE(SUM({c}) FILTER (date BETWEEN DATE '{p.start}' AND DATE '{p.end}'), 0) AS {c}_{i}" for i, p in enumerate(periods) for c in ("debit", "credit"))
    bal = ", ".join(f"debit_{i} - credit_{i} AS balance_{i}" for i in range(len(periods)))
    names = op._measures(len(periods))
    return dict(
        amounts=f"SELECT *, {bal} FROM (SELECT account_id, {cols} FROM move_line WHERE {POSTED_OK} GROUP BY account_id)",
        leaf="""SELECT n.id AS leaf_id, a.id AS account_id FROM node n JOIN account a
          ON (n.type = 'accounts' AND list_contains(n.account_ids, a.id)) OR (n.type = 'account_type' AND list_contains(n.account_types, a.account_type))""",
        edges="""SELECT p.id AS src, c.id AS dst, CASE WHEN p.type = 'subtract' AND p.name <> 'Net Profit'
            AND c.sequence > (SELECT MIN(sequence) FROM node s WHERE s.parent_id = p.id) THEN -1 ELSE 1 END AS coef
          FROM node c JOIN node p ON p.id = c.parent_id WHERE p.type IN ('sum', 'total', 'subtract')
          UNION ALL SELECT id, ref_id, 1 FROM node WHERE type = 'account_report'""",
        reach="SELECT id AS node_id, id AS leaf_id, 1 AS coef FROM node UNION ALL SELECT r.node_id, e.dst, r.coef * e.coef FROM reach r JOIN edges e ON e.src = r.leaf_id",
        walk="""SELECT id, 0 AS level, lpad(CAST(sequence AS STRING), 6, '0') || '.' || lpad(CAST(id AS STRING), 10, '0') AS path FROM node WHERE parent_id IS NULL
          UNION ALL SELECT n.id, w.level + 1, w.path || '/' || lpad(CAST(n.sequence AS STRING), 6, '0') || '.' || lpad(CAST(n.id AS STRING), 10, '0')
          FROM walk w JOIN node n ON n.parent_id = w.id""",
        per_node=f"SELECT r.node_id, {', '.join(f'SUM(coef * {n}) AS {n}' for n in names)} FROM reach r JOIN leaf l ON l.leaf_id = r.leaf_id JOIN amounts a ON a.account_id = l.account_id GROUP BY r.node_id")


def _tree_sql(periods) -> str:
    names = op._measures(len(periods))
    signed = ", ".join(f"CAST(COALESCE({n}{' * sign' if n.startswith('balance') else ''}, 0) AS DOUBLE) AS {n}" for n in names)
    visible = " OR ".join(f"{n} <> 0" for n in names)
    return sql("move_line account node", f"""
      SELECT n.id AS node_id, CAST(NULL AS BIGINT) AS account_id, n.name, 'report' AS row_type, w.level, w.path AS sort_path, {signed}
      FROM node n JOIN walk w ON w.id = n.id LEFT JOIN per_node v ON v.node_id = n.id
      UNION ALL
      SELECT n.id, a.id, a.code || ' ' || a.name, 'account', CASE WHEN display_detail = 'detail_with_hierarchy' THEN 4 ELSE 0 END,
        w.path || '/~/' || a.code || ' ' || a.name, {signed}
      FROM node n JOIN walk w ON w.id = n.id JOIN leaf l ON l.leaf_id = n.id JOIN account a ON a.id = l.account_id JOIN amounts m ON m.account_id = a.id
      WHERE display_detail <> 'no_detail' AND ({visible})""", **_tree_ctes(periods))


@FAMILY.query("a16_financial_report", _tree_sql(YEARS[:1]))
def _(t):
    return op.financial_report(t.move_line, t.account, t.node, POSTED_ANY, YEARS[:1])


@FAMILY.query("a17_comparison_columns", _tree_sql([YEARS[0], YEARS[1]]))
def _(t):
    return op.financial_report(t.move_line, t.account, t.node, POSTED_ANY, [YEARS[0], YEARS[1]])


@FAMILY.query("a18_total_and_subtract", _tree_sql(YEARS[:1]))
def _(t):
    return op.financial_report(t.move_line, t.account, t.node, POSTED_ANY, YEARS[:1])


@FAMILY.query("a28_accounts_by_period", _tree_sql(YEARS))
def _(t):
    return op.financial_report(t.move_line, t.account, t.node, POSTED_ANY, YEARS)


@FAMILY.query("a19_earnings", sql("move_line account", " UNION ALL ".join(f"""SELECT '{name}' AS name, CAST(COALESCE(SUM(debit), 0) AS DOUBLE) AS debit,
    CAST(COALESCE(SUM(credit), 0) AS DOUBLE) AS credit, CAST(COALESCE(SUM(debit - credit), 0) AS DOUBLE) AS balance
    FROM move_line m JOIN account a ON a.id = m.account_id WHERE {POSTED_OK} AND (account_type ILIKE '%income%' OR account_type ILIKE '%expense%')
      AND date BETWEEN DATE '{lo}' AND DATE '{hi}'"""
    for name, lo, hi in (("previous_year_unallocated_earnings", "1998-01-01", "1998-12-31"), ("current_year_earnings", "1999-02-01", "1999-09-30")))))
def _(t):
    return op.earnings(t.move_line, t.account, POSTED_ANY, date(1999, 2, 1), date(1999, 9, 30))


@FAMILY.query("a20_cash_flow", sql("move_line section", """
    SELECT section, 'net' AS flow, CAST(d AS DOUBLE) AS debit, CAST(c AS DOUBLE) AS credit, CAST(d - c AS DOUBLE) AS balance FROM s
    UNION ALL SELECT section, 'in', CAST(d AS DOUBLE), 0, CAST(d AS DOUBLE) FROM s UNION ALL SELECT section, 'out', 0, CAST(c AS DOUBLE), CAST(-c AS DOUBLE) FROM s""",
    s=f"SELECT section, SUM(debit) AS d, SUM(credit) AS c FROM section x JOIN move_line m ON m.account_id = x.account_id WHERE {POSTED_OK} AND {YEAR} GROUP BY section"))
def _(t):
    return op.cash_flow(t.move_line, t.account, t.section, POSTED)


_UPTO = f"{POSTED_OK} AND date <= DATE '{END}'"
_IN = f"date >= DATE '{START}'"
_EXEC = f"""SELECT *, cash_received + cash_spent AS cash_surplus, assets - liabilities AS net_assets, operating_income - cost_of_revenue AS gross_profit,
    total_income - total_expense AS net_profit FROM (SELECT
    COALESCE(SUM(balance) FILTER ({_IN} AND account_type IN ('asset_cash', 'liability_credit_card') AND debit > 0), 0) AS cash_received,
    COALESCE(SUM(balance) FILTER ({_IN} AND account_type IN ('asset_cash', 'liability_credit_card') AND credit > 0), 0) AS cash_spent,
    COALESCE(SUM(balance) FILTER (account_type IN ('asset_cash', 'liability_credit_card')), 0) AS closing_bank_balance,
    COALESCE(SUM(balance) FILTER (account_type = 'asset_receivable'), 0) AS receivables, COALESCE(SUM(balance) FILTER (account_type = 'liability_payable'), 0) AS payables,
    COALESCE(SUM(balance) FILTER (account_type LIKE 'asset%'), 0) AS assets, -COALESCE(SUM(balance) FILTER (account_type LIKE 'liability%'), 0) AS liabilities,
    COALESCE(SUM(balance) FILTER (account_type IN ('asset_cash', 'asset_receivable', 'asset_current', 'asset_prepayments')), 0) AS current_assets,
    -COALESCE(SUM(balance) FILTER (account_type IN ('liability_current', 'liability_payable', 'liability_credit_card')), 0) AS current_liabilities,
    -COALESCE(SUM(balance) FILTER ({_IN} AND account_type = 'income'), 0) AS operating_income,
    -COALESCE(SUM(balance) FILTER ({_IN} AND account_type IN ('income', 'income_other')), 0) AS total_income,
    COALESCE(SUM(balance) FILTER ({_IN} AND account_type = 'expense_direct_cost'), 0) AS cost_of_revenue,
    COALESCE(SUM(balance) FILTER ({_IN} AND account_type IN ('expense', 'expense_depreciation', 'expense_direct_cost')), 0) AS total_expense
    FROM move_line m JOIN account a ON a.id = m.account_id WHERE {_UPTO})"""


def _measures(t):
    return op.executive_measures(t.move_line, t.account, POSTED_ANY, START, END)


@FAMILY.query("a21_executive_summary", sql("move_line account", " UNION ALL ".join(
    f"SELECT {i} AS line_no, '{n}' AS name, CAST({n} AS DOUBLE) AS amount FROM e" for i, n in enumerate(op.SUMMARY_LINES, 1)), e=_EXEC))
def _(t):
    return op.executive_summary(_measures(t))


_RATIOS = [("average_debtor_days", ratio("receivables * 364", "operating_income", 2)), ("average_creditor_days", ratio("-payables * 364", "operating_income", 2)),
           ("short_term_cash_forecast", "CAST(payables + receivables AS DOUBLE)"), ("current_assets_to_liabilities", ratio("current_assets", "current_liabilities", 6)),
           ("gross_profit_margin", ratio("gross_profit * 100", "operating_income", 6)), ("net_profit_margin", ratio("net_profit * 100", "total_income", 6)),
           ("return_on_assets", ratio("net_profit * 100", "assets", 6))]


@FAMILY.query("a22_executive_ratios", sql("move_line account", " UNION ALL ".join(
    f"SELECT {i} AS line_no, '{n}' AS name, {v} AS amount FROM e" for i, (n, v) in enumerate(_RATIOS, 1)), e=_EXEC))
def _(t):
    return op.executive_ratios(_measures(t))


@FAMILY.query("a26_report_items", sql("move_line account", f"""SELECT m.account_id, regexp_replace(a.name, '[^a-zA-Z0-9]', '', 'g') AS account_key, m.id AS line_id, m.date, move_name,
    {dbl("debit", "credit", "balance")} FROM move_line m JOIN account a ON a.id = m.account_id
    WHERE {POSTED_OK} AND {YEAR} AND account_type IN ('income', 'expense', 'expense_direct_cost')"""))
def _(t):
    return op.report_items(t.move_line, t.account, t.node, 1, POSTED)


_SPANS = [("Q2 1999", "1999-04-01", "1999-06-30"), ("Q1 1999", "1999-01-01", "1999-03-31"), ("Q4 1998", "1998-10-01", "1998-12-31"),
          ("Q2 1998", "1998-04-01", "1998-06-30"), ("Q2 1997", "1997-04-01", "1997-06-30")]


@FAMILY.query("a27_period_totals", sql("move_line", " UNION ALL ".join(f"""SELECT '{n}' AS period, account_id, CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit
    FROM move_line WHERE {OK} AND date BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY account_id""" for n, lo, hi in _SPANS)))
def _(t):
    lines = LedgerFilter().apply(t.move_line)
    return in_periods(lines, QUARTERS).groupBy("period", "account_id").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
