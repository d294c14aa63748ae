"""General-ledger queries over the derived tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlake.functions.filters import OPEN_START, LedgerFilter, ledger_states
from ledgerlake.operators import ledger as op
from ledgerlake.plans.base import ASOF, END, START, Family
from ledgerlake.plans.oracle import sql

FAMILY = Family()
POSTED = LedgerFilter(date_from=START, date_to=END, state="posted")
ALL_YEAR = LedgerFilter(date_from=START, date_to=END)

OK = "COALESCE(display_type NOT IN ('line_section', 'line_note'), TRUE) AND parent_state <> 'cancel'"
YEAR = f"date BETWEEN DATE '{START}' AND DATE '{END}'"
BEFORE = f"date < DATE '{START}'"
POSTED_OK = f"{OK} AND parent_state = 'posted'"


def d(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def _lines_with_analytic(t):
    return t.move_line.withColumn("analytic", F.when(F.col("analytic_id").isNotNull(), F.create_map(
        F.col("analytic_id").cast("string"), F.lit(100).cast("decimal(5,2)"))))


@FAMILY.query("f1_ledger_filter_carried", sql("move_line account", f"""
    SELECT m.account_id, COUNT(*) AS n, CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit
    FROM move_line m JOIN account a ON a.id = m.account_id
    WHERE {OK} AND date <= DATE '{END}' AND (date >= DATE '{START}' OR include_initial_balance)
      AND journal_id IN (1, 2) AND company_id IN (1, 2) GROUP BY m.account_id"""))
def _(t):
    where = LedgerFilter(date_from=START, date_to=END, mode=OPEN_START, journal_ids=(1, 2), company_ids=(1, 2))
    return where.apply(t.move_line, t.account).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))


@FAMILY.query("f1_ledger_filter_reconcile_date", sql("move_line partial", f"""
    SELECT account_id, partner_id, CAST(SUM(balance) AS DOUBLE) AS balance, COUNT(*) AS n FROM move_line m
    WHERE {OK} AND date_maturity <= DATE '{END}'
      AND (NOT reconciled OR EXISTS (SELECT 1 FROM partial p WHERE p.max_date > DATE '1999-06-30'
           AND (p.debit_line_id = m.id OR p.credit_line_id = m.id)))
    GROUP BY account_id, partner_id"""))
def _(t):
    where = LedgerFilter(date_to=END, use_maturity=True, reconcile_date=date(1999, 6, 30))
    return where.apply(t.move_line, t.account, t.partial).groupBy("account_id", "partner_id").agg(
        F.sum("balance").alias("balance"), F.count(F.lit(1)).alias("n"))


@FAMILY.query("f1_ledger_filter_dimensions", sql("move_line account partner", f"""
    SELECT account_id, analytic_id, COUNT(*) AS n, CAST(SUM(balance) AS DOUBLE) AS balance FROM move_line m
    WHERE {OK} AND analytic_id IN (2, 5) AND account_id IN (SELECT id FROM account WHERE list_contains(tag_ids, 3))
      AND partner_id IN (SELECT id FROM partner WHERE segment IN ('BUILDING', 'SUPPLIER'))
    GROUP BY account_id, analytic_id"""))
def _(t):
    where = LedgerFilter(analytic_ids=(2, 5), account_tag_ids=(3,), partner_categories=("BUILDING", "SUPPLIER"))
    return where.apply(_lines_with_analytic(t), t.account, partners=t.partner).groupBy("account_id", "analytic_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance"))


@FAMILY.query("f6_state_filter", sql("move_line", """
    SELECT parent_state, COUNT(*) AS n, CAST(SUM(debit) AS DOUBLE) AS debit FROM move_line
    WHERE parent_state IN ('posted', 'draft') GROUP BY parent_state"""))
def _(t):
    return t.move_line.filter(ledger_states("both")).groupBy("parent_state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("debit").alias("debit"))


_TB = f"""SELECT a.id AS account_id, code, name, CAST(COALESCE(SUM(debit), 0) AS DOUBLE) AS debit,
    CAST(COALESCE(SUM(credit), 0) AS DOUBLE) AS credit, CAST(COALESCE(SUM(debit - credit), 0) AS DOUBLE) AS balance
    FROM account a LEFT JOIN (SELECT account_id, debit, credit FROM move_line WHERE {POSTED_OK} AND {YEAR}) l ON l.account_id = a.id
    GROUP BY a.id, code, name"""


@FAMILY.query("a1_trial_balance", sql("move_line account", _TB))
def _(t):
    return op.trial_balance(t.move_line, t.account, POSTED)


@FAMILY.query("f3_display_movement", sql("move_line account", f"SELECT * FROM ({_TB}) WHERE debit <> 0 OR credit <> 0"))
def _(t):
    return op.trial_balance(t.move_line, t.account, POSTED, show="movement")


@FAMILY.query("f3_display_not_zero", sql("move_line account", f"SELECT * FROM ({_TB}) WHERE ROUND(balance, 2) <> 0"))
def _(t):
    return op.trial_balance(t.move_line, t.account, POSTED, show="not_zero")


_OPEN = f"""SELECT {{key}}, COALESCE(SUM(debit) FILTER ({BEFORE}), 0) AS initial_debit, COALESCE(SUM(credit) FILTER ({BEFORE}), 0) AS initial_credit,
    COALESCE(SUM(debit) FILTER ({YEAR}), 0) AS debit, COALESCE(SUM(credit) FILTER ({YEAR}), 0) AS credit,
    COUNT(*) FILTER ({YEAR}) AS line_count FROM move_line m {{join}}
    WHERE {{ok}} AND date <= DATE '{END}' GROUP BY {{key}}"""
_END = """SELECT *, initial_debit - initial_credit AS initial_balance, debit - credit AS balance,
    initial_debit + debit AS ending_debit, initial_credit + credit AS ending_credit,
    initial_debit - initial_credit + debit - credit AS ending_balance FROM {src}"""
_PART_SUMS = ", ".join(f"SUM({c}) AS {c}" for c in op._PARTS)
_TB2 = f"""SELECT account_id, code, name, {d(*op._PARTS)} FROM named UNION ALL
    SELECT NULL, NULL, 'SUBTOTAL', {", ".join(f"CAST(ROUND(SUM({c}), 2) AS DOUBLE) AS {c}" for c in op._PARTS)} FROM named"""
_NAMED = f"SELECT e.account_id, a.code, a.name, {', '.join('e.' + c for c in op._PARTS)} FROM ending e JOIN account a ON a.id = e.account_id WHERE ending_debit <> 0 OR ending_credit <> 0"


@FAMILY.query("a2_trial_balance_periods", sql("move_line account", _TB2,
              base=_OPEN.format(key="account_id", join="", ok=POSTED_OK), ending=_END.format(src="base"), named=_NAMED))
def _(t):
    return op.trial_balance_periods(t.move_line, t.account, START, END, LedgerFilter(state="posted"))


@FAMILY.query("a3_trial_balance_carry_profit", sql("move_line account", _TB2,
              base=_OPEN.format(key="account_id", join="", ok=POSTED_OK),
              flagged="SELECT b.*, a.internal_group IN ('income', 'expense') AS res FROM base b JOIN account a ON a.id = b.account_id",
              carried="""SELECT account_id, SUM(initial_debit) AS initial_debit, SUM(initial_credit) AS initial_credit, SUM(debit) AS debit, SUM(credit) AS credit
                FROM (SELECT account_id, CASE WHEN res THEN 0 ELSE initial_debit END AS initial_debit,
                             CASE WHEN res THEN 0 ELSE initial_credit END AS initial_credit, debit, credit FROM flagged
                      UNION ALL SELECT (SELECT MIN(id) FROM account WHERE account_type = 'equity_unaffected'),
                             SUM(initial_debit), SUM(initial_credit), 0, 0 FROM flagged WHERE res) GROUP BY account_id""",
              ending=_END.format(src="carried"), named=_NAMED))
def _(t):
    return op.trial_balance_periods(t.move_line, t.account, START, END, LedgerFilter(state="posted"), carry_profit_to="equity_unaffected")


_GL_COLS = """m.id AS line_id, m.account_id, m.date, j.code AS journal_code, p.name AS partner_name, m.move_name, m.ref, m.name,
    m.currency_id, CAST(m.amount_currency AS DOUBLE) AS amount_currency, CAST(m.debit AS DOUBLE) AS debit, CAST(m.credit AS DOUBLE) AS credit"""


def _gl(order: str, extra: str = "", opening: bool = False, where: str = POSTED_OK, restrict: str = "") -> str:
    base = "SUM(debit - credit) OVER (PARTITION BY m.account_id ORDER BY {} ROWS UNBOUNDED PRECEDING)".format(order)
    if opening:
        base += f" + COALESCE(o.open_balance, 0)"
    head = ""
    if opening:
        head = f"""SELECT 0 AS line_id, account_id, NULL::DATE AS date, NULL AS journal_code, NULL AS partner_name, NULL AS move_name,
            NULL AS ref, 'Initial Balance' AS name, NULL::BIGINT AS currency_id, 0.0::DOUBLE AS amount_currency, CAST(open_debit AS DOUBLE) AS debit,
            CAST(open_credit AS DOUBLE) AS credit, CAST(open_balance AS DOUBLE) AS running_balance FROM opening UNION ALL """
    body = f"""{head}SELECT {_GL_COLS}, CAST({base} AS DOUBLE) AS running_balance
        FROM move_line m JOIN journal j ON j.id = m.journal_id LEFT JOIN partner p ON p.id = m.partner_id
        {"LEFT JOIN opening o ON o.account_id = m.account_id" if opening else ""}
        WHERE {where} AND m.{YEAR} {restrict}"""
    ctes = {}
    if opening:
        ctes["opening"] = f"""SELECT account_id, SUM(debit) AS open_debit, SUM(credit) AS open_credit, SUM(debit - credit) AS open_balance
            FROM move_line m WHERE {where} AND {BEFORE} {restrict} GROUP BY account_id"""
    return sql("move_line journal partner account", body, **ctes)


@FAMILY.query("a4_general_ledger", _gl("m.date, m.move_id, m.id", opening=True))
def _(t):
    return op.general_ledger(t.move_line, t.account, t.journal, POSTED, t.partner, initial_balance=True)


@FAMILY.query("a4_general_ledger_by_journal_partner", _gl("j.code, p.name NULLS LAST, m.move_id, m.id"))
def _(t):
    return op.general_ledger(t.move_line, t.account, t.journal, POSTED, t.partner, sort_by="journal_partner")


@FAMILY.query("a5_general_ledger_summary", sql("move_line account",
              f"SELECT e.account_id, a.code, a.name, {d(*op._PARTS)}, line_count FROM ending e JOIN account a ON a.id = e.account_id WHERE ending_debit <> 0 OR ending_credit <> 0",
              base=_OPEN.format(key="account_id", join="", ok=OK), ending=_END.format(src="base")))
def _(t):
    return op.general_ledger_summary(t.move_line, t.account, START, END)


@FAMILY.query("a6_ledger_page", sql("move_line journal", f"""
    SELECT row_no, line_id, date, journal_code, move_name, name, {d("debit", "credit")}, CAST(running_balance + opening AS DOUBLE) AS running_balance, line_count
    FROM (SELECT ROW_NUMBER() OVER w AS row_no, m.id AS line_id, m.date, j.code AS journal_code, move_name, m.name, debit, credit,
          SUM(debit - credit) OVER (ORDER BY m.date, m.move_id, m.id ROWS UNBOUNDED PRECEDING) AS running_balance,
          COUNT(*) OVER () AS line_count,
          (SELECT COALESCE(SUM(debit - credit), 0) FROM move_line WHERE {POSTED_OK} AND account_id = 2 AND {BEFORE}) AS opening
          FROM move_line m JOIN journal j ON j.id = m.journal_id WHERE {POSTED_OK} AND account_id = 2 AND {YEAR}
          WINDOW w AS (ORDER BY m.date, m.move_id, m.id)) WHERE row_no BETWEEN 41 AND 60"""))
def _(t):
    return op.ledger_page(t.move_line, t.account, t.journal, 2, START, END, page=2, where=LedgerFilter(state="posted"))


_PL = f"""FROM move_line m JOIN account a ON a.id = m.account_id AND NOT a.deprecated AND a.account_type IN ({{types}})
    WHERE {OK} AND partner_id IS NOT NULL"""
_CUST, _BOTH = "'asset_receivable'", "'asset_receivable', 'liability_payable'"


@FAMILY.query("a7_partner_ledger", sql("move_line account journal partner", f"""
    SELECT m.partner_id, COALESCE(p.ref, '') AS partner_ref, COALESCE(p.name, '') AS partner_name, m.id AS line_id, m.date, j.code AS journal_code,
      a.name AS account_name, array_to_string([x FOR x IN [move_name, m.ref, m.name] IF x IS NOT NULL AND x NOT IN ('', '/')], '-') AS displayed_name,
      CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit,
      CAST(SUM(debit - credit) OVER (PARTITION BY m.partner_id ORDER BY m.date, m.id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS progress
    FROM move_line m JOIN account a ON a.id = m.account_id AND NOT a.deprecated AND a.account_type IN ({_BOTH})
    LEFT JOIN journal j ON j.id = m.journal_id LEFT JOIN partner p ON p.id = m.partner_id
    WHERE {OK} AND m.partner_id IS NOT NULL AND {YEAR} AND full_reconcile_id IS NULL"""))
def _(t):
    return op.partner_ledger(t.move_line, t.account, t.journal, t.partner, ALL_YEAR, side="customer_supplier", reconciled=False)


@FAMILY.query("a7_partner_page", sql("move_line account journal", f"""
    SELECT row_no, line_id, date, journal_code, account_name, displayed_name, {d("debit", "credit")}, CAST(running_balance + opening AS DOUBLE) AS running_balance, line_count
    FROM (SELECT ROW_NUMBER() OVER w AS row_no, m.id AS line_id, m.date, j.code AS journal_code, a.name AS account_name,
          array_to_string([x FOR x IN [move_name, m.ref, m.name] IF x IS NOT NULL AND x NOT IN ('', '/')], '-') AS displayed_name, debit, credit,
          SUM(debit - credit) OVER (ORDER BY m.date, m.id ROWS UNBOUNDED PRECEDING) AS running_balance, COUNT(*) OVER () AS line_count,
          (SELECT COALESCE(SUM(debit - credit), 0) FROM move_line x JOIN account y ON y.id = x.account_id AND y.account_type = 'asset_receivable'
           WHERE {OK} AND partner_id = 14 AND {BEFORE}) AS opening
          FROM move_line m JOIN account a ON a.id = m.account_id AND NOT a.deprecated AND a.account_type = 'asset_receivable' LEFT JOIN journal j ON j.id = m.journal_id
          WHERE {OK} AND m.partner_id = 14 AND {YEAR} WINDOW w AS (ORDER BY m.date, m.id)) WHERE row_no BETWEEN 6 AND 10"""))
def _(t):
    return op.partner_page(t.move_line, t.account, t.journal, 14, START, END, page=1, page_size=5)


@FAMILY.query("a8_partner_totals", sql("move_line account", f"""
    SELECT partner_id, CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit, CAST(SUM(debit - credit) AS DOUBLE) AS balance
    {_PL.format(types=_CUST)} AND {YEAR} GROUP BY partner_id"""))
def _(t):
    return op.partner_totals(t.move_line, t.account, ALL_YEAR)


@FAMILY.query("a9_partner_ledger_summary", sql("move_line account partner",
              f"SELECT e.partner_id, p.name AS partner_name, {d(*op._PARTS)}, line_count FROM ending e JOIN partner p ON p.id = e.partner_id",
              base=_OPEN.format(key="partner_id", join=f"JOIN account a ON a.id = m.account_id AND a.account_type IN ({_BOTH})",
                                ok=OK + " AND (debit <> 0 OR credit <> 0)"), ending=_END.format(src="base")))
def _(t):
    return op.partner_ledger_summary(t.move_line, t.account, t.partner, START, END)


def _audit(order: str) -> str:
    return sql("move_line journal account", f"""
    SELECT j.code AS journal_code, ROW_NUMBER() OVER (PARTITION BY m.journal_id ORDER BY {order}) AS sort_no, m.id AS line_id, m.date, move_name,
      a.code AS account_code, partner_id, m.name, CAST(debit AS DOUBLE) AS debit, CAST(credit AS DOUBLE) AS credit
    FROM move_line m JOIN journal j ON j.id = m.journal_id JOIN account a ON a.id = m.account_id WHERE {POSTED_OK} AND {YEAR}""")


@FAMILY.query("a10_journal_audit", _audit("m.date, m.move_id, m.id"))
def _(t):
    return op.journal_audit(t.move_line, t.journal, t.account, POSTED)


@FAMILY.query("a10_journal_audit_by_name", _audit("m.move_name, m.id"))
def _(t):
    return op.journal_audit(t.move_line, t.journal, t.account, POSTED, sort_by="move_name")


@FAMILY.query("a11_journal_totals", sql("move_line", f"""SELECT journal_id, CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit
    FROM move_line WHERE {POSTED_OK} AND {YEAR} GROUP BY journal_id"""))
def _(t):
    return op.journal_totals(t.move_line, t.account, POSTED)


@FAMILY.query("a23_bank_book", _gl("m.date, m.move_id, m.id", opening=True, restrict="""AND m.account_id IN
    (SELECT x.account_id FROM move_line x JOIN journal y ON y.id = x.journal_id JOIN account z ON z.id = x.account_id
     WHERE y.type = 'bank' AND z.account_type = 'asset_cash')"""))
def _(t):
    return op.liquidity_book(t.move_line, t.account, t.journal, POSTED, "bank", t.partner)


# Payment accounts as journals list them: the bank's incoming and outgoing ones, of whatever type.
_PAYMENT = {3: ([1], [3, None]), 1: ([2], [])}


@FAMILY.query("a23_bank_book_payment_accounts", _gl("m.date, m.move_id, m.id", opening=True, restrict="AND m.account_id IN (1, 3)"))
def _(t):
    kind = "array<bigint>"
    listed = [F.coalesce(*[F.when(F.col("id") == j, F.array(*map(F.lit, accounts[i])).cast(kind)) for j, accounts in _PAYMENT.items()]) for i in (0, 1)]
    journals = t.journal.withColumns({"inbound_account_ids": listed[0], "outbound_account_ids": listed[1]})
    return op.liquidity_book(t.move_line, t.account, t.journal, POSTED, "bank", t.partner, journal_accounts=op.journal_payment_accounts(journals))


@FAMILY.query("a24_day_book", sql("move_line", f"""SELECT date, CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit,
    CAST(SUM(debit - credit) AS DOUBLE) AS balance, COUNT(*) AS line_count FROM move_line WHERE {OK} AND {YEAR} GROUP BY date"""))
def _(t):
    return op.day_book(t.move_line, t.account, ALL_YEAR)


@FAMILY.query("a24_day_book_lines", sql("move_line journal", f"""SELECT date, m.id AS line_id, j.code AS journal_code, move_name, account_id,
    {d("debit", "credit", "balance")} FROM move_line m JOIN journal j ON j.id = m.journal_id WHERE {OK} AND {YEAR} AND parent_state = 'posted'"""))
def _(t):
    return op.day_book_lines(t.move_line, t.account, t.journal, ALL_YEAR, target_move="posted")


@FAMILY.query("a25_consolidated_journals", sql("move_line", """
    SELECT 'account' AS level, strftime(month, '%m') AS month, strftime(month, '%Y') AS year, journal_id, account_id, company_id, """
    + "CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit, CAST(SUM(debit - credit) AS DOUBLE) AS balance"
    + """ FROM base GROUP BY month, journal_id, account_id, company_id
    UNION ALL SELECT 'journal', NULL, NULL, journal_id, NULL, NULL, CAST(SUM(debit) AS DOUBLE), CAST(SUM(credit) AS DOUBLE), CAST(SUM(debit - credit) AS DOUBLE) FROM base GROUP BY journal_id
    UNION ALL SELECT 'total', NULL, NULL, NULL, NULL, NULL, CAST(SUM(debit) AS DOUBLE), CAST(SUM(credit) AS DOUBLE), CAST(SUM(debit - credit) AS DOUBLE) FROM base""",
    base=f"SELECT *, date_trunc('month', date) AS month FROM move_line WHERE {OK} AND date <= DATE '{ASOF}'"))
def _(t):
    return op.consolidated_journals(t.move_line, LedgerFilter(date_to=ASOF))


@FAMILY.query("a25_consolidated_journal_months", sql("move_line", f"""SELECT journal_id, strftime(date, '%m-%Y') AS month,
    CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit, CAST(SUM(debit - credit) AS DOUBLE) AS balance
    FROM move_line WHERE {OK} AND date <= DATE '{ASOF}' GROUP BY ALL"""))
def _(t):
    return op.consolidated_journal_months(t.move_line, LedgerFilter(date_to=ASOF))


@FAMILY.query("b6_currency_conversion", sql("invoice rate", f"""
    SELECT i.id, 1 + i.partner_id % 3 AS currency_id, CAST(i.amount_residual AS DOUBLE) AS amount,
      CAST((2 * CAST(i.amount_residual * 100 AS HUGEINT) * 1000000 + CAST(COALESCE(r.rate, 1) * 1000000 AS HUGEINT))
        // (2 * CAST(COALESCE(r.rate, 1) * 1000000 AS HUGEINT)) AS DOUBLE) / 100.0 AS amount_converted
    FROM invoice i LEFT JOIN (SELECT currency_id, rate FROM rate WHERE date <= DATE '{END}'
      QUALIFY ROW_NUMBER() OVER (PARTITION BY currency_id ORDER BY date DESC) = 1) r ON r.currency_id = 1 + i.partner_id % 3"""))
def _(t):
    amounts = t.invoice.selectExpr("id", "1 + partner_id % 3 AS currency_id", "amount_residual AS amount")
    return op.convert_currency(amounts, t.rate, END)
