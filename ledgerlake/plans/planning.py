"""Budget, asset, recurring-entry and fiscal-year queries over the derived tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlake.operators import planning as op
from ledgerlake.plans.base import Family
from ledgerlake.plans.oracle import ratio, sql

FAMILY = Family()
D = date(1998, 3, 15)
POSTED_UNTIL = date(1996, 6, 30)


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def _exact(numerator: str, denominator: str, factor: int = 1) -> str:
    return f"CAST({ratio(numerator, denominator, 6, factor)} AS DECIMAL(28,6))"


_PRACTICAL = """SELECT b.*, CAST(COALESCE(CASE WHEN b.analytic_id IS NOT NULL
      THEN (SELECT SUM(amount) FROM analytic_day a WHERE a.analytic_id = b.analytic_id AND a.date BETWEEN b.date_from AND b.date_to
            AND (len(b.account_ids) = 0 OR list_contains(b.account_ids, a.general_account_id)))
      ELSE (SELECT SUM(amount) FROM ledger_day l WHERE list_contains(b.account_ids, l.account_id) AND l.date BETWEEN b.date_from AND b.date_to) END, 0) AS DECIMAL(18,2))
    AS practical_amount FROM budget_line b"""
_DAYS = dict(analytic_day="SELECT analytic_id, general_account_id, date, SUM(amount) AS amount FROM analytic_line GROUP BY ALL",
             ledger_day="SELECT account_id, date, SUM(credit - debit) AS amount FROM move_line GROUP BY ALL")
_TOTAL, _ELAPSED = "date_diff('day', date_from, date_to)", f"date_diff('day', date_from, DATE '{D}')"


def _theory(source: str, count_days: bool = False) -> str:
    extra = " + 1" if count_days else ""
    unpaid = "date_to <= paid_date" if count_days else f"DATE '{D}' <= paid_date"
    share = _exact(f"planned * ({_ELAPSED}{extra})", f"CAST(NULLIF({_TOTAL}{extra}, 0) AS DECIMAL(18,2))")
    return f"""SELECT *, CAST(CASE WHEN paid_date IS NOT NULL THEN CASE WHEN {unpaid} THEN 0 ELSE planned END WHEN {_ELAPSED} < 0 THEN 0
      WHEN {_TOTAL} > 0 AND DATE '{D}' < date_to THEN {share} ELSE planned END AS DECIMAL(28,6)) AS theoretical_amount FROM {source}"""


def _percent(factor: int = 1) -> str:
    return f"CASE WHEN theoretical_amount <> 0 THEN {ratio('practical_amount', 'NULLIF(theoretical_amount, 0)', 6, factor, 10**6)} ELSE 0 END"


def _practical(t):
    return op.practical_amounts(t.budget_line, t.analytic_line, t.move_line)


def _full(t):
    return op.theoretical_amounts(_practical(t), D)


_BUDGETED = dict(**_DAYS, practical=_PRACTICAL, lines=_theory("practical"))
_TABLES = "budget_line analytic_line move_line"


@FAMILY.query("c1_practical_amount", sql(_TABLES, "SELECT id, CAST(practical_amount AS DOUBLE) AS practical_amount FROM practical", **_DAYS, practical=_PRACTICAL))
def _(t):
    return _practical(t).select("id", "practical_amount")


@FAMILY.query("c1_practical_amount_analytic_only", sql(_TABLES, """SELECT b.id, CAST(COALESCE(CASE WHEN b.analytic_id IS NOT NULL THEN
    (SELECT SUM(amount) FROM analytic_day a WHERE a.analytic_id = b.analytic_id AND a.date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'
     AND list_contains(b.account_ids, a.general_account_id)) END, 0) AS DOUBLE) AS practical_amount FROM budget_line b""", **_DAYS))
def _(t):
    return op.practical_amounts(t.budget_line, t.analytic_line, None, (date(1996, 1, 1), date(1997, 6, 30))).select("id", "practical_amount")


@FAMILY.query("c2_theoretical_amount", sql("budget_line", f"SELECT id, CAST(theoretical_amount AS DOUBLE) AS theoretical_amount FROM ({_theory('budget_line')})"))
def _(t):
    return op.theoretical_amounts(t.budget_line, D).select("id", "theoretical_amount")


@FAMILY.query("c2_theoretical_amount_by_days", sql("budget_line", f"SELECT id, CAST(theoretical_amount AS DOUBLE) AS theoretical_amount FROM ({_theory('budget_line', True)})"))
def _(t):
    return op.theoretical_amounts(t.budget_line, D, count_days=True).select("id", "theoretical_amount")


_W0, _W1 = date(1997, 1, 1), date(1998, 6, 30)
_SPAN = f"date_diff('day', GREATEST(DATE '{_W0}', date_from), LEAST(DATE '{_W1}', date_to))"


@FAMILY.query("c2_theoretical_amount_in_window", sql("budget_line", f"""SELECT id, CAST(CASE WHEN DATE '{_W0}' <= date_to AND DATE '{_W1}' >= date_from AND {_SPAN} > 0
    THEN {_exact(f"planned * {_SPAN}", f"CAST(NULLIF({_TOTAL}, 0) AS DECIMAL(18,2))")} ELSE 0 END AS DOUBLE) AS theoretical_amount FROM budget_line"""))
def _(t):
    return op.theoretical_in_window(t.budget_line, _W0, _W1).select("id", "theoretical_amount")


@FAMILY.query("c3_achievement", sql(_TABLES, f"SELECT id, {_percent()} AS percentage FROM lines", **_BUDGETED))
def _(t):
    return op.achievement(_full(t)).select("id", "percentage")


@FAMILY.query("c4_above_budget", sql(_TABLES, """SELECT id, (theoretical_amount >= 0 AND practical_amount > theoretical_amount)
    OR (theoretical_amount < 0 AND practical_amount < theoretical_amount) AS is_above_budget FROM lines""", **_BUDGETED))
def _(t):
    return op.above_budget(_full(t)).select("id", "is_above_budget")


@FAMILY.query("c5_budget_rollup", sql(_TABLES, f"""SELECT position, budget_id, {dbl("planned", "practical_amount", "theoretical_amount")}, {_percent(100)} AS percentage FROM (
    SELECT position, budget_id, SUM(planned) AS planned, SUM(practical_amount) AS practical_amount, SUM(theoretical_amount) AS theoretical_amount
    FROM lines GROUP BY ROLLUP (position, budget_id))""", **_BUDGETED))
def _(t):
    return op.budget_rollup(_full(t), ["position", "budget_id"], "rollup")


_BUDGETS = """SELECT DISTINCT budget_id AS id, CAST('1995-02-01' AS DATE) + CAST(budget_id AS INT) * 5 AS date_from, CAST('1999-12-31' AS DATE) AS date_to FROM budget_line"""


@FAMILY.query("c6_budget_violations", sql("budget_line", """
    SELECT 'date_from_outside_budget' AS rule, CAST(l.id AS STRING) AS key, CAST(l.date_from AS STRING) AS detail FROM budget_line l JOIN budgets b ON b.id = l.budget_id
      WHERE l.date_from < b.date_from OR l.date_from > b.date_to
    UNION ALL SELECT 'date_to_outside_budget', CAST(l.id AS STRING), CAST(l.date_to AS STRING) FROM budget_line l JOIN budgets b ON b.id = l.budget_id
      WHERE l.date_to < b.date_from OR l.date_to > b.date_to
    UNION ALL SELECT 'position_or_analytic_missing', CAST(id AS STRING), CAST(budget_id AS STRING) FROM budget_line WHERE analytic_id IS NULL AND len(account_ids) = 0""",
    budgets=_BUDGETS))
def _(t):
    budgets = t.budget_line.select(F.col("budget_id").alias("id")).distinct().selectExpr(
        "id", "date_add(DATE'1995-02-01', CAST(id AS INT) * 5) AS date_from", "DATE'1999-12-31' AS date_to")
    return op.budget_violations(t.budget_line, budgets)


# --- assets: the checking SQL steps through the periods one row at a time, in whole cents ---
def _round(n: str, den: str) -> str:
    return f"((2 * ({n}) + ({den})) // (2 * ({den})))"


def _board(source: str) -> str:
    days = ("CASE WHEN method_period % 12 <> 0 THEN day(last_day(date)) - day(date) + 1 "
            "ELSE date_diff('day', start, make_date(year(start), 12, 31)) + 1 END")
    of = "CASE WHEN method_period % 12 <> 0 THEN day(last_day(date)) ELSE CASE WHEN year(start) % 4 = 0 THEN 366 ELSE 365 END END"
    linear_n = "CASE WHEN prorata THEN method_number ELSE n - done END"
    amount = f"""CASE WHEN seq + 1 = n THEN rest
      WHEN method = 'linear' THEN CASE WHEN prorata AND seq = 0 THEN {_round("base * days", f"({linear_n}) * of_days")} ELSE {_round("base", linear_n)} END
      WHEN prorata AND seq = 0 THEN {_round("rest * 30 * days", "100 * of_days")} ELSE {_round("rest * 30", "100")} END"""
    return f"""WITH RECURSIVE prep AS (
        SELECT *, CAST((value - salvage - posted_amount) * 100 AS HUGEINT) AS base, CASE WHEN last_posted IS NOT NULL THEN CAST(last_posted + to_months(method_period) AS DATE)
          WHEN prorata THEN date WHEN method_period >= 12 THEN make_date(year(date), 1, 1) ELSE CAST(date_trunc('month', date) AS DATE) END AS start FROM {source}),
      steps AS (SELECT id, start AS d, 0 AS k FROM prep WHERE method_time = 'end'
        UNION ALL SELECT s.id, CAST(s.d + to_months(p.method_period) AS DATE), k + 1 FROM steps s JOIN prep p ON p.id = s.id WHERE s.d <= p.method_end),
      counted AS (SELECT p.*, CASE WHEN method_time = 'end' THEN (SELECT COUNT(*) FROM steps s WHERE s.id = p.id AND s.d <= p.method_end) ELSE method_number END
          + CASE WHEN prorata THEN 1 ELSE 0 END AS n, {days} AS days, {of} AS of_days FROM prep p),
      walk AS (SELECT id, done AS seq, start AS next_date, base AS rest, CAST(NULL AS HUGEINT) AS amount, CAST(NULL AS DATE) AS date FROM counted WHERE base <> 0 AND n > done
        UNION ALL SELECT id, seq + 1, CASE WHEN a = 0 THEN next_date ELSE CAST(next_date + to_months(method_period) AS DATE) END, rest - a, a, next_date
        FROM (SELECT w.id, w.seq, w.next_date, w.rest, c.method_period, {amount} AS a FROM walk w JOIN counted c ON c.id = w.id WHERE w.seq < c.n))
      SELECT w.id AS asset_id, seq AS sequence, w.date, CAST(amount AS DOUBLE) / 100 AS amount, CAST(GREATEST(rest, 0) AS DOUBLE) / 100 AS remaining_value,
        CAST(value - salvage AS DOUBLE) - CAST(rest AS DOUBLE) / 100 AS depreciated_value, CAST(CAST((value - salvage) * 100 AS HUGEINT) - rest AS DOUBLE) / 100 AS depreciated
      FROM walk w JOIN {source} s ON s.id = w.id WHERE amount IS NOT NULL AND amount <> 0"""


_FRESH = "SELECT *, 0 AS done, CAST(0 AS DECIMAL(18,2)) AS posted_amount, CAST(NULL AS DATE) AS last_posted FROM asset"
_BOARD = dict(fresh=_FRESH, board=_board("fresh"))
_DEP = dict(**_BOARD, dep=f"SELECT asset_id * 1000 + sequence AS id, asset_id, sequence, date, CAST(amount AS DECIMAL(18,2)) AS amount, date <= DATE '{POSTED_UNTIL}' AS posted FROM board")
_BOARD_COLS = "asset_id, sequence, date, amount, remaining_value, depreciated AS depreciated_value"


def _dep(t):
    board = op.depreciation_board(t.asset)
    return board.select((F.col("asset_id") * 1000 + F.col("sequence")).alias("id"), "asset_id", "sequence", "date", "amount",
                        (F.col("date") <= F.lit(POSTED_UNTIL)).alias("posted"))


@FAMILY.query("c7_depreciation_board", sql("asset", f"SELECT {_BOARD_COLS} FROM board", **_BOARD))
def _(t):
    return op.depreciation_board(t.asset)


@FAMILY.query("c7_depreciation_board_continued", sql("asset", f"SELECT {_BOARD_COLS} FROM rest", **_DEP,
              open="""SELECT a.*, COALESCE(done, 0) AS done, COALESCE(posted_amount, 0) AS posted_amount, last_posted FROM asset a
                LEFT JOIN (SELECT asset_id, COUNT(*) AS done, SUM(amount) AS posted_amount, MAX(date) AS last_posted FROM dep WHERE posted GROUP BY asset_id) d ON d.asset_id = a.id""",
              rest=_board("open")))
def _(t):
    return op.depreciation_board(t.asset, _dep(t))


@FAMILY.query("c8_residual_value", sql("asset", """SELECT a.id, CAST(value - COALESCE(d.s, 0) - salvage AS DOUBLE) AS value_residual FROM asset a
    LEFT JOIN (SELECT asset_id, SUM(amount) AS s FROM dep WHERE posted GROUP BY asset_id) d ON d.asset_id = a.id""", **_DEP))
def _(t):
    return op.residual_values(t.asset, _dep(t)).select("id", "value_residual")


@FAMILY.query("c9_last_depreciation", sql("asset", """SELECT a.id, COALESCE(d.last, a.date) AS last_date FROM asset a
    LEFT JOIN (SELECT asset_id, MAX(date) AS last FROM dep WHERE posted GROUP BY asset_id) d ON d.asset_id = a.id""", **_DEP))
def _(t):
    return op.last_depreciation(t.asset, _dep(t))


@FAMILY.query("c10_disposal_lines", sql("asset", f"""SELECT a.id AS asset_id, CAST(d.done + 1 AS INT) AS sequence, DATE '{D}' AS date, CAST(value - d.s - salvage AS DOUBLE) AS amount,
    0.0 AS remaining_value, CAST(value - salvage AS DOUBLE) AS depreciated_value FROM asset a JOIN (SELECT asset_id, COUNT(*) FILTER (posted) AS done,
      COALESCE(SUM(amount) FILTER (posted), 0) AS s, COUNT(*) FILTER (NOT posted) AS open FROM dep GROUP BY asset_id) d ON d.asset_id = a.id WHERE open > 0""", **_DEP))
def _(t):
    return op.disposal_lines(t.asset, _dep(t), D)


@FAMILY.query("c11_depreciation_entries", sql("asset asset_category", """
    SELECT asset_id, sequence, name, date, depreciation_account_id AS account_id, CAST(GREATEST(-amount, 0) AS DOUBLE) AS debit, CAST(GREATEST(amount, 0) AS DOUBLE) AS credit FROM named
    UNION ALL SELECT asset_id, sequence, name, date, expense_account_id, CAST(GREATEST(amount, 0) AS DOUBLE), CAST(GREATEST(-amount, 0) AS DOUBLE) FROM named""", **_DEP,
    named="""SELECT d.asset_id, sequence, a.name || ' (' || CAST(sequence AS STRING) || '/' || CAST(COUNT(*) OVER (PARTITION BY d.asset_id) AS STRING) || ')' AS name, d.date,
      d.amount, c.depreciation_account_id, c.expense_account_id FROM dep d JOIN asset a ON a.id = d.asset_id JOIN asset_category c ON c.id = a.category_id"""))
def _(t):
    return op.depreciation_entries(_dep(t), t.asset, t.asset_category, D)


@FAMILY.query("c11_depreciation_entries_grouped", sql("asset asset_category", f"""
    SELECT category_id, name, DATE '{D}' AS date, depreciation_account_id AS account_id, 0.0 AS debit, CAST(amount AS DOUBLE) AS credit FROM per
    UNION ALL SELECT category_id, name, DATE '{D}', expense_account_id, CAST(amount AS DOUBLE), 0.0 FROM per""", **_DEP,
    per="""SELECT c.id AS category_id, c.name || ' (grouped)' AS name, depreciation_account_id, expense_account_id, SUM(d.amount) AS amount
      FROM dep d JOIN asset a ON a.id = d.asset_id JOIN asset_category c ON c.id = a.category_id WHERE NOT posted GROUP BY ALL"""))
def _(t):
    return op.depreciation_entries(_dep(t).filter("NOT posted"), t.asset, t.asset_category, D, grouped=True)


@FAMILY.query("c12_asset_analysis", sql("asset", """SELECT MIN(d.id) AS id, d.asset_id, d.date AS depreciation_date, a.date AS asset_date,
    CAST(CASE WHEN f.first = MIN(d.id) THEN a.value ELSE 0 END AS DOUBLE) AS gross_value, CAST(d.amount AS DOUBLE) AS depreciation_value,
    CAST(CASE WHEN posted THEN d.amount ELSE 0 END AS DOUBLE) AS posted_value, CAST(CASE WHEN posted THEN 0 ELSE d.amount END AS DOUBLE) AS unposted_value,
    posted, a.category_id, a.partner_id, a.state, a.company_id, COUNT(*) AS installment_nbr
    FROM dep d JOIN asset a ON a.id = d.asset_id JOIN (SELECT asset_id, MIN(id) AS first FROM dep GROUP BY asset_id) f ON f.asset_id = a.id
    GROUP BY d.amount, d.asset_id, d.date, a.date, posted, a.state, a.category_id, a.partner_id, a.company_id, a.value, f.first""", **_DEP))
def _(t):
    return op.asset_analysis(_dep(t), t.asset)


def _schedule(last: str) -> str:
    step = "CASE period WHEN 'days' THEN to_days(\"interval\") WHEN 'weeks' THEN to_days(\"interval\" * 7) WHEN 'months' THEN to_months(\"interval\") ELSE to_months(\"interval\" * 12) END"
    return f"""WITH RECURSIVE s AS (SELECT id, date_begin AS date FROM recurring WHERE date_begin <= {last}
      UNION ALL SELECT s.id, CAST(s.date + {step} AS DATE) FROM s JOIN recurring r ON r.id = s.id WHERE CAST(s.date + {step} AS DATE) <= {last}) SELECT * FROM s"""


_TODAY = date(1996, 2, 29)
_DUE = dict(occ=_schedule(f"DATE '{_TODAY}'"), due=f"""SELECT o.id, o.date, CAST(o.id AS STRING) || '/' || CAST(o.date AS STRING) AS recurring_ref FROM occ o WHERE NOT (month(o.date) <= 6 AND year(o.date) = 1995)""")


def _outstanding(t):
    posted = op.recurring_dates(t.recurring, _TODAY).filter("month(date) <= 6 AND year(date) = 1995").select(
        F.concat_ws("/", F.col("id").cast("string"), F.date_format("date", "yyyy-MM-dd")).alias("recurring_ref"))
    return op.outstanding_occurrences(t.recurring, posted, _TODAY)


@FAMILY.query("c13_recurring_dates", sql("recurring", "SELECT id, date FROM occ", occ=_schedule("date_end - 1")))
def _(t):
    return op.recurring_dates(t.recurring).select("id", "date")


@FAMILY.query("c13_recurring_dates_to_today", sql("recurring", "SELECT id, date FROM occ", occ=_DUE["occ"]))
def _(t):
    return op.recurring_dates(t.recurring, _TODAY).select("id", "date")


@FAMILY.query("c14_outstanding_occurrences", sql("recurring", "SELECT id, date, recurring_ref FROM due", **_DUE))
def _(t):
    return _outstanding(t).select("id", "date", "recurring_ref")


@FAMILY.query("c15_recurring_entries", sql("recurring", """
    SELECT recurring_ref, date, journal_id, credit_account_id AS account_id, 0.0 AS debit, CAST(amount AS DOUBLE) AS credit FROM due d JOIN recurring r ON r.id = d.id
    UNION ALL SELECT recurring_ref, date, journal_id, debit_account_id, CAST(amount AS DOUBLE), 0.0 FROM due d JOIN recurring r ON r.id = d.id""", **_DUE))
def _(t):
    return op.recurring_entries(_outstanding(t))


@FAMILY.query("c16_due_payments", sql("recurring", f"""SELECT id, date, state FROM (SELECT id, date, CASE WHEN month(date) % 3 = 0 THEN 'done' ELSE 'draft' END AS state FROM occ)
    WHERE date <= DATE '{_TODAY}' AND state <> 'done'""", occ=_schedule("date_end - 1")))
def _(t):
    lines = op.recurring_dates(t.recurring).selectExpr("id", "date", "CASE WHEN month(date) % 3 = 0 THEN 'done' ELSE 'draft' END AS state")
    return op.due_payments(lines, _TODAY)


@FAMILY.query("c17_fiscal_year_violations", sql("fiscal_year", """
    SELECT 'end_before_start' AS rule, CAST(id AS STRING) AS key, CAST(company_id AS STRING) AS detail FROM fiscal_year WHERE date_to < date_from
    UNION ALL SELECT 'overlap', CAST(id AS STRING), CAST(company_id AS STRING) FROM fiscal_year f WHERE date_to >= date_from AND EXISTS (
      SELECT 1 FROM fiscal_year o WHERE o.company_id = f.company_id AND o.id <> f.id AND o.date_to >= o.date_from AND o.date_from <= f.date_to AND o.date_to >= f.date_from)"""))
def _(t):
    return op.fiscal_year_violations(t.fiscal_year)


@FAMILY.query("c18_lock_date_violations", sql("invoice move_line", f"""
    SELECT 'unposted_entry' AS rule, CAST(id AS STRING) AS key, CAST(company_id AS STRING) AS detail FROM invoice WHERE state = 'draft' AND company_id IN (1, 2) AND invoice_date <= DATE '{POSTED_UNTIL}'
    UNION ALL SELECT 'unreconciled_statement_line', CAST(id AS STRING), CAST(company_id AS STRING) FROM move_line
    WHERE account_id = 1 AND id % 3 <> 0 AND company_id IN (1, 2) AND date <= DATE '{POSTED_UNTIL}' AND parent_state IN ('draft', 'posted')"""))
def _(t):
    moves = t.invoice.withColumnRenamed("invoice_date", "date")
    bank = t.move_line.filter("account_id = 1").selectExpr("id", "company_id", "date", "parent_state AS state", "id % 3 = 0 AS is_reconciled")
    return op.lock_date_violations(moves, bank, POSTED_UNTIL, (1, 2))


@FAMILY.query("c19_invoice_assets", sql("move_line asset_category", f"""
    SELECT m.id AS line_id, m.name, m.move_name AS code, asset_category_id, CAST(ABS(balance) AS DOUBLE) AS value, partner_id, company_id, date,
      CAST(date_trunc('month', date) AS DATE) AS start_date, CAST(date_trunc('month', date) + to_months(months) AS DATE) - 1 AS end_date,
      CASE WHEN move_type IN ('out_invoice', 'out_refund') THEN {ratio("CASE WHEN move_type LIKE '%refund' THEN -ABS(balance) ELSE ABS(balance) END", "CAST(months AS DECIMAL(18,2))")} ELSE 0 END AS monthly_revenue
    FROM move_line m JOIN (SELECT id AS cid, method_number * method_period AS months FROM asset_category) c ON c.cid = m.asset_category_id"""))
def _(t):
    lines = t.move_line.filter("asset_category_id IS NOT NULL").selectExpr(
        "*", "abs(balance) AS subtotal", "CASE WHEN move_type LIKE '%refund' THEN -abs(balance) ELSE abs(balance) END AS subtotal_signed", "date AS invoice_date")
    return op.invoice_assets(lines, t.asset_category)
