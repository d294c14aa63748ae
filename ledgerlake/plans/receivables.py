"""Receivables queries over the derived tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlake.functions.labels import bound_labels, partner_label, period_labels
from ledgerlake.operators import receivables as op
from ledgerlake.plans.base import ASOF, END, START, Family
from ledgerlake.plans.oracle import sql

FAMILY = Family()
D = date(1999, 6, 30)
AGEING = op.AgeingParams(asof=D, period=30)
BOUNDS = [30, 90, 180, 365, 730]

_MATCHED = f"""SELECT id, SUM(CASE WHEN max_date <= DATE '{D}' THEN signed ELSE 0 END) AS matched, BOOL_OR(max_date > DATE '{D}') AS later
    FROM (SELECT credit_line_id AS id, amount AS signed, max_date FROM partial UNION ALL SELECT debit_line_id, -amount, max_date FROM partial) GROUP BY id"""
_OPENED = f"""SELECT m.*, COALESCE(date_maturity, date) AS due, date_diff('day', COALESCE(date_maturity, date), DATE '{D}') AS late,
    CASE WHEN balance = 0 THEN 0 ELSE balance + COALESCE(matched, 0) END AS amount, (NOT reconciled OR COALESCE(later, FALSE)) AS listed
    FROM move_line m JOIN account a ON a.id = m.account_id AND a.account_type = 'asset_receivable' LEFT JOIN matched x ON x.id = m.id
    WHERE parent_state IN ({{states}}) AND date <= DATE '{D}'"""
_K = "CASE WHEN late <= 0 THEN 6 WHEN late <= 30 THEN 5 WHEN late <= 60 THEN 4 WHEN late <= 90 THEN 3 WHEN late <= 120 THEN 2 ELSE 1 END"
_CTES = {"matched": _MATCHED, "opened": _OPENED.format(states="'posted'")}
_B1 = f"""SELECT o.partner_id, CASE WHEN o.partner_id IS NULL THEN 'Unknown Partner' WHEN LENGTH(MAX(p.name)) >= 45 THEN SUBSTRING(MAX(p.name), 1, 40) || '...'
      ELSE MAX(p.name) END AS partner_name,
    CAST(SUM(CASE WHEN k = 6 THEN amount ELSE 0 END) AS DOUBLE) AS not_due,
    {", ".join(f"CAST(SUM(CASE WHEN k = {k} THEN amount ELSE 0 END) AS DOUBLE) AS period_{k}" for k in range(5, 0, -1))},
    CAST(SUM(amount) AS DOUBLE) AS total
    FROM (SELECT *, {_K} AS k FROM opened) o LEFT JOIN partner p ON p.id = o.partner_id GROUP BY o.partner_id
    HAVING BOOL_OR(listed) AND ({" OR ".join(f"SUM(CASE WHEN k = {k} THEN amount ELSE 0 END) <> 0" for k in range(1, 7))})"""
_BANDS = ["not_due", "period_5", "period_4", "period_3", "period_2", "period_1", "total"]


def _aged(t):
    return op.aged_balance(t.move_line, t.account, t.partial, t.partner, AGEING)


@FAMILY.query("b1_aged_balance", sql("move_line account partial partner", _B1, **_CTES))
def _(t):
    return _aged(t)


_B2 = f"""SELECT id AS line_id, partner_id, due, CAST(amount AS DOUBLE) AS amount, {_K} AS period FROM (
    SELECT *, BOOL_OR(listed) OVER (PARTITION BY partner_id) AS any_listed FROM opened) WHERE amount <> 0 AND any_listed"""


@FAMILY.query("b2_aged_lines", sql("move_line account partial", _B2, **_CTES))
def _(t):
    return op.aged_lines(t.move_line, t.account, t.partial, AGEING)


@FAMILY.query("p4_aged_lines_labelled", sql("move_line account partial", f"""SELECT label, COUNT(*) AS n, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (
    SELECT amount, CASE period WHEN 6 THEN 'Not Due' WHEN 5 THEN '1-30' WHEN 4 THEN '31-60' WHEN 3 THEN '61-90' WHEN 2 THEN '91-120' ELSE '+120' END AS label
    FROM ({_B2})) GROUP BY label""", **_CTES))
def _(t):
    labels = F.array(*[F.lit(x) for x in [*reversed(period_labels(AGEING.period)), "Not Due"]])
    rows = op.aged_lines(t.move_line, t.account, t.partial, AGEING)
    return rows.groupBy(F.element_at(labels, F.col("period")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@FAMILY.query("b3_aged_totals", sql("move_line account partial partner",
              f"SELECT {', '.join(f'CAST(SUM(CAST({b} AS DECIMAL(18,2))) AS DOUBLE) AS {b}' for b in _BANDS)} FROM ({_B1})", **_CTES))
def _(t):
    return op.aged_totals(_aged(t))


_KB = "CASE WHEN late <= 0 THEN 0 " + " ".join(f"WHEN late <= {b} THEN {i + 1}" for i, b in enumerate(BOUNDS)) + " ELSE 6 END"
_RANGES = [f"range_{i}" for i in range(7)]


# Companies book in currencies 1 to 3; the user looks at amounts in currency 2.
_FACTOR = f"""SELECT c AS company_id, CAST(ROUND((SELECT CAST(rate AS DOUBLE) FROM now WHERE currency_id = 2) / CAST(rate AS DOUBLE), 9) AS DECIMAL(18,9)) AS f
    FROM (SELECT UNNEST([1, 2, 3]) AS c) JOIN now ON currency_id = c"""
_CONVERTED = {
    "now": f"SELECT currency_id, ARG_MAX(rate, date) AS rate FROM rate WHERE date <= DATE '{D}' GROUP BY currency_id", "factor": _FACTOR,
    "partial_line": "SELECT debit_line_id, credit_line_id, max_date, ROUND(amount * f, 2) AS amount FROM partial JOIN factor USING (company_id)",
    "matched": _MATCHED.replace("FROM partial", "FROM partial_line"),
    "opened": _CTES["opened"].replace("balance = 0", "ROUND(balance * f, 2) = 0").replace("ELSE balance +", "ELSE ROUND(balance * f, 2) +").replace(
        "LEFT JOIN matched x", "JOIN factor USING (company_id) LEFT JOIN matched x")}


@FAMILY.query("b1_aged_balance_in_user_currency", sql("move_line account partial partner rate", _B1, **_CONVERTED))
def _(t):
    companies = t.spark.range(1, 4).select("id", F.col("id").alias("currency_id"))
    factors = op.currency_factors(companies, t.rate, 2, D)
    return op.aged_balance(t.move_line, t.account, t.partial, t.partner, AGEING, factors)
_B4_CTES = {"matched": _MATCHED, "opened": _OPENED.format(states="'draft', 'posted'")}


@FAMILY.query("b4_aged_buckets", sql("move_line account partial partner", f"""
    SELECT partner_id, partner_name, {", ".join(f"CAST({r} AS DOUBLE) AS {r}" for r in _RANGES)}, CAST(total AS DOUBLE) AS total, line_count FROM per
    UNION ALL SELECT NULL, 'Total', {", ".join(f"CAST(SUM({r}) AS DOUBLE)" for r in _RANGES)}, CAST(SUM(total) AS DOUBLE), CAST(SUM(line_count) AS BIGINT) FROM per""",
    **_B4_CTES, per=f"""SELECT o.partner_id, MAX(p.name) AS partner_name, {", ".join(f"SUM(CASE WHEN k = {i} THEN amount ELSE 0 END) AS range_{i}" for i in range(7))},
      SUM(amount) AS total, COUNT(*) AS line_count FROM (SELECT *, {_KB} AS k FROM opened) o JOIN partner p ON p.id = o.partner_id
      WHERE balance <> 0 GROUP BY o.partner_id"""))
def _(t):
    p = op.AgeingParams(asof=D, target_move="all")
    return op.aged_buckets(t.move_line, t.account, t.partial, t.partner, p, BOUNDS)


@FAMILY.query("b5_aged_bucket_detail", sql("move_line account partial journal", f"""
    SELECT partner_id, date, date_maturity, move_id, move_name, journal_name, account_name,
      {", ".join(f"CAST(CASE WHEN k = {i} THEN amount ELSE 0 END AS DOUBLE) AS range_{i}" for i in range(7))}
    FROM (SELECT partner_id, date, date_maturity, move_id, move_name, j.name AS journal_name, a.name AS account_name, SUM(amount) AS amount, MIN({_KB}) AS k
      FROM opened o LEFT JOIN journal j ON j.id = o.journal_id LEFT JOIN account a ON a.id = o.account_id WHERE balance <> 0 GROUP BY ALL)
    WHERE amount <> 0""", **_B4_CTES))
def _(t):
    p = op.AgeingParams(asof=D, target_move="all")
    return op.aged_bucket_detail(t.move_line, t.account, t.partial, t.journal, p, BOUNDS)


@FAMILY.query("b5_aged_bucket_detail_page", sql("move_line account partial", f"""
    SELECT partner_id, date, move_id, CAST(amount AS DOUBLE) AS amount, bucket FROM (
      SELECT partner_id, date, date_maturity, move_id, SUM(amount) AS amount,
        CASE MIN({_KB}) {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(bound_labels(BOUNDS)))} END AS bucket
      FROM opened WHERE balance <> 0 GROUP BY partner_id, date, date_maturity, move_id, account_id, journal_id)
    WHERE amount <> 0 ORDER BY date, partner_id, move_id, date_maturity OFFSET 20 LIMIT 20""", **_B4_CTES))
def _(t):
    p = op.AgeingParams(asof=D, target_move="all")
    rows = op.aged_bucket_detail(t.move_line, t.account, t.partial, t.journal, p, BOUNDS)
    ranges = [f"range_{i}" for i in range(7)]
    amount = sum((F.col(r) for r in ranges[1:]), F.col(ranges[0]))
    bucket = F.coalesce(*[F.when(F.col(r) != 0, F.lit(x)) for r, x in zip(ranges, bound_labels(BOUNDS))])
    rows = rows.select("partner_id", "date", "date_maturity", "move_id", amount.alias("amount"), bucket.alias("bucket"))
    page = op.paged(rows, [F.col(c) for c in ("date", "partner_id", "move_id", "date_maturity")], 1, 20)
    return page.drop("date_maturity")


_STATEMENT = """SELECT partner_id, id AS move_id, invoice_date AS bill_date, monthname(invoice_date) AS month, name AS reference, invoice_date_due,
    CAST(CASE WHEN move_type IN ('out_invoice', 'in_invoice') THEN amount_total ELSE 0 END AS DOUBLE) AS debit,
    CAST(CASE WHEN move_type IN ('out_refund', 'in_refund') THEN amount_total ELSE 0 END AS DOUBLE) AS credit,
    CAST(amount_residual AS DOUBLE) AS balance FROM invoice WHERE {}"""


@FAMILY.query("b7_customer_statement", sql("invoice", _STATEMENT.format(
    f"state IN ('draft', 'posted') AND move_type IN ('out_invoice', 'out_refund') AND invoice_date BETWEEN DATE '{START}' AND DATE '{END}'")))
def _(t):
    return op.statement(t.invoice, "customer", START, END)


@FAMILY.query("b7_customer_statement_sheet", sql("invoice", _STATEMENT.format("move_type IN ('out_invoice', 'out_refund', 'out_receipt')")))
def _(t):
    return op.statement(t.invoice, "customer_sheet")


@FAMILY.query("b8_supplier_statement", sql("invoice", _STATEMENT.format(
    f"state = 'posted' AND move_type IN ('in_invoice', 'in_refund') AND invoice_date BETWEEN DATE '{START}' AND DATE '{END}'")))
def _(t):
    return op.statement(t.invoice, "supplier", START, END)


@FAMILY.query("b9_partner_due", sql("invoice", f"""SELECT partner_id, CAST(SUM(amount_residual) AS DOUBLE) AS balance_due,
    CAST(SUM(CASE WHEN invoice_date_due <= DATE '{D}' THEN amount_residual ELSE 0 END) AS DOUBLE) AS overdue
    FROM invoice WHERE state = 'posted' AND move_type IN ('out_invoice', 'out_refund') GROUP BY partner_id"""))
def _(t):
    return op.partner_due(t.invoice, ["out_invoice", "out_refund"], D)


@FAMILY.query("b10_paid_amounts", sql("invoice", """SELECT id, CAST(CASE WHEN state <> 'draft' THEN amount_total - amount_residual ELSE 0 END AS DOUBLE) AS paid_amount,
    monthname(invoice_date) AS month FROM invoice"""))
def _(t):
    return op.paid_amounts(t.invoice)


_UNREC = """FROM move_line l JOIN account a ON a.id = l.account_id AND a.account_type = 'asset_receivable'
    WHERE full_reconcile_id IS NULL AND partner_id IS NOT NULL"""
_STATS = """MIN(date) AS date_move, MAX(date) AS date_move_last, MAX(followup_date) AS date_followup, MAX(followup_line_id) AS max_followup_id,
    CAST(SUM(debit) AS DOUBLE) AS debit, CAST(SUM(credit) AS DOUBLE) AS credit, CAST(SUM(debit - credit) AS DOUBLE) AS balance"""


@FAMILY.query("b11_followup_statistics", sql("move_line account", f"SELECT l.id, partner_id, company_id, {_STATS} {_UNREC} GROUP BY l.id, partner_id, company_id"))
def _(t):
    return op.followup_statistics(t.move_line, t.account)


@FAMILY.query("b12_followup_by_partner", sql("move_line account", f"""SELECT partner_id * 10000 + company_id AS id, partner_id, company_id, {_STATS}
    {_UNREC} GROUP BY partner_id, company_id"""))
def _(t):
    return op.followup_statistics(t.move_line, t.account, by_partner=True)


_STEPS = f"SELECT LAG(id) OVER (ORDER BY delay) AS prev, id AS next_level, DATE '{ASOF}' - delay AS limit_date FROM level"
_DUNNED = f"""SELECT l.id AS line_id, partner_id, partner_id * 10000 + company_id AS stat_id, followup_line_id AS old_level, next_level
    FROM move_line l JOIN account a ON a.id = l.account_id AND a.account_type = 'asset_receivable'
    JOIN steps s ON s.prev IS NOT DISTINCT FROM l.followup_line_id
    WHERE full_reconcile_id IS NULL AND partner_id IS NOT NULL AND debit > 0 AND company_id IN (1, 2) AND COALESCE(date_maturity, date) <= limit_date"""


@FAMILY.query("b13_dunning_escalation", sql("move_line account level", _DUNNED, steps=_STEPS))
def _(t):
    return op.dunning_escalation(t.move_line, t.account, t.level, ASOF, (1, 2))


@FAMILY.query("b13_dunning_update", sql("move_line account level", f"""SELECT followup_line_id, COUNT(*) AS n, MIN(followup_date) AS first_date, MAX(followup_date) AS last_date
    FROM (SELECT COALESCE(d.next_level, m.followup_line_id) AS followup_line_id, CASE WHEN d.line_id IS NOT NULL THEN DATE '{ASOF}' ELSE m.followup_date END AS followup_date
      FROM move_line m LEFT JOIN dunned d ON d.line_id = m.id) GROUP BY followup_line_id""", steps=_STEPS, dunned=_DUNNED))
def _(t):
    escalated = op.dunning_escalation(t.move_line, t.account, t.level, ASOF, (1, 2))
    return op.apply_escalation(t.move_line, escalated, ASOF).groupBy("followup_line_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("followup_date").alias("first_date"), F.max("followup_date").alias("last_date"))


@FAMILY.query("b14_partner_amounts", sql("move_line account", f"""SELECT partner_id, CAST(SUM(debit - credit) AS DOUBLE) AS amount_due,
    CAST(SUM(CASE WHEN COALESCE(date_maturity, date) <= DATE '{D}' THEN debit - credit ELSE 0 END) AS DOUBLE) AS amount_overdue,
    MIN(COALESCE(date_maturity, date)) AS earliest_due_date {_UNREC} AND company_id = 1 GROUP BY partner_id"""))
def _(t):
    return op.partner_amounts(t.move_line, t.account, D, (1,))


@FAMILY.query("b15_search_overdue", sql("move_line account partner", f"""SELECT p.id AS partner_id, CAST(COALESCE(SUM(x.b), 0) AS DOUBLE) AS amount
    FROM partner p LEFT JOIN (SELECT partner_id, debit - credit AS b {_UNREC} AND company_id = 1 AND date_maturity <= DATE '{D}') x ON x.partner_id = p.id
    GROUP BY p.id HAVING COALESCE(SUM(x.b), 0) <= 400000"""))
def _(t):
    return op.search_by_amount(t.move_line, t.account, t.partner, 1, "<=", 400000, overdue_on=D)


@FAMILY.query("b15_search_earliest_date", sql("move_line account", f"""SELECT partner_id, MIN(date_maturity) AS earliest_due_date {_UNREC} AND company_id = 1
    GROUP BY partner_id HAVING MIN(date_maturity) < DATE '1995-06-30'"""))
def _(t):
    return op.search_by_earliest_date(t.move_line, t.account, 1, "<", date(1995, 6, 30))


@FAMILY.query("b16_latest_followup", sql("move_line account level", f"""SELECT partner_id, MAX(followup_date) AS latest_followup_date,
    ARG_MAX(followup_line_id, delay) AS latest_followup_level FROM (SELECT l.*, v.delay FROM (SELECT l.* {_UNREC} AND company_id = 1) l
      LEFT JOIN level v ON v.id = l.followup_line_id) GROUP BY partner_id"""))
def _(t):
    return op.latest_followup(t.move_line, t.account, t.level, 1)


_LETTER = f"""SELECT partner_id, l.id AS line_id, move_name, ref, date, date_maturity, COALESCE(currency_id, 1) AS currency_id,
    CASE WHEN COALESCE(currency_id, 1) <> 1 THEN amount_currency ELSE debit - credit END AS balance
    {_UNREC} AND company_id = 2 AND (date_maturity IS NULL OR date_maturity <= DATE '{D}')"""


@FAMILY.query("b17_letter_lines", sql("move_line account", f"SELECT * REPLACE (CAST(balance AS DOUBLE) AS balance) FROM ({_LETTER})"))
def _(t):
    return op.letter_lines(t.move_line, t.account, 2, D)


@FAMILY.query("b17_letter_totals", sql("move_line account", f"""SELECT partner_id, currency_id, CAST(SUM(balance) AS DOUBLE) AS currency_total, COUNT(*) AS line_count,
    CAST(SUM(SUM(balance)) OVER (PARTITION BY partner_id) AS DOUBLE) AS total FROM ({_LETTER}) GROUP BY partner_id, currency_id"""))
def _(t):
    return op.letter_totals(op.letter_lines(t.move_line, t.account, 2, D))


@FAMILY.query("b17_letter_texts", sql("move_line account level", f"""SELECT partner_id, COALESCE(ARG_MAX(v.description, v.delay), 'first reminder') AS text
    FROM (SELECT l.* {_UNREC} AND company_id = 2 AND debit <> 0) l LEFT JOIN level v ON v.id = l.followup_line_id GROUP BY partner_id"""))
def _(t):
    return op.letter_texts(t.move_line, t.account, t.level, 2)


_BODY = " for %(partner_name)s of %(date)s, 100%% due. %(company_name)s %(user_signature)s"


@FAMILY.query("b17_letters_filled", sql("move_line account level partner", f"""SELECT t.partner_id,
    text || ' for ' || COALESCE(p.name, '') || ' of {D.strftime("%d/%m/%Y")}, 100% due. ledger & lake -- The office' AS text
    FROM (SELECT partner_id, COALESCE(ARG_MAX(v.description, v.delay), 'first reminder') AS text
      FROM (SELECT l.* {_UNREC} AND company_id = 2 AND debit <> 0) l LEFT JOIN level v ON v.id = l.followup_line_id GROUP BY partner_id) t
    LEFT JOIN partner p ON p.id = t.partner_id"""))
def _(t):
    levels = t.level.withColumn("description", F.concat("description", F.lit(_BODY)))
    return op.filled_letters(op.letter_texts(t.move_line, t.account, levels, 2), t.partner, D, "ledger & lake", "-- The office", "dd/MM/yyyy")


@FAMILY.query("b18_followup_status", sql("invoice level", f"""SELECT partner_id, CAST(total_due AS DOUBLE) AS total_due, CAST(total_overdue AS DOUBLE) AS total_overdue, next_reminder_date,
    CASE WHEN total_overdue > 0 AND next_reminder_date > DATE '{D}' THEN 'with_overdue_invoices'
         WHEN total_due > 0 AND next_reminder_date <= DATE '{D}' THEN 'in_need_of_action' ELSE 'no_action_needed' END AS followup_status
    FROM (SELECT partner_id, SUM(amount_residual) AS total_due, SUM(CASE WHEN DATE '{D}' > invoice_date_due THEN amount_residual ELSE 0 END) AS total_overdue,
      MIN(invoice_date_due) + (SELECT MIN(delay) FROM level) AS next_reminder_date FROM invoice
      WHERE move_type = 'out_invoice' AND state = 'posted' AND amount_residual > 0 GROUP BY partner_id)"""))
def _(t):
    unpaid = t.invoice.filter("move_type = 'out_invoice' AND state = 'posted' AND amount_residual > 0")
    return op.followup_status(unpaid, t.level, D)


@FAMILY.query("b19_credit_limits", sql("partner invoice", """SELECT p.id AS partner_id, p.name, CAST(COALESCE(due, 0) AS DOUBLE) AS due_amount, COALESCE(active_limit, FALSE) AND COALESCE(due, 0) > 0 AS has_due,
    COALESCE(active_limit, FALSE) AND warning_stage <> 0 AND COALESCE(due, 0) >= warning_stage AS is_warning,
    COALESCE(active_limit, FALSE) AND blocking_stage <> 0 AND COALESCE(due, 0) >= blocking_stage AS is_blocked
    FROM partner p LEFT JOIN (SELECT partner_id, SUM(CASE WHEN move_type = 'out_invoice' THEN amount_residual WHEN move_type = 'out_refund' THEN -amount_residual ELSE 0 END)
      - SUM(CASE WHEN move_type = 'in_invoice' THEN amount_residual WHEN move_type = 'in_refund' THEN -amount_residual ELSE 0 END) AS due
      FROM invoice WHERE state = 'posted' GROUP BY partner_id) b ON b.partner_id = p.id"""))
def _(t):
    sign = F.when(F.col("move_type").endswith("refund"), -F.col("amount_residual")).otherwise(F.col("amount_residual"))
    posted = t.invoice.filter("state = 'posted'").withColumn("signed", sign)
    balances = posted.groupBy("partner_id").agg(
        op.sum_if(F.col("move_type").startswith("out_"), "signed", "credit"), op.sum_if(F.col("move_type").startswith("in_"), "signed", "debit"))
    return op.credit_limits(balances, t.partner)


@FAMILY.query("b20_partners_page", sql("move_line account partner", """SELECT p.id AS partner_id, p.name FROM partner p
    WHERE p.id IN (SELECT partner_id FROM move_line m JOIN account a ON a.id = m.account_id AND a.account_type = 'asset_receivable')
    ORDER BY p.name, p.id OFFSET 20 LIMIT 10"""))
def _(t):
    return op.partners_with_lines(t.move_line, t.account, t.partner, (op.RECEIVABLE,), page=2)


@FAMILY.query("b20_partners_next_page", sql("move_line account partner", """SELECT p.id AS partner_id, p.name FROM partner p
    WHERE p.id IN (SELECT partner_id FROM move_line m JOIN account a ON a.id = m.account_id AND a.account_type = 'asset_receivable')
    ORDER BY p.name, p.id OFFSET 10 LIMIT 10"""))
def _(t):
    first = op.partners_with_lines(t.move_line, t.account, t.partner, (op.RECEIVABLE,))
    return op.partners_with_lines(t.move_line, t.account, t.partner, (op.RECEIVABLE,), after=op.cursor(first, ["name", "partner_id"]))


@FAMILY.query("p3_partner_label", sql("partner", """SELECT id AS partner_id, CASE WHEN LENGTH(long_name) >= 45 THEN SUBSTRING(long_name, 1, 40) || '...' ELSE long_name END AS label
    FROM (SELECT id, name || CASE WHEN id % 2 = 0 THEN ' of the northern trading company' ELSE '' END AS long_name FROM partner)"""))
def _(t):
    long_name = F.concat("name", F.when(F.col("id") % 2 == 0, F.lit(" of the northern trading company")).otherwise(F.lit("")))
    return t.partner.select(F.col("id").alias("partner_id"), long_name.alias("name")).select("partner_id", partner_label().alias("label"))
