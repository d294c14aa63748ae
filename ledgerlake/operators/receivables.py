"""Ageing, statements, dunning and credit limits."""

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.filters import states
from ledgerlake.functions.labels import month_name, partner_label
from ledgerlake.functions.prefix import used
from ledgerlake.operators.ledger import MONEY, money, sum_if, sums

RECEIVABLE, PAYABLE = "asset_receivable", "liability_payable"
NOT_DUE = 6
PARTNER_PAGE = 10


@dataclass(frozen=True)
class AgeingParams:
    """As-of date, equal period length, and which lines count."""

    asof: date
    period: int = 30
    account_types: tuple[str, ...] = (RECEIVABLE,)
    target_move: str = "posted"
    company_ids: tuple[int, ...] = ()
    partner_ids: tuple[int, ...] = ()


def _due() -> Column:
    return F.coalesce("date_maturity", "date")


def currency_factors(companies: DataFrame, rates: DataFrame, currency_id: int, day: date) -> DataFrame:
    """What an amount of each company is multiplied by to be in ``currency_id`` at the rates of ``day`` (company_id, factor).

    ``companies`` has id and currency_id; rates are units per base unit, the latest one up to the day counts and a currency without one is the base.
    """
    valid = rates.filter(F.col("date") <= F.lit(day)).groupBy("currency_id").agg(F.max_by("rate", "date").cast("double").alias("rate"))
    wanted = valid.filter(F.col("currency_id") == currency_id).agg(F.max("rate")).scalar()
    own = companies.select(F.col("id").alias("company_id"), "currency_id").join(valid, "currency_id", "left")
    return own.select("company_id", F.round(F.coalesce(wanted, F.lit(1.0)) / F.coalesce("rate", F.lit(1.0)), 9).cast("decimal(18,9)").alias("factor"))


def _converted(rows: DataFrame, amount: str, factors: DataFrame | None) -> DataFrame:
    """``amount`` in the currency of ``factors``, each row rounded by itself; companies without a factor keep theirs."""
    if factors is None:
        return rows
    out = rows.join(factors, "company_id", "left").withColumn(amount, F.round(F.col(amount) * F.coalesce("factor", F.lit(1).cast("decimal(18,9)")), 2).cast(MONEY))
    return out.select(*rows.columns)


def matched_by_line(partials: DataFrame, asof: date, factors: DataFrame | None = None) -> DataFrame:
    """Per line: net amount matched up to the day, and whether something was matched later.

    A match counts positive on its credit line and negative on its debit line. Both sides are one
    exploded pass, combined map-side before the shuffle. With ``factors`` every match is converted by its ``company_id``.
    """
    partials = _converted(partials, "amount", factors)
    sides = partials.select("max_date", F.explode(F.array(
        F.struct(F.col("credit_line_id").alias("id"), F.col("amount").alias("signed")),
        F.struct(F.col("debit_line_id").alias("id"), (-F.col("amount")).cast(MONEY).alias("signed")))).alias("s"))
    upto = F.col("max_date") <= F.lit(asof)
    return sides.select("max_date", "s.id", "s.signed").groupBy("id").agg(
        money(F.sum(F.when(upto, F.col("signed")))).alias("matched"),
        F.max(F.col("max_date") > F.lit(asof)).alias("matched_later"))


def _typed(lines: DataFrame, accounts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    chosen = accounts.filter(F.col("account_type").isin(list(types))).select(F.col("id").alias("account_id"))
    return lines.join(chosen, "account_id", "left_semi")


def open_lines(lines: DataFrame, accounts: DataFrame, partials: DataFrame, p: AgeingParams, factors: DataFrame | None = None) -> DataFrame:
    """Ledger lines with their amount open on the as-of date, in company currency or, with ``factors``, in that of the user."""
    base = _typed(lines, accounts, p.account_types).filter(
        F.col("parent_state").isin(states(p.target_move)) & (F.col("date") <= F.lit(p.asof)))
    if p.company_ids:
        base = base.filter(F.col("company_id").isin(list(p.company_ids)))
    if p.partner_ids:
        base = base.filter(F.col("partner_id").isin(list(p.partner_ids)) | F.col("partner_id").isNull())
    matched = matched_by_line(partials, p.asof, factors)
    base = _converted(base, "balance", factors)
    return (base.join(matched, "id", "left")
            .withColumn("due", _due())
            .withColumn("listed", ~F.coalesce("reconciled", F.lit(False)) | F.coalesce("matched_later", F.lit(False)))
            .withColumn("amount", F.when(F.round("balance", 2) == 0, F.lit(0).cast(MONEY))
                        .otherwise((F.col("balance") + F.coalesce("matched", F.lit(0))).cast(MONEY))))


def period_index(due: Column, asof: date, period: int) -> Column:
    """1 is the oldest band, 5 the newest overdue one, 6 not yet due."""
    late = F.datediff(F.lit(asof), due)
    overdue = F.lit(5) - F.least(F.floor((late - 1) / F.lit(period)), F.lit(4)).cast("int")
    return F.when(late <= 0, F.lit(NOT_DUE)).otherwise(overdue)


def aged_lines(lines: DataFrame, accounts: DataFrame, partials: DataFrame, p: AgeingParams, factors: DataFrame | None = None) -> DataFrame:
    """Each contributing line with its amount and period (B2); unlisted partners are left out. ``factors``: see ``currency_factors``."""
    opened = open_lines(lines, accounts, partials, p, factors).select(
        F.col("id").alias("line_id"), "partner_id", "due", "amount", "listed", F.coalesce("partner_id", F.lit(-1)).alias("_p"))
    # Both sides read the same columns, so lines and matches meet once: a line that is listed itself needs no other line of its partner.
    partners = opened.groupBy("_p").agg(F.max("listed").alias("_any"), used(opened)).filter(F.col("_used").isNotNull())
    rows, owner = opened.filter(F.round("amount", 2) != 0).alias("l"), partners.alias("o")
    kept = rows.join(owner, (F.col("l._p") == F.col("o._p")) & (F.col("l.listed") | F.col("o._any")), "left_semi")
    return kept.select("line_id", "partner_id", "due", "amount", period_index(F.col("due"), p.asof, p.period).alias("period"))


_BANDS = ["not_due", "period_5", "period_4", "period_3", "period_2", "period_1"]


def aged_balance(lines: DataFrame, accounts: DataFrame, partials: DataFrame, partners: DataFrame, p: AgeingParams,
                 factors: DataFrame | None = None) -> DataFrame:
    """Open amounts per partner and period (B1); partners with nothing open are dropped.

    ``period_5`` is the newest overdue band and ``period_1`` the oldest. ``factors`` turn all amounts into one currency (``currency_factors``).
    """
    opened = open_lines(lines, accounts, partials, p, factors).withColumn("_k", period_index(F.col("due"), p.asof, p.period))
    bands = [sum_if(F.col("_k") == NOT_DUE, "amount", "not_due")]
    bands += [sum_if(F.col("_k") == k, "amount", f"period_{k}") for k in range(5, 0, -1)]
    per = opened.groupBy("partner_id").agg(*bands, F.max("listed").alias("_listed"))
    kept = per.filter(F.col("_listed") & (F.greatest(*[F.abs(F.round(b, 2)) for b in _BANDS]) > 0))
    total = sum((F.col(b) for b in _BANDS[1:]), F.col(_BANDS[0]))
    names = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("_name"))
    return kept.join(names, "partner_id", "left").select(
        "partner_id", partner_label("_name").alias("partner_name"), *_BANDS, total.cast(MONEY).alias("total"))


def aged_totals(balances: DataFrame) -> DataFrame:
    """Column totals over the partners."""
    return balances.agg(*sums(*_BANDS, "total"))


def bucket_index(due: Column, asof: date, bounds: list[int]) -> Column:
    """0 not due, then one index per upper limit, the last one beyond all limits."""
    late = F.datediff(F.lit(asof), due)
    out = F.when(late <= 0, F.lit(0))
    for i, bound in enumerate(bounds):
        out = out.when(late <= bound, F.lit(i + 1))
    return out.otherwise(F.lit(len(bounds) + 1))


def aged_buckets(lines: DataFrame, accounts: DataFrame, partials: DataFrame, partners: DataFrame, p: AgeingParams,
                 bounds: list[int], with_total: bool = True) -> DataFrame:
    """Ageing with freely chosen limits (B4), closed by a total row without partner."""
    opened = open_lines(lines, accounts, partials, p).filter((F.col("balance") != 0) & F.col("partner_id").isNotNull())
    opened = opened.withColumn("_k", bucket_index(F.col("due"), p.asof, bounds))
    ranges = [f"range_{i}" for i in range(len(bounds) + 2)]
    per = opened.groupBy("partner_id").agg(*[sum_if(F.col("_k") == i, "amount", r) for i, r in enumerate(ranges)],
                                           money(F.sum("amount")).alias("total"), F.count(F.lit(1)).alias("line_count"))
    names = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("partner_name"))
    out = per.join(names, "partner_id").select("partner_id", "partner_name", *ranges, "total", "line_count")
    if with_total:
        total = out.agg(*sums(*ranges, "total"), F.sum("line_count").alias("line_count")).select(
            F.lit(None).cast("long").alias("partner_id"), F.lit("Total").alias("partner_name"), *ranges, "total", "line_count")
        out = out.unionByName(total)
    return out


def aged_bucket_detail(lines: DataFrame, accounts: DataFrame, partials: DataFrame, journals: DataFrame, p: AgeingParams,
                       bounds: list[int]) -> DataFrame:
    """Open amounts per document and due date (B5); rows without any amount are dropped.

    Present a partner's rows by ``date``; page with ``paged`` or, from page to page, with ``next_page``.
    """
    opened = open_lines(lines, accounts, partials, p).filter((F.col("balance") != 0) & F.col("partner_id").isNotNull())
    keys = ["partner_id", "date", "date_maturity", "move_id", "move_name", "journal_id", "account_id"]
    ranges = [f"range_{i}" for i in range(len(bounds) + 2)]
    k = bucket_index(F.col("due"), p.asof, bounds)
    cells = opened.groupBy(*keys).agg(money(F.sum("amount")).alias("amount"), F.min(k).alias("_k"))
    out = cells.filter(F.col("amount") != 0)
    j = journals.select(F.col("id").alias("journal_id"), F.col("name").alias("journal_name"))
    a = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    zero = F.lit(0).cast(MONEY)
    return out.join(j, "journal_id", "left").join(a, "account_id", "left").select(
        "partner_id", "date", "date_maturity", "move_id", "move_name", "journal_name", "account_name",
        *[F.when(F.col("_k") == i, F.col("amount")).otherwise(zero).alias(r) for i, r in enumerate(ranges)])


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered result; a bounded top-k, not a full sort."""
    return df.orderBy(*order).offset(page * size).limit(size)


def next_page(df: DataFrame, order: list[str], size: int, after: Column | None = None) -> DataFrame:
    """The ``size`` rows that follow the cursor ``after``, a struct of the ``order`` columns of the last row seen (see ``cursor``); null sorts first.

    Unlike an offset, no earlier row is kept or sorted, so the hundredth page costs what the first one does. ``order`` should tell rows apart.
    """
    later = df if after is None else df.filter(F.struct(*order) > after)
    return later.orderBy(*order).limit(size)


def cursor(page: DataFrame, order: list[str]) -> Column:
    """Where a page ends, for ``next_page``."""
    return page.agg(F.max(F.struct(*order))).scalar()


def partners_with_lines(lines: DataFrame, accounts: DataFrame, partners: DataFrame, types: tuple[str, ...],
                        page: int = 0, size: int = PARTNER_PAGE, after: Column | None = None) -> DataFrame:
    """A page of the partners that have such lines, by name (B20): by its number, or the one after a cursor of (name, partner_id)."""
    used = _typed(lines, accounts, types).filter(F.col("partner_id").isNotNull()).select(F.col("partner_id").alias("id")).distinct()
    named = partners.join(used, "id", "left_semi").select(F.col("id").alias("partner_id"), "name")
    return paged(named, [F.col("name"), F.col("partner_id")], page, size) if after is None else next_page(named, ["name", "partner_id"], size, after)


# Document kinds per statement.
STATEMENTS = {
    "customer": (["draft", "posted"], ["out_invoice", "out_refund"]),
    "customer_sheet": (["draft", "posted", "cancel"], ["out_invoice", "out_refund", "out_receipt"]),
    "supplier": (["posted"], ["in_invoice", "in_refund"]),
}


def statement(invoices: DataFrame, kind: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Documents of a partner statement (B7, B8); present by ``partner_id, bill_date``."""
    kept_states, kinds = STATEMENTS[kind]
    docs = invoices.filter(F.col("state").isin(kept_states) & F.col("move_type").isin(kinds))
    if start:
        docs = docs.filter(F.col("invoice_date") >= F.lit(start))
    if end:
        docs = docs.filter(F.col("invoice_date") <= F.lit(end))
    zero = F.lit(0).cast(MONEY)
    return docs.select(
        "partner_id", F.col("id").alias("move_id"), F.col("invoice_date").alias("bill_date"),
        F.coalesce(month_name("invoice_date"), F.lit("")).alias("month"), F.col("name").alias("reference"), "invoice_date_due",
        F.when(F.col("move_type").isin("out_invoice", "in_invoice"), F.col("amount_total")).otherwise(zero).alias("debit"),
        F.when(F.col("move_type").isin("out_refund", "in_refund"), F.col("amount_total")).otherwise(zero).alias("credit"),
        F.col("amount_residual").alias("balance"))


def partner_due(invoices: DataFrame, kinds: list[str], today: date) -> DataFrame:
    """Posted residual per partner, and the part already due."""
    docs = invoices.filter((F.col("state") == "posted") & F.col("move_type").isin(kinds))
    return docs.groupBy("partner_id").agg(
        money(F.sum("amount_residual")).alias("balance_due"),
        sum_if(F.col("invoice_date_due") <= F.lit(today), "amount_residual", "overdue"))


def paid_amounts(invoices: DataFrame) -> DataFrame:
    """Amount paid and month name of each document."""
    paid = F.when(F.col("state") != "draft", F.col("amount_total") - F.col("amount_residual")).otherwise(F.lit(0))
    return invoices.select("id", paid.cast(MONEY).alias("paid_amount"),
                           F.coalesce(month_name("invoice_date"), F.lit("")).alias("month"))


def _unreconciled(lines: DataFrame, accounts: DataFrame) -> DataFrame:
    return _typed(lines, accounts, (RECEIVABLE,)).filter(F.col("full_reconcile_id").isNull() & F.col("partner_id").isNotNull())


def followup_statistics(lines: DataFrame, accounts: DataFrame, by_partner: bool = False) -> DataFrame:
    """Follow-up state per unreconciled receivable line (B11) or per partner and company."""
    base = _unreconciled(lines, accounts)
    keys = ["partner_id", "company_id"] if by_partner else ["id", "partner_id", "company_id"]
    out = base.groupBy(*keys).agg(
        F.min("date").alias("date_move"), F.max("date").alias("date_move_last"), F.max("followup_date").alias("date_followup"),
        F.max("followup_line_id").alias("max_followup_id"), *sums("debit", "credit"),
        F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("balance"))
    if by_partner:
        out = out.withColumn("id", F.col("partner_id") * 10000 + F.col("company_id"))
    return out


def dunning_escalation(lines: DataFrame, accounts: DataFrame, levels: DataFrame, run_date: date,
                       company_ids: tuple[int, ...] = ()) -> DataFrame:
    """Lines that move to their next reminder level on the run date.

    The level table is small; each level is paired with the one before it in order of delay.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("delay")
    steps = levels.select(F.lag("id").over(w).alias("followup_line_id"), F.col("id").alias("next_level"),
                          F.date_sub(F.lit(run_date), F.col("delay")).alias("limit_date"))
    base = _unreconciled(lines, accounts).filter(F.col("debit") > 0)
    if company_ids:
        base = base.filter(F.col("company_id").isin(list(company_ids)))
    due = base.alias("l").join(steps.alias("s"), F.col("l.followup_line_id").eqNullSafe(F.col("s.followup_line_id")))
    return due.filter(F.coalesce("date_maturity", "date") <= F.col("limit_date")).select(
        F.col("l.id").alias("line_id"), "partner_id", (F.col("partner_id") * 10000 + F.col("company_id")).alias("stat_id"),
        F.col("l.followup_line_id").alias("old_level"), "next_level")


def apply_escalation(lines: DataFrame, escalated: DataFrame, run_date: date) -> DataFrame:
    """Lines with their new level and follow-up date (B13 update)."""
    new = escalated.select(F.col("line_id").alias("id"), "next_level")
    return (lines.join(new, "id", "left")
            .withColumn("followup_date", F.when(F.col("next_level").isNotNull(), F.lit(run_date)).otherwise(F.col("followup_date")))
            .withColumn("followup_line_id", F.coalesce("next_level", "followup_line_id")).select(*lines.columns))


def partner_amounts(lines: DataFrame, accounts: DataFrame, today: date, company_ids: tuple[int, ...] = ()) -> DataFrame:
    """Due and overdue amounts and the worst due date per partner."""
    base = _unreconciled(lines, accounts)
    if company_ids:
        base = base.filter(F.col("company_id").isin(list(company_ids)))
    amount = base.withColumn("_a", (F.col("debit") - F.col("credit")).cast(MONEY))
    return amount.groupBy("partner_id").agg(
        money(F.sum("_a")).alias("amount_due"), sum_if(_due() <= F.lit(today), "_a", "amount_overdue"),
        F.min(_due()).alias("earliest_due_date"))


_OPERATORS = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
}


def search_by_amount(lines: DataFrame, accounts: DataFrame, partners: DataFrame, company_id: int, operator: str, value,
                     overdue_on: date | None = None) -> DataFrame:
    """Partners whose due (or overdue) amount compares as asked; partners without lines count as zero."""
    base = _unreconciled(lines, accounts).filter(F.col("company_id") == company_id)
    if overdue_on:
        base = base.filter(F.col("date_maturity") <= F.lit(overdue_on))
    due = base.groupBy("partner_id").agg(F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("_b"))
    everyone = due.join(partners.select(F.col("id").alias("partner_id")), "partner_id", "right")
    out = everyone.select("partner_id", money(F.col("_b")).alias("amount"))
    return out.filter(_OPERATORS[operator](F.col("amount"), F.lit(value).cast(MONEY)))


def search_by_earliest_date(lines: DataFrame, accounts: DataFrame, company_id: int, operator: str, day: date) -> DataFrame:
    """Partners whose earliest maturity compares as asked."""
    base = _unreconciled(lines, accounts).filter(F.col("company_id") == company_id)
    out = base.groupBy("partner_id").agg(F.min("date_maturity").alias("earliest_due_date"))
    return out.filter(_OPERATORS[operator](F.col("earliest_due_date"), F.lit(day)))


def latest_followup(lines: DataFrame, accounts: DataFrame, levels: DataFrame, company_id: int) -> DataFrame:
    """Latest follow-up date and the level with the longest delay per partner."""
    base = _unreconciled(lines, accounts).filter(F.col("company_id") == company_id)
    lv = levels.select(F.col("id").alias("followup_line_id"), "delay")
    return base.join(lv, "followup_line_id", "left").groupBy("partner_id").agg(
        F.max("followup_date").alias("latest_followup_date"), F.max_by("followup_line_id", "delay").alias("latest_followup_level"))


def letter_lines(lines: DataFrame, accounts: DataFrame, company_id: int, today: date, company_currency: int = 1) -> DataFrame:
    """Due unreconciled lines of a reminder letter; foreign lines show the foreign amount."""
    base = _unreconciled(lines, accounts).filter(
        (F.col("company_id") == company_id) & (F.col("date_maturity").isNull() | (F.col("date_maturity") <= F.lit(today))))
    currency = F.coalesce("currency_id", F.lit(company_currency))
    amount = F.when(currency != company_currency, F.col("amount_currency")).otherwise(F.col("debit") - F.col("credit"))
    return base.select("partner_id", F.col("id").alias("line_id"), "move_name", "ref", "date", "date_maturity",
                       currency.alias("currency_id"), amount.cast(MONEY).alias("balance"))


def letter_totals(letter: DataFrame) -> DataFrame:
    """Amounts per partner and currency, with the partner's overall figure."""
    per = letter.groupBy("partner_id", "currency_id").agg(money(F.sum("balance")).alias("currency_total"), F.count(F.lit(1)).alias("line_count"))
    return per.withColumn("total", F.sum("currency_total").over(Window.partitionBy("partner_id")).cast(MONEY))


def letter_texts(lines: DataFrame, accounts: DataFrame, levels: DataFrame, company_id: int) -> DataFrame:
    """Text of the level with the longest delay reached, else the first level's text."""
    base = _unreconciled(lines, accounts).filter((F.col("company_id") == company_id) & (F.col("debit") != 0))
    lv = levels.filter(F.coalesce("description", F.lit("")) != "").select(F.col("id").alias("followup_line_id"), "delay", "description")
    default = levels.filter(F.coalesce("description", F.lit("")) != "").agg(F.min_by("description", "delay")).scalar()
    return base.join(lv, "followup_line_id", "left").groupBy("partner_id").agg(
        F.max_by("description", F.when(F.col("delay") > 0, F.col("delay"))).alias("_text")).select(
        "partner_id", F.coalesce("_text", default).alias("text"))


# Placeholders of a letter.
PLACEHOLDERS = ("partner_name", "date", "company_name", "user_signature")


def filled_letters(texts: DataFrame, partners: DataFrame, day: date, company_name: str, signature: str = "", date_format: str | Column = "yyyy-MM-dd") -> DataFrame:
    """Letter texts (partner_id, text) with their placeholders filled in.

    ``date_format`` may be a column of ``partners``, for the partner's language; where it is null the ISO form counts. A name that is missing is empty, and
    ``%%`` is a percent sign.
    """
    fmt = F.lit(date_format) if isinstance(date_format, str) else F.coalesce(date_format, F.lit("yyyy-MM-dd"))
    named = partners.select(F.col("id").alias("partner_id"), F.coalesce("name", F.lit("")).alias("_name"), F.call_function("date_format", F.lit(day), fmt).alias("_day"))
    values = dict(zip(PLACEHOLDERS, (F.coalesce("_name", F.lit("")), F.coalesce("_day", F.lit(day.isoformat())), F.lit(company_name), F.lit(signature))))
    # Values may hold a placeholder or percent signs themselves, so the text is taken apart once and never read again.
    pieces = F.split("text", r"(?=%%|%\((?:" + "|".join(PLACEHOLDERS) + r")\)s)|(?<=%%)|(?<=\)s)")
    value = lambda x: reduce(lambda c, n: c.when(x == f"%({n})s", values[n]), PLACEHOLDERS, F.when(x == "%%", F.lit("%"))).otherwise(x)
    return texts.join(named, "partner_id", "left").select("partner_id", F.array_join(F.transform(pieces, value), "").alias("text"))


def followup_status(invoices: DataFrame, levels: DataFrame, today: date) -> DataFrame:
    """Amounts due, next reminder and status per partner (B18); reads unpaid customer invoices."""
    delay = levels.agg(F.min("delay")).scalar()
    day = F.coalesce("invoice_date_due", "invoice_date")
    per = invoices.groupBy("partner_id").agg(
        money(F.sum("amount_residual")).alias("total_due"), sum_if(F.lit(today) > day, "amount_residual", "total_overdue"),
        F.min("invoice_date_due").alias("_min_due"))
    reminder = F.coalesce(F.date_add("_min_due", F.coalesce(delay, F.lit(0))), F.lit(today))
    out = per.withColumn("next_reminder_date", reminder).drop("_min_due")
    now = F.lit(today)
    status = (F.when((F.col("total_overdue") > 0) & (F.col("next_reminder_date") > now), "with_overdue_invoices")
              .when((F.col("total_due") > 0) & (F.col("next_reminder_date") <= now), "in_need_of_action")
              .otherwise("no_action_needed"))
    return out.withColumn("followup_status", status)


def credit_limits(balances: DataFrame, partners: DataFrame, enabled: bool = True) -> DataFrame:
    """Amount due against the partner's warning and blocking limits; a limit of 0 is off.

    ``balances`` holds one row per partner with the receivable (``credit``) and payable (``debit``) side. Limits count only where they are
    ``enabled`` at all and the partner has them switched on (``active_limit``); elsewhere nothing is flagged.
    """
    active = (F.coalesce("active_limit", F.lit(False)) if "active_limit" in partners.columns else F.lit(True)) & F.lit(enabled)
    p = partners.select(F.col("id").alias("partner_id"), "name", "warning_stage", "blocking_stage", active.alias("_on"))
    due = (F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))).cast(MONEY)
    out = p.join(balances, "partner_id", "left").withColumn("due_amount", due)
    over = {s: F.col("_on") & (F.col(f"{s}_stage") != 0) & (F.col("due_amount") >= F.col(f"{s}_stage")) for s in ("warning", "blocking")}
    return out.select("partner_id", "name", "due_amount", (F.col("_on") & (F.col("due_amount") > 0)).alias("has_due"),
                      over["warning"].alias("is_warning"), over["blocking"].alias("is_blocked"))
