"""Budgets, asset depreciation, recurring entries, fiscal years."""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.prefix import block, range_sums, running_totals
from ledgerlake.functions.schedule import count_steps_until, schedule_dates
from ledgerlake.operators.ledger import MONEY, money
from ledgerlake.operators.procurement import violations

AMOUNT = "decimal(28,6)"


# --- budgets -------------------------------------------------------------------------------------

def practical_amounts(budget_lines: DataFrame, analytic_lines: DataFrame, ledger_lines: DataFrame | None,
                      window: tuple[date, date] | None = None) -> DataFrame:
    """What was really booked on each budget line.

    With an analytic account: its lines in the range, on the position's accounts if there are any.
    Otherwise credit less debit on the position's accounts. Without ``ledger_lines`` only the analytic
    form is computed, and then a position without accounts gives nothing. ``window`` overrides the range.
    """
    whole, none = F.lit(-1).cast("long"), F.lit(0).cast("long")
    start, end = (F.lit(window[0]), F.lit(window[1])) if window else (F.col("date_from"), F.col("date_to"))
    accounts = F.coalesce(F.array_distinct("account_ids"), F.array().cast("array<long>"))
    analytic_only = ledger_lines is None
    if not analytic_only:
        accounts = F.when((F.size(accounts) == 0) & F.col("analytic_id").isNotNull(), F.array(whole)).otherwise(accounts)
    wanted = budget_lines.filter(F.col("analytic_id").isNotNull()) if analytic_only else budget_lines
    ranges = wanted.select("id", F.coalesce("analytic_id", none).alias("analytic"), F.explode(accounts).alias("account"),
                           start.alias("start"), end.alias("end"))
    facts = analytic_lines.select(F.col("analytic_id").alias("analytic"), "general_account_id", "date", "amount")
    facts = facts.withColumn("account", F.explode(F.array(F.col("general_account_id"), whole))).select("analytic", "account", "date", "amount")
    if not analytic_only:
        booked = ledger_lines.select(none.alias("analytic"), F.col("account_id").alias("account"), "date",
                                     (F.col("credit") - F.col("debit")).cast(MONEY).alias("amount"))
        facts = facts.unionByName(booked)
    if window:
        facts = facts.filter(F.col("date").between(F.lit(window[0]), F.lit(window[1])))
    sums = range_sums(facts, ranges, ["analytic", "account"], "id").withColumnRenamed("amount", "_amount")
    return budget_lines.join(sums, "id", "left").withColumn("practical_amount", money(F.col("_amount"))).drop("_amount")


def theoretical_amounts(budget_lines: DataFrame, asof: date, count_days: bool = False) -> DataFrame:
    """What should have been booked by the day (C2): nothing before the start, a share inside, all after.

    ``count_days`` counts both end days and compares a paid date with the end of the line instead.
    """
    today, first, last = F.lit(asof), F.col("date_from"), F.col("date_to")
    extra = 1 if count_days else 0
    total, elapsed = F.datediff(last, first) + extra, F.datediff(today, first) + extra
    unpaid = (last <= F.col("paid_date")) if count_days else (today <= F.col("paid_date"))
    inside = (F.datediff(last, first) > 0) & (today < last)
    share = F.round(F.col("planned") * elapsed / F.nullif(total, F.lit(0)), 6)
    theory = (F.when(F.col("paid_date").isNotNull(), F.when(unpaid, F.lit(0)).otherwise(F.col("planned")))
              .when(F.datediff(today, first) < 0, F.lit(0)).when(inside, share).otherwise(F.col("planned")))
    return budget_lines.withColumn("theoretical_amount", theory.cast(AMOUNT))


def theoretical_in_window(budget_lines: DataFrame, start: date, end: date) -> DataFrame:
    """The planned share that falls into a chosen window (C2, window form)."""
    lo = F.when(F.lit(start) > F.col("date_to"), None).otherwise(F.greatest(F.lit(start), F.col("date_from")))
    hi = F.when(F.lit(end) < F.col("date_from"), None).otherwise(F.least(F.lit(end), F.col("date_to")))
    elapsed = F.datediff(hi, lo)
    share = F.round(F.col("planned") * elapsed / F.nullif(F.datediff("date_to", "date_from"), F.lit(0)), 6)
    return budget_lines.withColumn("theoretical_amount", F.coalesce(F.when(elapsed > 0, share), F.lit(0)).cast(AMOUNT))


def _achieved(factor: int) -> Column:
    value = F.round(F.col("practical_amount") * factor / F.nullif(F.col("theoretical_amount"), F.lit(0)), 6)
    return F.coalesce(value, F.lit(0)).cast(AMOUNT)


def achievement(lines: DataFrame, as_percent: bool = False) -> DataFrame:
    """Practical over theoretical amount, as a fraction or times 100."""
    return lines.withColumn("percentage", _achieved(100 if as_percent else 1))


def above_budget(lines: DataFrame) -> DataFrame:
    """Whether a line went beyond its plan, in the direction of the plan's sign (C4)."""
    p, t = F.col("practical_amount"), F.col("theoretical_amount")
    return lines.withColumn("is_above_budget", F.when(t >= 0, p > t).otherwise(p < t))


def budget_rollup(lines: DataFrame, keys: list[str], how: str = "group") -> DataFrame:
    """Sums over any grouping with the percentage worked out from the sums.

    ``how`` is ``group``, ``rollup`` or ``cube``.
    """
    grouped = {"group": lines.groupBy, "rollup": lines.rollup, "cube": lines.cube}[how](*keys)
    sums = grouped.agg(*[F.sum(c).cast(AMOUNT).alias(c) for c in ("planned", "practical_amount", "theoretical_amount")])
    return sums.withColumn("percentage", _achieved(100))


def budget_violations(lines: DataFrame, budgets: DataFrame) -> DataFrame:
    """Lines outside their budget's dates, and lines naming neither position nor analytic account."""
    b = budgets.select(F.col("id").alias("budget_id"), F.col("date_from").alias("_from"), F.col("date_to").alias("_to"))
    dated = lines.join(b, "budget_id")
    outside = [violations(dated.filter((F.col(c) < F.col("_from")) | (F.col(c) > F.col("_to"))), f"{c}_outside_budget", "id", F.col(c).cast("string"))
               for c in ("date_from", "date_to")]
    bare = lines.filter(F.col("analytic_id").isNull() & (F.size(F.coalesce("account_ids", F.array().cast("array<long>"))) == 0))
    return outside[0].unionByName(outside[1]).unionByName(violations(bare, "position_or_analytic_missing", "id", F.col("budget_id").cast("string")))


# --- assets --------------------------------------------------------------------------------------

def _by_key(rows: DataFrame) -> DataFrame:
    """Rows to be joined by sorting both sides.

    Rows out of an exploded schedule are estimated by the packed table they come from, so a broadcast would be chosen by a size that is
    many times too small.
    """
    return rows.hint("merge")


def posted_summary(lines: DataFrame) -> DataFrame:
    """Per asset: number, amount and last date of its posted depreciation lines."""
    return lines.filter("posted").groupBy(F.col("asset_id").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("posted_count"), money(F.sum("amount")).alias("posted_amount"), F.max("date").alias("last_posted"))


def residual_values(assets: DataFrame, lines: DataFrame) -> DataFrame:
    """Value less posted depreciation less salvage."""
    done = posted_summary(lines).select("id", "posted_amount")
    return assets.join(_by_key(done), "id", "left").withColumn(
        "value_residual", (F.col("value") - F.coalesce("posted_amount", F.lit(0)) - F.col("salvage")).cast(MONEY)).drop("posted_amount")


def last_depreciation(assets: DataFrame, lines: DataFrame) -> DataFrame:
    """Date of the last posted line, else the asset's own date."""
    done = posted_summary(lines).select("id", "last_posted")
    return assets.select("id", "date").join(_by_key(done), "id", "left").select("id", F.coalesce("last_posted", "date").alias("last_date"))


def _closing(day: Column, last_month: int, last_day: int) -> Column:
    def closing(year: Column) -> Column:
        return F.least(F.make_date(year, F.lit(last_month), F.lit(1)) + (last_day - 1), F.last_day(F.make_date(year, F.lit(last_month), F.lit(1))))
    own = closing(F.year(day))
    return F.when(day <= own, own).otherwise(closing(F.year(day) + 1))


def depreciation_board(assets: DataFrame, posted: DataFrame | None = None, last_month: int = 12, last_day: int = 31) -> DataFrame:
    """The open depreciation lines of every asset.

    The running residual is folded over the period numbers inside the row: each step rounds its amount
    to cents, the last one takes what is left, and a zero amount leaves out both line and date step.
    """
    a = assets
    if posted is None:
        a = a.withColumns({"posted_count": F.lit(0), "posted_amount": F.lit(0).cast(MONEY), "last_posted": F.lit(None).cast("date")})
    else:
        a = a.join(_by_key(posted_summary(posted)), "id", "left").withColumns(
            {"posted_count": F.coalesce("posted_count", F.lit(0)), "posted_amount": money(F.col("posted_amount"))})
    months = F.col("method_period")
    fiscal_start = F.date_add(_closing(F.make_date(F.year("date"), F.lit(1), F.lit(1)), last_month, last_day), 1)
    fiscal_start = F.make_date(F.year("date"), F.month(fiscal_start), F.dayofmonth(fiscal_start))
    first = (F.when(F.col("last_posted").isNotNull(), F.add_months("last_posted", months)).when(F.col("prorata"), F.col("date"))
             .when(months >= 12, fiscal_start).otherwise(F.trunc("date", "month")))
    a = a.withColumn("_start", first).withColumn("_base", (F.col("value") - F.col("posted_amount") - F.col("salvage")).cast(MONEY))
    planned = F.when(F.col("method_time") == "end", count_steps_until(F.col("_start"), months, F.col("method_end"))).otherwise(F.col("method_number"))
    a = a.withColumn("_count", planned + F.col("prorata").cast("int"))
    a = a.filter((F.col("_base") != 0) & (F.col("_count") > F.col("posted_count")))
    month_days = F.dayofmonth(F.last_day("date"))
    by_month = F.struct((month_days - F.dayofmonth("date") + 1).alias("days"), month_days.alias("of"))
    by_year = F.struct((F.datediff(_closing(F.col("_start"), last_month, last_day), F.col("_start")) + 1).alias("days"),
                       F.when(F.year("_start") % 4 == 0, 366).otherwise(365).alias("of"))
    a = a.withColumn("_part", F.when(months % 12 != 0, by_month).otherwise(by_year))
    base, part, linear = F.col("_base"), F.col("_part"), F.col("method") == "linear"
    number = F.when(F.col("prorata"), F.col("method_number")).otherwise(F.col("_count") - F.col("posted_count"))

    def step(acc: Column, seq: Column) -> Column:
        left = acc["left"]
        full = F.when(linear, F.round(base / number, 2)).otherwise(F.round(left * F.col("factor"), 2))
        partial = F.when(linear, F.round(base * part["days"] / (number * part["of"]), 2)).otherwise(
            F.round(left * F.col("factor") * part["days"] / part["of"], 2))
        amount = F.when(seq == F.col("_count"), left).when(F.col("prorata") & (seq == 1), partial).otherwise(full).cast(MONEY)
        rest = (left - amount).cast(MONEY)
        line = F.struct(seq.alias("sequence"), acc["next"].alias("date"), amount.alias("amount"),
                        F.greatest(rest, F.lit(0).cast(MONEY)).alias("remaining_value"),
                        (F.col("value") - F.col("salvage") - rest).cast(MONEY).alias("depreciated_value"))
        moved = F.struct(rest.alias("left"), F.add_months(acc["next"], months).alias("next"), F.concat(acc["lines"], F.array(line)).alias("lines"))
        return F.when(amount == 0, acc).otherwise(moved)

    empty = F.array().cast("array<struct<sequence:int,date:date,amount:decimal(18,2),remaining_value:decimal(18,2),depreciated_value:decimal(18,2)>>")
    state = F.struct(base.alias("left"), F.col("_start").alias("next"), empty.alias("lines"))
    lines = F.aggregate(F.sequence(F.col("posted_count") + 1, F.col("_count")), state, step, lambda acc: acc["lines"])
    return a.select(F.col("id").alias("asset_id"), F.explode(lines).alias("l")).select("asset_id", "l.*")


def disposal_lines(assets: DataFrame, lines: DataFrame, today: date) -> DataFrame:
    """One closing line with the residual for every asset that still has open lines."""
    per = lines.groupBy(F.col("asset_id").alias("id")).agg(
        F.count_if("posted").cast("int").alias("_posted"), F.count_if(~F.col("posted")).alias("_open"))
    rows = residual_values(assets, lines).join(_by_key(per.filter("_open > 0")), "id")
    return rows.select(F.col("id").alias("asset_id"), (F.col("_posted") + 1).alias("sequence"), F.lit(today).alias("date"),
                       F.col("value_residual").alias("amount"), F.lit(0).cast(MONEY).alias("remaining_value"),
                       (F.col("value") - F.col("salvage")).cast(MONEY).alias("depreciated_value"))


def _two_sides(rows: DataFrame, keep: list[str], credit_account: str, debit_account: str, amount: str) -> DataFrame:
    """Each row as a credit and a debit line; a negative amount changes sides."""
    up, down = F.greatest(F.col(amount), F.lit(0).cast(MONEY)), F.greatest(-F.col(amount), F.lit(0).cast(MONEY))
    sides = F.array(F.struct(F.col(credit_account).alias("account_id"), down.cast(MONEY).alias("debit"), up.cast(MONEY).alias("credit")),
                    F.struct(F.col(debit_account).alias("account_id"), up.cast(MONEY).alias("debit"), down.cast(MONEY).alias("credit")))
    return rows.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")


def depreciation_entries(lines: DataFrame, assets: DataFrame, categories: DataFrame, post_date: date, grouped: bool = False) -> DataFrame:
    """Journal lines of depreciation lines, one pair per line or per category (C11)."""
    cat = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "depreciation_account_id", "expense_account_id")
    owner = assets.select(F.col("id").alias("asset_id"), "category_id", F.col("name").alias("asset"))
    # How many lines the asset has: all of them lie together for the join anyway.
    counted = lines if grouped else lines.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("asset_id")))
    rows = _by_key(counted).join(owner, "asset_id").join(cat, "category_id")
    if grouped:
        rows = rows.groupBy("category_id", "category", "depreciation_account_id", "expense_account_id").agg(money(F.sum("amount")).alias("amount"))
        rows = rows.select("*", F.concat("category", F.lit(" (grouped)")).alias("name"), F.lit(post_date).alias("date"))
        return _two_sides(rows, ["category_id", "name", "date"], "depreciation_account_id", "expense_account_id", "amount")
    name = F.concat("asset", F.lit(" ("), F.col("sequence").cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(")"))
    rows = rows.select("*", name.alias("name"))
    return _two_sides(rows, ["asset_id", "sequence", "name", "date"], "depreciation_account_id", "expense_account_id", "amount")


def asset_analysis(lines: DataFrame, assets: DataFrame) -> DataFrame:
    """Depreciation facts with the gross value on an asset's first line only."""
    numbered = lines.withColumn("_first", F.min("id").over(Window.partitionBy("asset_id")))
    a = assets.select(F.col("id").alias("asset_id"), F.col("date").alias("asset_date"), F.col("value"), "category_id", "partner_id", "state", "company_id")
    rows = _by_key(numbered).join(a, "asset_id")
    out = rows.groupBy("amount", "asset_id", F.col("date").alias("depreciation_date"), "asset_date", "posted", "state", "category_id", "partner_id",
                       "company_id", "value", "_first").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("installment_nbr"))
    zero = F.lit(0).cast(MONEY)
    return out.select(
        "id", "asset_id", "depreciation_date", "asset_date", F.when(F.col("_first") == F.col("id"), F.col("value")).otherwise(zero).alias("gross_value"),
        F.col("amount").alias("depreciation_value"), F.when(F.col("posted"), F.col("amount")).otherwise(zero).alias("posted_value"),
        F.when(~F.col("posted"), F.col("amount")).otherwise(zero).alias("unposted_value"), "posted", "category_id", "partner_id", "state",
        "company_id", "installment_nbr")


def invoice_assets(lines: DataFrame, categories: DataFrame) -> DataFrame:
    """Assets opened by invoice lines that name an asset category.

    ``lines`` has subtotal, subtotal_signed and invoice_date; revenue per month is for sale documents.
    """
    months = F.col("method_number") * F.col("method_period")
    c = categories.select(F.col("id").alias("asset_category_id"), months.alias("months"))
    first = F.trunc("invoice_date", "month")
    mrr = F.when(F.col("move_type").isin("out_invoice", "out_refund"), F.round(F.col("subtotal_signed") / F.col("months"), 2)).otherwise(F.lit(0))
    return lines.filter(F.col("asset_category_id").isNotNull()).join(c, "asset_category_id").select(
        F.col("id").alias("line_id"), "name", F.col("move_name").alias("code"), "asset_category_id", F.col("subtotal").alias("value"), "partner_id",
        "company_id", F.col("invoice_date").alias("date"), first.alias("start_date"), F.date_sub(F.add_months(first, F.col("months")), 1).alias("end_date"),
        mrr.cast(MONEY).alias("monthly_revenue"))


# --- recurring entries ----------------------------------------------------------------------------

def recurring_dates(templates: DataFrame, today: date | None = None) -> DataFrame:
    """Occurrences of each template (C13): before its end date, or up to and including ``today``."""
    last = F.lit(today) if today else F.date_sub("date_end", 1)
    return templates.withColumn("date", F.explode(schedule_dates("date_begin", last, "period", "interval")))


def outstanding_occurrences(templates: DataFrame, posted: DataFrame, today: date) -> DataFrame:
    """Occurrences whose ``id/date`` code has not been posted yet (C14)."""
    due = recurring_dates(templates, today).withColumn(
        "recurring_ref", F.concat_ws("/", F.col("id").cast("string"), F.date_format("date", "yyyy-MM-dd")))
    return due.join(_by_key(posted.select("recurring_ref").filter(F.col("recurring_ref").isNotNull())), "recurring_ref", "left_anti")


def recurring_entries(occurrences: DataFrame) -> DataFrame:
    """A credit and a debit line per occurrence."""
    zero = F.lit(0).cast(MONEY)
    sides = F.array(F.struct(F.col("credit_account_id").alias("account_id"), zero.alias("debit"), F.col("amount").alias("credit")),
                    F.struct(F.col("debit_account_id").alias("account_id"), F.col("amount").alias("debit"), zero.alias("credit")))
    return occurrences.select("recurring_ref", "date", "journal_id", F.explode(sides).alias("s")).select("recurring_ref", "date", "journal_id", "s.*")


def due_payments(lines: DataFrame, today: date) -> DataFrame:
    """Scheduled lines due and not done."""
    return lines.filter((F.col("date") <= F.lit(today)) & (F.col("state") != "done"))


# --- fiscal years and locks -----------------------------------------------------------------------

def fiscal_year_violations(years: DataFrame) -> DataFrame:
    """Years that end before they start, and years that overlap another of their company (C17).

    Sorted by start, a year overlaps an earlier one if any of those ends late enough, and a later one
    if the next start is early enough; a running extreme in each direction answers both.
    """
    upside_down = violations(years.filter(F.col("date_to") < F.col("date_from")), "end_before_start", "id", F.col("company_id").cast("string"))
    valid = years.filter(F.col("date_to") >= F.col("date_from"))
    coarse = {"start": F.col("date_from")}
    before = running_totals(valid, ["company_id"], [F.col("date_from"), F.col("id")], {"_ended": F.col("date_to")}, coarse,
                            {"ids": block("id")}, how="max", inclusive=False)
    both = running_totals(before, ["company_id"], [F.col("date_from").desc(), F.col("id").desc()], {"_starts": F.col("date_from")}, coarse,
                          {"ids": block("id")}, descending=("start", "ids"), how="min", inclusive=False)
    hit = both.filter((F.col("_ended") >= F.col("date_from")) | (F.col("_starts") <= F.col("date_to")))
    return upside_down.unionByName(violations(hit, "overlap", "id", F.col("company_id").cast("string")))


def lock_date_violations(moves: DataFrame, statement_lines: DataFrame, lock: date, company_ids: tuple[int, ...] = ()) -> DataFrame:
    """Draft moves and unreconciled bank lines that block a lock date."""
    if company_ids:
        moves, statement_lines = [d.filter(F.col("company_id").isin(list(company_ids))) for d in (moves, statement_lines)]
    drafts = moves.filter((F.col("state") == "draft") & (F.col("date") <= F.lit(lock)))
    bank = statement_lines.filter(~F.coalesce("is_reconciled", F.lit(False)) & (F.col("date") <= F.lit(lock)) & F.col("state").isin("draft", "posted"))
    return violations(drafts, "unposted_entry", "id", F.col("company_id").cast("string")).unionByName(
        violations(bank, "unreconciled_statement_line", "id", F.col("company_id").cast("string")))
