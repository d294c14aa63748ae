"""General-ledger reports over journal lines.

Line tables carry: id, move_id, move_name, account_id, journal_id, partner_id, company_id, date,
date_maturity, debit, credit, balance, currency_id, amount_currency, ref, name, reconciled,
full_reconcile_id, tax_line_id, parent_state, display_type.
"""

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.filters import STRICT, LedgerFilter, display_account, states
from ledgerlake.functions.labels import ledger_display_name
from ledgerlake.functions.prefix import block, dense_ranks, documents, openings, row_numbers, running_totals

MONEY = "decimal(18,2)"
PAGE_SIZE = 20


def money(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast(MONEY)


def sums(*names: str) -> list[Column]:
    return [F.sum(n).cast(MONEY).alias(n) for n in names]


def sum_if(cond: Column, value: str, name: str) -> Column:
    return money(F.sum(F.when(cond, F.col(value)))).alias(name)


def account_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("account_id").agg(*sums("debit", "credit"),
                                           F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("balance"))


def trial_balance(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, show: str = "all") -> DataFrame:
    """Debit, credit and balance per account; accounts without lines show zero (A1)."""
    totals = account_totals(where.apply(lines, accounts)).withColumnRenamed("account_id", "id")
    out = accounts.join(totals, "id", "left").select(
        F.col("id").alias("account_id"), "code", "name",
        *[money(F.col(c)).alias(c) for c in ("debit", "credit", "balance")])
    return display_account(out, show)


_PARTS = ("initial_debit", "initial_credit", "initial_balance", "debit", "credit", "balance",
          "ending_debit", "ending_credit", "ending_balance")


def _opening_and_period(lines: DataFrame, keys: list[str], start: date, end: date) -> DataFrame:
    before, inside = F.col("date") < F.lit(start), F.col("date").between(F.lit(start), F.lit(end))
    out = lines.filter(F.col("date") <= F.lit(end)).groupBy(*keys).agg(
        sum_if(before, "debit", "initial_debit"), sum_if(before, "credit", "initial_credit"),
        sum_if(inside, "debit", "debit"), sum_if(inside, "credit", "credit"),
        F.sum(inside.cast("int")).cast("long").alias("line_count"))
    return out


def _with_ending(df: DataFrame) -> DataFrame:
    return (df.withColumn("initial_balance", (F.col("initial_debit") - F.col("initial_credit")).cast(MONEY))
            .withColumn("balance", (F.col("debit") - F.col("credit")).cast(MONEY))
            .withColumns({f"ending_{c}": (F.col(f"initial_{c}") + F.col(c)).cast(MONEY) for c in ("debit", "credit", "balance")}))


def trial_balance_periods(lines: DataFrame, accounts: DataFrame, start: date, end: date,
                          where: LedgerFilter = LedgerFilter(), carry_profit_to: str | None = None) -> DataFrame:
    """Opening, period and ending amounts per account, with a subtotal row (A2).

    One pass over the ledger. With ``carry_profit_to`` (the account type that collects the current
    year's earnings) the opening amounts of income and expense accounts move to that account (A3).
    """
    base = _opening_and_period(where.apply(lines, accounts), ["account_id"], start, end)
    cols = ["initial_debit", "initial_credit", "debit", "credit"]
    chart = accounts.select(F.col("id").alias("account_id"), "code", F.col("name"), "account_type", "internal_group")
    if carry_profit_to:
        flagged = base.join(chart.select("account_id", "internal_group"), "account_id")
        is_result = F.col("internal_group").isin("income", "expense")
        opening = ("initial_debit", "initial_credit")
        zero = F.lit(0).cast(MONEY)
        kept = flagged.withColumns({c: F.when(is_result, zero).otherwise(F.col(c)) for c in opening}).select("account_id", *cols)
        target = accounts.filter(F.col("account_type") == carry_profit_to).agg(F.min("id")).scalar()
        moved = flagged.filter(is_result).agg(*[money(F.sum(c)).alias(c) for c in opening]).select(
            target.alias("account_id"), *opening, zero.alias("debit"), zero.alias("credit"))
        base = kept.unionByName(moved).groupBy("account_id").agg(*sums(*cols))
    per_account = _with_ending(base.select("account_id", *cols)).filter(
        (F.round("ending_debit", 2) != 0) | (F.round("ending_credit", 2) != 0))
    named = per_account.join(chart, "account_id").select(
        "account_id", "code", "name", *_PARTS)
    total = named.agg(*sums(*_PARTS)).select(
        F.lit(None).cast("long").alias("account_id"), F.lit(None).cast("string").alias("code"),
        F.lit("SUBTOTAL").alias("name"), *[money(F.round(c, 2)).alias(c) for c in _PARTS])
    return named.unionByName(total)


_GL = ["line_id", "account_id", "date", "journal_code", "partner_name", "move_name", "ref", "name",
       "currency_id", "amount_currency", "debit", "credit"]


def _named(lines: DataFrame, journals: DataFrame, partners: DataFrame | None, *more: str) -> DataFrame:
    j = journals.select(F.col("id").alias("journal_id"), F.col("code").alias("journal_code"))
    out = lines.join(j, "journal_id", "left")
    if partners is None:
        return out.withColumn("partner_name", F.lit(None).cast("string"))
    return out.join(partners.select(F.col("id").alias("partner_id"), F.col("name").alias("partner_name"), *more), "partner_id", "left")


def _opening_rows(opening: DataFrame) -> DataFrame:
    """One row per account with its earlier amounts."""
    text = F.lit(None).cast("string")
    debit, credit = F.col("plus").cast(MONEY), F.col("minus").cast(MONEY)
    return opening.select(
        F.lit(0).cast("long").alias("line_id"), "account_id", F.lit(None).cast("date").alias("date"), text.alias("journal_code"), text.alias("partner_name"),
        text.alias("move_name"), text.alias("ref"), F.lit("Initial Balance").alias("name"), F.lit(None).cast("long").alias("currency_id"),
        F.lit(0).cast(MONEY).alias("amount_currency"), debit.alias("debit"), credit.alias("credit"), (debit - credit).cast(MONEY).alias("running_balance"))


def general_ledger(lines: DataFrame, accounts: DataFrame, journals: DataFrame, where: LedgerFilter,
                   partners: DataFrame | None = None, initial_balance: bool = False,
                   sort_by: str = "date", show: str = "movement") -> DataFrame:
    """Ledger lines per account with a running balance, optionally led by an opening row (A4).

    ``sort_by`` is ``date`` (date, move) or ``journal_partner`` (journal code, partner name, move).
    Accounts to show: ``movement`` needs at least one row, ``not_zero`` a closing balance; ``all`` also lists
    accounts without lines, by one row without a line.
    """
    base = ["move_id", "account_id", "date", "journal_id", *(["partner_id"] if partners is not None else []), *_GL[5:]]
    opened = initial_balance and where.date_from
    # With an opening row earlier lines are read along: they only add to the balances, as what is carried over.
    day = F.col("date_maturity" if where.use_maturity else "date")
    carried = day < F.lit(where.date_from) if opened else F.lit(False)
    inside = replace(where, date_from=None, mode=STRICT) if opened else where
    read = inside.apply(lines, accounts)
    detail = (read.filter(day.isNotNull()) if opened else read).select(F.col("id").alias("line_id"), *base, carried.alias("_carried"))
    delta = {"running_balance": (F.col("debit"), F.col("credit"))}
    ahead = F.col("_carried") if opened else None
    fine = documents(line="line_id")
    if sort_by == "date":
        # Names are attached afterwards: the totals need neither journal nor partner.
        order = [F.col("date"), F.col("move_id"), F.col("line_id")]
        coarse = {"day": F.col("date")}
        run = _named(running_totals(detail, ["account_id"], order, delta, coarse, fine, carried=ahead, whole=True), journals, partners)
    else:
        # Partner names count by their place among all names; a missing one sorts last, as in the order itself.
        if partners is not None:
            partners = partners.join(dense_ranks(partners, "name", "_place"), "name", "left")
        detail = _named(detail, journals, partners, *(["_place"] if partners is not None else [])).drop("journal_id", "partner_id").withColumn(
            "_journal", F.coalesce("journal_code", F.lit("")))
        place, nameless = F.col("_place") if partners is not None else F.lit(None).cast("long"), F.col("partner_name").isNull()
        order = [F.col("_journal"), nameless, place, F.col("move_id"), F.col("line_id")]
        coarse = {"journal": F.col("_journal"), "nameless": nameless}
        fine = {"partners": F.floor(place / F.lit(1024)).cast("long"), "documents": F.struct(place.alias("partner"), fine["documents"].alias("documents")), "lines": fine["lines"]}
        run = running_totals(detail, ["account_id"], order, delta, coarse, fine, carried=ahead, whole=True)
    body = run.select("line_id", "account_id", "date", *_GL[3:], F.col("running_balance").cast(MONEY).alias("running_balance"))
    if opened:
        body = body.unionByName(_opening_rows(openings(detail, ["account_id"], delta["running_balance"], "running_balance", coarse, fine, ahead)))
    if show == "not_zero":
        closing = body.groupBy("account_id").agg(F.sum(F.col("debit") - F.col("credit")).alias("_b")).filter(F.round("_b", 2) != 0)
        body = body.join(closing.select("account_id"), "account_id", "left_semi").select(*body.columns)
    if show == "all":
        chosen = accounts.filter(F.col("id").isin(list(where.account_ids))) if where.account_ids else accounts
        idle = chosen.select(F.col("id").alias("account_id")).join(body.select("account_id").distinct(), "account_id", "left_anti")
        amounts = ("amount_currency", "debit", "credit", "running_balance")
        body = body.unionByName(idle.select("account_id", *[F.lit(0).cast(MONEY).alias(c) for c in amounts]), allowMissingColumns=True)
    return body


def general_ledger_summary(lines: DataFrame, accounts: DataFrame, start: date, end: date,
                           where: LedgerFilter = LedgerFilter(), initial_balance: bool = True) -> DataFrame:
    """Opening, period and closing amounts of each account that has any (A5)."""
    base = _with_ending(_opening_and_period(where.apply(lines, accounts), ["account_id"], start, end))
    if not initial_balance:
        zero = F.lit(0).cast(MONEY)
        base = base.withColumns({f"initial_{c}": zero for c in ("debit", "credit", "balance")})
        base = base.withColumns({f"ending_{c}": F.col(c) for c in ("debit", "credit", "balance")})
    chart = accounts.select(F.col("id").alias("account_id"), "code", "name")
    out = base.join(chart, "account_id").select("account_id", "code", "name", *_PARTS, "line_count")
    return out.filter((F.col("ending_debit") != 0) | (F.col("ending_credit") != 0))


def ledger_days(lines: DataFrame, key: str = "account_id") -> DataFrame:
    """Lines and change of balance per key and day: the cells by which ``ledger_page`` finds its rows (A6). Worth keeping as a table."""
    return lines.groupBy(key, "date").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("change"))


def _seek(days: DataFrame, start: date, first: int, size: int) -> dict:
    """Where a page lies: its first and last day, the lines and the balance before that day, and the number of lines.

    ``days`` has one key; the window runs over its days, of which there are as many as the calendar has. The answer, one row, is fetched: only days that
    are known when the page is planned are compared with the statistics of the files.
    """
    inside = F.col("date") >= F.lit(start)
    days = days.select(F.when(inside, F.col("date")).alias("day"), F.when(inside, F.col("lines")).otherwise(0).alias("n"), "change")
    earlier = Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    run = days.groupBy("day").agg(F.sum("n").alias("n"), F.sum("change").alias("change")).select(
        "day", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"), money(F.sum("change").over(earlier)).alias("balance"))
    holds = F.when((F.col("skipped") < first + size) & (F.col("skipped") + F.col("n") > first), F.col("day"))
    return run.agg(F.min(holds).alias("first"), F.max(holds).alias("last"), F.min_by("skipped", holds).alias("skipped"),
                   F.min_by("balance", holds).alias("balance"), F.sum("n").alias("lines")).first().asDict()


def _page_rows(chosen: DataFrame, days: DataFrame, start: date, order: list[Column], fine: dict[str, Column], page: int, size: int) -> DataFrame:
    """Rows of one page with ``row_no``, ``running_balance`` and ``line_count``; only the days that hold the page are read in full."""
    first = page * size
    place = _seek(days, start, first, size)
    near = chosen.filter(F.col("date").between(F.lit(place["first"]), F.lit(place["last"])))
    run = running_totals(near, [], order, {"row_no": F.lit(1).cast("long"), "running_balance": (F.col("debit") - F.col("credit")).cast(MONEY)},
                         {"day": F.col("date")}, fine)
    run = run.withColumns({"row_no": F.col("row_no") + F.lit(place["skipped"]).cast("long"), "line_count": F.lit(place["lines"]).cast("long"),
                           "running_balance": (F.col("running_balance") + F.lit(place["balance"]).cast(MONEY)).cast(MONEY)})
    return run.filter(F.col("row_no").between(first + 1, first + size))


def ledger_page(lines: DataFrame, accounts: DataFrame, journals: DataFrame, account_id: int, start: date, end: date,
                page: int = 0, page_size: int = PAGE_SIZE, where: LedgerFilter = LedgerFilter(), days: DataFrame | None = None) -> DataFrame:
    """One page of an account's lines with running balance and the number of lines.

    Totals by day tell on which days the page lies and what comes before; then only these days are read. ``days`` are such totals
    kept from before (``ledger_days`` of the lines that ``where`` chooses, its dates aside); else they are counted in one narrow pass.
    """
    chosen = replace(where, account_ids=(account_id,), date_from=None, date_to=end, mode=STRICT).apply(lines, accounts)
    known = ledger_days(chosen) if days is None else days.filter((F.col("account_id") == account_id) & (F.col("date") <= F.lit(end)))
    rows = _page_rows(chosen, known, start, [F.col("date"), F.col("move_id"), F.col("id")], documents(), page, page_size)
    j = journals.select(F.col("id").alias("journal_id"), F.col("code").alias("journal_code"))
    return rows.join(j, "journal_id").select("row_no", F.col("id").alias("line_id"), "date", "journal_code", "move_name", "name", "debit", "credit",
                                             "running_balance", "line_count")


# Ledger sides of a partner report.
PARTNER_SIDES = {
    "customer": ["asset_receivable"],
    "supplier": ["liability_payable"],
    "customer_supplier": ["asset_receivable", "liability_payable"],
}


def _partner_lines(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, side: str,
                   target_move: str, reconciled: bool) -> DataFrame:
    chosen = accounts.filter(F.col("account_type").isin(PARTNER_SIDES[side]) & ~F.col("deprecated"))
    out = where.apply(lines, accounts).filter(F.col("partner_id").isNotNull() & F.col("parent_state").isin(states(target_move)))
    if not reconciled:
        out = out.filter(F.col("full_reconcile_id").isNull())
    acc = chosen.select(F.col("id").alias("account_id"), F.col("name").alias("account_name"))
    return out.join(acc, "account_id")


def partner_ledger(lines: DataFrame, accounts: DataFrame, journals: DataFrame, partners: DataFrame, where: LedgerFilter,
                   side: str = "customer", target_move: str = "all", reconciled: bool = True) -> DataFrame:
    """Receivable and payable lines per partner with a progressive balance.

    Lines without a partner are left out. Present by ``partner_ref, partner_name, date``.
    """
    base = _partner_lines(lines, accounts, where, side, target_move, reconciled)
    run = running_totals(base, ["partner_id"], [F.col("date"), F.col("id")],
                         {"progress": (F.col("debit") - F.col("credit")).cast(MONEY)},
                         {"day": F.col("date")}, {"lines": block("id")})
    j = journals.select(F.col("id").alias("journal_id"), F.col("code").alias("journal_code"))
    p = partners.select(F.col("id").alias("partner_id"), F.coalesce("ref", F.lit("")).alias("partner_ref"),
                        F.coalesce("name", F.lit("")).alias("partner_name"))
    return run.join(j, "journal_id", "left").join(p, "partner_id", "left").select(
        "partner_id", "partner_ref", "partner_name", F.col("id").alias("line_id"), "date", "journal_code", "account_name",
        ledger_display_name("move_name", "ref", "name").alias("displayed_name"),
        "debit", "credit", F.col("progress").cast(MONEY).alias("progress"))


def partner_page(lines: DataFrame, accounts: DataFrame, journals: DataFrame, partner_id: int, start: date, end: date, page: int = 0,
                 page_size: int = PAGE_SIZE, where: LedgerFilter = LedgerFilter(), side: str = "customer", target_move: str = "all",
                 reconciled: bool = True, days: DataFrame | None = None) -> DataFrame:
    """One page of a partner's receivable and payable lines, the balance going on from the opening one (A7); ``days`` as in ``ledger_page``, by partner."""
    only = replace(where, partner_ids=(partner_id,), date_from=None, date_to=end, mode=STRICT)
    chosen = _partner_lines(lines, accounts, only, side, target_move, reconciled)
    known = ledger_days(chosen, "partner_id") if days is None else days.filter((F.col("partner_id") == partner_id) & (F.col("date") <= F.lit(end)))
    rows = _page_rows(chosen, known, start, [F.col("date"), F.col("id")], {"lines": block("id")}, page, page_size)
    j = journals.select(F.col("id").alias("journal_id"), F.col("code").alias("journal_code"))
    return rows.join(j, "journal_id", "left").select(
        "row_no", F.col("id").alias("line_id"), "date", "journal_code", "account_name", ledger_display_name("move_name", "ref", "name").alias("displayed_name"),
        "debit", "credit", "running_balance", "line_count")


def partner_totals(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, side: str = "customer",
                   target_move: str = "all", reconciled: bool = True) -> DataFrame:
    """Debit, credit and balance per partner."""
    base = _partner_lines(lines, accounts, where, side, target_move, reconciled)
    return base.groupBy("partner_id").agg(*sums("debit", "credit"),
                                          F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("balance"))


def partner_ledger_summary(lines: DataFrame, accounts: DataFrame, partners: DataFrame, start: date, end: date,
                           where: LedgerFilter = LedgerFilter(), side: str = "customer_supplier") -> DataFrame:
    """Opening, period and ending amounts per partner with amounts other than zero."""
    base = _partner_lines(lines, accounts, where, side, "all", True)
    nonzero = (F.col("debit") != 0) | (F.col("credit") != 0)
    out = _with_ending(_opening_and_period(base.filter(nonzero), ["partner_id"], start, end))
    p = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("partner_name"))
    return out.join(p, "partner_id").select("partner_id", "partner_name", *_PARTS, "line_count")


def journal_audit(lines: DataFrame, journals: DataFrame, accounts: DataFrame, where: LedgerFilter,
                  target_move: str = "posted", sort_by: str = "date") -> DataFrame:
    """Lines per journal; ``sort_no`` numbers them by date or move name (A10)."""
    base = where.apply(lines, accounts).filter(F.col("parent_state").isin(states(target_move)))
    if sort_by == "date":
        order, coarse = [F.col("date"), F.col("move_id"), F.col("id")], {"day": F.col("date")}
        fine = documents()
    else:
        order, coarse = [F.col("move_name"), F.col("id")], {"start": F.substring("move_name", 1, 4)}
        fine = {f"name{n}": F.substring("move_name", 1, n) for n in (8, 11, 14)} | {"name": F.col("move_name"), "lines": block("id")}
    numbered = row_numbers(base, "sort_no", order, coarse, fine, keys=["journal_id"])
    j = journals.select(F.col("id").alias("journal_id"), F.col("code").alias("journal_code"))
    a = accounts.select(F.col("id").alias("account_id"), F.col("code").alias("account_code"))
    return numbered.join(j, "journal_id").join(a, "account_id").select(
        "journal_code", "sort_no", F.col("id").alias("line_id"), "date", "move_name", "account_code", "partner_id", "name", "debit", "credit")


def journal_totals(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, target_move: str = "posted") -> DataFrame:
    """Debit and credit per journal."""
    base = where.apply(lines, accounts).filter(F.col("parent_state").isin(states(target_move)))
    return base.groupBy("journal_id").agg(*sums("debit", "credit"))


def payment_accounts(lines: DataFrame, journals: DataFrame, kind: str, journal_accounts: DataFrame | None = None) -> DataFrame:
    """Accounts of the cash (or bank) journals: their payment accounts (journal_id, account_id) if given, else what their lines post to."""
    chosen = journals.filter(F.col("type") == kind).select(F.col("id").alias("journal_id"))
    return (lines if journal_accounts is None else journal_accounts).join(chosen, "journal_id", "left_semi").select("account_id").distinct()


def liquidity_book(lines: DataFrame, accounts: DataFrame, journals: DataFrame, where: LedgerFilter, kind: str = "bank",
                   partners: DataFrame | None = None, account_types: tuple[str, ...] = ("asset_cash",),
                   initial_balance: bool = True, journal_accounts: DataFrame | None = None) -> DataFrame:
    """Cash book or bank book: the general ledger of the accounts behind such journals.

    With ``journal_accounts`` those are the journals' payment accounts, of whatever type.
    """
    used = payment_accounts(lines, journals, kind, journal_accounts)
    if journal_accounts is None:
        typed = accounts.filter(F.col("account_type").isin(list(account_types))).select(F.col("id").alias("account_id"))
        used = used.join(typed, "account_id", "left_semi")
    return general_ledger(lines.join(used, "account_id", "left_semi").select(*lines.columns), accounts, journals, where, partners,
                          initial_balance)


def journal_payment_accounts(journals: DataFrame) -> DataFrame:
    """(journal_id, account_id) from the payment accounts that journals list, incoming and outgoing."""
    listed = F.concat(*[F.coalesce(c, F.array().cast("array<bigint>")) for c in ("inbound_account_ids", "outbound_account_ids")])
    return journals.select(F.col("id").alias("journal_id"), F.explode(listed).alias("account_id")).filter("account_id IS NOT NULL").distinct()


def day_book(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, target_move: str = "all") -> DataFrame:
    """Totals per day that has lines."""
    base = where.apply(lines, accounts).filter(F.col("parent_state").isin(states(target_move)))
    return base.groupBy("date").agg(*sums("debit", "credit"),
                                    F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("balance"),
                                    F.count(F.lit(1)).alias("line_count"))


def day_book_lines(lines: DataFrame, accounts: DataFrame, journals: DataFrame, where: LedgerFilter, target_move: str = "all") -> DataFrame:
    """The lines behind the day book, present by ``date, line_id``."""
    base = _named(where.apply(lines, accounts).filter(F.col("parent_state").isin(states(target_move))), journals, None)
    return base.select("date", F.col("id").alias("line_id"), "journal_code", "move_name", "account_id", "debit", "credit",
                       F.col("balance"))


def consolidated_journals(lines: DataFrame, where: LedgerFilter, accounts: DataFrame | None = None) -> DataFrame:
    """Per (month, journal, account, company) with journal subtotals and a grand total.

    ``level`` is ``account``, ``journal`` or ``total``.
    """
    base = where.apply(lines, accounts).withColumn("month", F.trunc("date", "month"))
    cells = base.groupBy("month", "journal_id", "account_id", "company_id").agg(*sums("debit", "credit"))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("journal_id", "account_id", "company_id")]
    month = [F.date_format("month", "MM").alias("month"), F.date_format("month", "yyyy").alias("year")]
    no_month = [F.lit(None).cast("string").alias(c) for c in ("month", "year")]
    amounts = ["debit", "credit"]
    detail = cells.select(F.lit("account").alias("level"), *month, "journal_id", "account_id", "company_id", *amounts)
    per_journal = cells.groupBy("journal_id").agg(*sums(*amounts)).select(
        F.lit("journal").alias("level"), *no_month, "journal_id", *nothing[1:], *amounts)
    total = cells.agg(*sums(*amounts)).select(F.lit("total").alias("level"), *no_month, *nothing, *amounts)
    out = detail.unionByName(per_journal).unionByName(total)
    return out.withColumn("balance", (F.col("debit") - F.col("credit")).cast(MONEY))


def consolidated_journal_months(lines: DataFrame, where: LedgerFilter, accounts: DataFrame | None = None) -> DataFrame:
    """Month totals of each journal (A25 details)."""
    base = where.apply(lines, accounts)
    return base.groupBy("journal_id", F.date_format("date", "MM-yyyy").alias("month")).agg(
        *sums("debit", "credit"), F.sum(F.col("debit") - F.col("credit")).cast(MONEY).alias("balance"))


def convert_currency(amounts: DataFrame, rates: DataFrame, day: date, amount: str = "amount",
                     currency: str = "currency_id") -> DataFrame:
    """Amounts in company currency at the rate valid on ``day`` (B6); rates are units per company unit."""
    valid = (rates.filter(F.col("date") <= F.lit(day)).groupBy(F.col("currency_id").alias(currency))
             .agg(F.max_by("rate", "date").alias("_rate")))
    return (amounts.join(valid, currency, "left")
            .withColumn(f"{amount}_converted", F.round(F.col(amount) / F.coalesce("_rate", F.lit(1).cast("decimal(18,6)")), 2).cast(MONEY))
            .drop("_rate"))
