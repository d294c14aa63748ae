"""Financial statements: report trees, cash flow, executive summary."""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.filters import LedgerFilter
from ledgerlake.functions.labels import strip_symbols
from ledgerlake.functions.periods import Period, span
from ledgerlake.operators.ledger import MONEY, money

# Account types behind the statement figures.
CASH_TYPES = ["asset_cash", "liability_credit_card"]
CURRENT_ASSETS = ["asset_cash", "asset_receivable", "asset_current", "asset_prepayments"]
CURRENT_LIABILITIES = ["liability_current", "liability_payable", "liability_credit_card"]
OTHER_INCOME = ["income_other"]
EXPENSES = ["expense", "expense_depreciation", "expense_direct_cost"]


def node_paths(nodes: DataFrame) -> DataFrame:
    """Level and pre-order path of every node, children in order of sequence."""
    return nodes.sparkSession.sql("""
        WITH RECURSIVE walk(id, level, path) AS (
          SELECT id, 0, lpad(CAST(sequence AS STRING), 6, '0') || '.' || lpad(CAST(id AS STRING), 10, '0') FROM {nodes} WHERE parent_id IS NULL
          UNION ALL
          SELECT n.id, w.level + 1, w.path || '/' || lpad(CAST(n.sequence AS STRING), 6, '0') || '.' || lpad(CAST(n.id AS STRING), 10, '0')
          FROM walk w JOIN {nodes} n ON n.parent_id = w.id)
        SELECT id AS node_id, level, path AS sort_path FROM walk""", nodes=nodes)


def node_closure(nodes: DataFrame) -> DataFrame:
    """Which nodes add to which, with their signed multiplicity.

    Sum and total nodes add their children; a subtract node takes its first child less the others
    ('Net Profit' adds them all); a report node takes the node it refers to. A cycle exceeds the
    recursion limit and fails.
    """
    siblings = Window.partitionBy("parent_id").orderBy("sequence", "id")
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("type").alias("_type"), F.col("name").alias("_name"))
    children = nodes.filter(F.col("parent_id").isNotNull()).withColumn("_first", F.row_number().over(siblings) == 1)
    down = children.join(parents, "parent_id").filter(F.col("_type").isin("sum", "total", "subtract")).select(
        F.col("parent_id").alias("src"), F.col("id").alias("dst"),
        F.when((F.col("_type") == "subtract") & (F.col("_name") != "Net Profit") & ~F.col("_first"), -1).otherwise(1).alias("coef"))
    across = nodes.filter((F.col("type") == "account_report") & F.col("ref_id").isNotNull()).select(
        F.col("id").alias("src"), F.col("ref_id").alias("dst"), F.lit(1).alias("coef"))
    return nodes.sparkSession.sql("""
        WITH RECURSIVE reach(node_id, leaf_id, coef) AS (
          SELECT id, id, 1 FROM {nodes}
          UNION ALL
          SELECT r.node_id, e.dst, r.coef * e.coef FROM reach r JOIN {edges} e ON e.src = r.leaf_id)
        SELECT node_id, leaf_id, coef FROM reach""", nodes=nodes, edges=down.unionByName(across))


def leaf_accounts(nodes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Accounts listed on a leaf node, by number or by account type."""
    by_id = nodes.filter(F.col("type") == "accounts").select(F.col("id").alias("leaf_id"), F.explode(F.array_distinct("account_ids")).alias("account_id"))
    kinds = nodes.filter(F.col("type") == "account_type").select(F.col("id").alias("leaf_id"), F.explode(F.array_distinct("account_types")).alias("account_type"))
    by_type = kinds.join(accounts.select(F.col("id").alias("account_id"), "account_type"), "account_type").select("leaf_id", "account_id")
    return by_id.unionByName(by_type)


def account_periods(lines: DataFrame, periods: list[Period]) -> DataFrame:
    """Debit, credit and balance of each account in each period, from one scan."""
    columns = []
    lines = lines.filter(span(periods))
    for i, p in enumerate(periods):
        inside = F.col("date") <= F.lit(p.end)
        if p.start:
            inside &= F.col("date") >= F.lit(p.start)
        columns += [money(F.sum(F.when(inside, F.col(c)))).alias(f"{c}_{i}") for c in ("debit", "credit")]
    return lines.groupBy("account_id").agg(*columns).withColumns(
        {f"balance_{i}": (F.col(f"debit_{i}") - F.col(f"credit_{i}")).cast(MONEY) for i in range(len(periods))})


def _measures(periods: int) -> list[str]:
    return [f"{c}_{i}" for i in range(periods) for c in ("debit", "credit", "balance")]


def financial_report(lines: DataFrame, accounts: DataFrame, nodes: DataFrame, where: LedgerFilter, periods: list[Period],
                     display_abs: bool = False) -> DataFrame:
    """A report tree with amounts per period.

    Period 0 is the reported one, further periods are comparisons. Balances carry the node's sign.
    Leaf nodes with detail are followed by their accounts that have amounts. Present by ``sort_path``.
    """
    names = _measures(len(periods))
    amounts = account_periods(where.apply(lines, accounts), periods)
    leaves = leaf_accounts(nodes, accounts)
    per_leaf = leaves.join(amounts, "account_id").groupBy("leaf_id").agg(*[F.sum(n).alias(n) for n in names])
    values = node_closure(nodes).join(per_leaf, "leaf_id").groupBy("node_id").agg(
        *[F.sum(F.col(n) * F.col("coef")).cast(MONEY).alias(n) for n in names])
    info = nodes.select(F.col("id").alias("node_id"), "name", "sign", "display_detail").join(node_paths(nodes), "node_id")

    def signed(n: str) -> Column:
        value = F.col(n) * F.col("sign") if n.startswith("balance") else F.col(n)
        return money(F.abs(value) if display_abs and n.startswith("balance") else value).alias(n)

    heads = nodes.select(F.col("id").alias("node_id")).join(values, "node_id", "left").select(
        "node_id", F.lit(None).cast("long").alias("account_id"), F.lit(None).cast("string").alias("_account"), *names)
    chart = accounts.select(F.col("id").alias("account_id"), F.concat_ws(" ", "code", F.col("name")).alias("_account"))
    details = leaves.withColumnRenamed("leaf_id", "node_id").join(amounts, "account_id").join(chart, "account_id").select(*heads.columns)
    rows = heads.unionByName(details).join(info, "node_id")
    is_head = F.col("account_id").isNull()
    visible = (F.col("display_detail") != "no_detail") & (F.greatest(*[F.abs(F.round(n, 2)) for n in names]) != 0)
    return rows.filter(is_head | visible).select(
        "node_id", "account_id", F.when(is_head, F.col("name")).otherwise(F.col("_account")).alias("name"),
        F.when(is_head, "report").otherwise("account").alias("row_type"),
        F.when(is_head, F.col("level")).when(F.col("display_detail") == "detail_with_hierarchy", 4).otherwise(0).alias("level"),
        F.when(is_head, F.col("sort_path")).otherwise(F.concat_ws("/", "sort_path", F.lit("~"), "_account")).alias("sort_path"),
        *[signed(n) for n in names])


def report_items(lines: DataFrame, accounts: DataFrame, nodes: DataFrame, node_id: int, where: LedgerFilter) -> DataFrame:
    """Journal items behind one report line (A26), with a symbol-free account key."""
    leaves = leaf_accounts(nodes, accounts)
    used = node_closure(nodes).filter(F.col("node_id") == node_id).join(leaves, "leaf_id").select("account_id").distinct()
    named = used.join(accounts.select(F.col("id").alias("account_id"), F.col("name").alias("account_name")), "account_id")
    # Accounts are few but come out of a recursion, whose size Spark cannot tell; sorting by account would put a third of the ledger into one task.
    return where.apply(lines, accounts).join(F.broadcast(named), "account_id").select(
        "account_id", strip_symbols("account_name").alias("account_key"), F.col("id").alias("line_id"), "date", "move_name", "debit", "credit", "balance")


def earnings_windows(start: date | None, end: date) -> dict[str, Period]:
    """Date windows of last year's unallocated and this year's earnings."""
    last_end = date(end.year - 1, 12, 31)
    last_start = date(start.year - 1, 1, 1) if start else None
    return {"previous_year_unallocated_earnings": Period("previous", last_start, last_end),
            "current_year_earnings": Period("current", start or date(end.year, 1, 1), end)}


def earnings(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, start: date | None, end: date) -> DataFrame:
    """Result of income and expense accounts in both windows."""
    result_accounts = accounts.filter(F.col("account_type").ilike("%income%") | F.col("account_type").ilike("%expense%"))
    chosen = where.apply(lines, accounts).join(result_accounts.select(F.col("id").alias("account_id")), "account_id", "left_semi")
    windows = earnings_windows(start, end)
    per = account_periods(chosen, list(windows.values())).agg(*[money(F.sum(n)).alias(n) for n in _measures(2)])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), *[F.col(f"{c}_{i}").alias(c) for c in ("debit", "credit", "balance")])
                     for i, name in enumerate(windows)])
    return per.select(F.explode(rows).alias("r")).select("r.*")


def cash_flow(lines: DataFrame, accounts: DataFrame, sections: DataFrame, where: LedgerFilter) -> DataFrame:
    """Cash in and out per section (A20): in takes the section's debit, out its credit as a negative."""
    per = where.apply(lines, accounts).groupBy("account_id").agg(F.sum("debit").alias("debit"), F.sum("credit").alias("credit"))
    totals = sections.join(per, "account_id", "left").groupBy("section").agg(money(F.sum("debit")).alias("d"), money(F.sum("credit")).alias("c"))
    zero = F.lit(0).cast(MONEY)
    rows = F.array(
        F.struct(F.lit("net").alias("flow"), F.col("d").alias("debit"), F.col("c").alias("credit"), (F.col("d") - F.col("c")).cast(MONEY).alias("balance")),
        F.struct(F.lit("in").alias("flow"), F.col("d").alias("debit"), zero.alias("credit"), F.col("d").alias("balance")),
        F.struct(F.lit("out").alias("flow"), zero.alias("debit"), F.col("c").alias("credit"), (-F.col("c")).cast(MONEY).alias("balance")))
    return totals.select("section", F.explode(rows).alias("r")).select("section", "r.*")


def executive_measures(lines: DataFrame, accounts: DataFrame, where: LedgerFilter, start: date, end: date) -> DataFrame:
    """All figures of the executive summary as one row, from one conditional aggregate."""
    kinds = accounts.select(F.col("id").alias("account_id"), F.col("account_type").alias("kind"))
    rows = where.apply(lines, accounts).filter(F.col("date") <= F.lit(end)).join(kinds, "account_id")
    inside = F.col("date") >= F.lit(start)
    kind = F.col("kind")

    def total(cond: Column, name: str, sign: int = 1) -> Column:
        return money(F.sum(F.when(cond, (F.col("debit") - F.col("credit")) * sign))).alias(name)

    one = rows.agg(
        total(inside & kind.isin(CASH_TYPES) & (F.col("debit") > 0), "cash_received"),
        total(inside & kind.isin(CASH_TYPES) & (F.col("credit") > 0), "cash_spent"),
        total(kind.isin(CASH_TYPES), "closing_bank_balance"), total(kind == "asset_receivable", "receivables"),
        total(kind == "liability_payable", "payables"), total(kind.startswith("asset"), "assets"),
        total(kind.startswith("liability"), "liabilities", -1), total(kind.isin(CURRENT_ASSETS), "current_assets"),
        total(kind.isin(CURRENT_LIABILITIES), "current_liabilities", -1),
        total(inside & (kind == "income"), "operating_income", -1), total(inside & kind.isin("income", *OTHER_INCOME), "total_income", -1),
        total(inside & (kind == "expense_direct_cost"), "cost_of_revenue"), total(inside & kind.isin(EXPENSES), "total_expense"))
    diff = lambda a, b: (F.col(a) - F.col(b)).cast(MONEY)
    return (one.withColumn("cash_surplus", (F.col("cash_received") + F.col("cash_spent")).cast(MONEY))
            .withColumn("net_assets", diff("assets", "liabilities")).withColumn("gross_profit", diff("operating_income", "cost_of_revenue"))
            .withColumn("net_profit", diff("total_income", "total_expense")))


# Order of the summary lines.
SUMMARY_LINES = ["cash_received", "cash_spent", "cash_surplus", "closing_bank_balance", "receivables", "payables", "net_assets",
                 "total_income", "cost_of_revenue", "gross_profit", "total_expense", "net_profit"]
DAYS_BASE = 364


def executive_summary(measures: DataFrame) -> DataFrame:
    """The summary figures as lines."""
    rows = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(n).alias("name"), F.col(n).alias("amount")) for i, n in enumerate(SUMMARY_LINES, 1)])
    return measures.select(F.explode(rows).alias("r")).select("r.*")


def executive_ratios(measures: DataFrame, scale: int = 6) -> DataFrame:
    """Days outstanding, cash forecast and margins; a zero denominator gives zero."""
    def over(top: Column, bottom: str, factor: int, digits: int) -> Column:
        value = F.round(top * factor / F.nullif(F.col(bottom), F.lit(0)), digits)
        return F.coalesce(value, F.lit(0)).cast(f"decimal(28,{scale})")

    ratios = {
        "average_debtor_days": over(F.col("receivables"), "operating_income", DAYS_BASE, 2),
        "average_creditor_days": over(-F.col("payables"), "operating_income", DAYS_BASE, 2),
        "short_term_cash_forecast": (F.col("payables") + F.col("receivables")).cast(f"decimal(28,{scale})"),
        "current_assets_to_liabilities": over(F.col("current_assets"), "current_liabilities", 1, scale),
        "gross_profit_margin": over(F.col("gross_profit"), "operating_income", 100, scale),
        "net_profit_margin": over(F.col("net_profit"), "total_income", 100, scale),
        "return_on_assets": over(F.col("net_profit"), "assets", 100, scale),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(n).alias("name"), v.alias("amount")) for i, (n, v) in enumerate(ratios.items(), 1)])
    return measures.select(F.explode(rows).alias("r")).select("r.*")
