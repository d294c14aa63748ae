"""Tax reports over tagged journal lines."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.filters import LedgerFilter, states
from ledgerlake.functions.periods import Period, span
from ledgerlake.operators.ledger import MONEY, money


def journal_taxes(lines: DataFrame, line_taxes: DataFrame, journals: DataFrame, accounts: DataFrame, where: LedgerFilter,
                  target_move: str = "all") -> DataFrame:
    """Base and tax amount per journal and tax, signs turned for sale journals."""
    chosen = where.apply(lines, accounts).filter(F.col("parent_state").isin(states(target_move)))
    # Each line once, with what it adds as a base and as a tax line, so the ledger is read once.
    nothing = F.lit(None).cast(MONEY)
    part = lambda tax, base, amount: F.struct(tax.cast("long").alias("tax_id"), base.cast(MONEY).alias("base"), amount.cast(MONEY).alias("tax"))
    none = F.array().cast("array<struct<tax_id: bigint, base: decimal(18,2), tax: decimal(18,2)>>")
    bases = F.coalesce(F.transform("_taxes", lambda t: part(t, F.col("balance"), nothing)), none)
    own = F.when(F.col("tax_line_id").isNotNull(), F.array(part(F.col("tax_line_id"), nothing, F.col("balance")))).otherwise(none)
    tagged = chosen.join(line_taxes.groupBy(F.col("line_id").alias("id")).agg(F.collect_list("tax_id").alias("_taxes")), "id", "left")
    out = tagged.select("journal_id", F.inline(F.concat(bases, own))).groupBy("journal_id", "tax_id").agg(
        money(F.sum("base")).alias("base_amount"), money(F.sum("tax")).alias("tax_amount"), F.count("base").alias("_bases")).filter("_bases > 0")
    j = journals.select(F.col("id").alias("journal_id"), F.when(F.col("type") == "sale", -1).otherwise(1).alias("_sign"))
    out = out.join(j, "journal_id")
    return out.select("journal_id", "tax_id", (F.col("base_amount") * F.col("_sign")).cast(MONEY).alias("base_amount"),
                      (F.col("tax_amount") * F.col("_sign")).cast(MONEY).alias("tax_amount"))


def reported_taxes(taxes: DataFrame) -> DataFrame:
    """Taxes that a report lists: plain ones, and the 'none' children in place of their group."""
    children = taxes.filter(F.col("parent_id").isNotNull())
    with_children = children.select(F.col("parent_id").alias("id")).distinct()
    plain = taxes.filter(F.col("type_tax_use") != "none").join(with_children, "id", "left_anti").select(
        F.col("id").alias("tax_id"), "name", F.col("type_tax_use").alias("section"))
    parents = taxes.filter(F.col("type_tax_use") != "none").select(F.col("id").alias("parent_id"), F.col("type_tax_use").alias("section"))
    inner = children.filter(F.col("type_tax_use") == "none").join(parents, "parent_id").select(F.col("id").alias("tax_id"), "name", "section")
    return plain.unionByName(inner)


def tax_report(lines: DataFrame, line_taxes: DataFrame, taxes: DataFrame, accounts: DataFrame, where: LedgerFilter) -> DataFrame:
    """Absolute tax and net amount of each tax that carries any."""
    # Each line once, with its own tax and those it is a base of, so the ledger is read once.
    chosen = where.apply(lines, accounts).select("id", "tax_line_id", "balance")
    # Dealt out by line before they are listed: pairs are narrower than lists of one.
    taxed = line_taxes.select(F.col("line_id").alias("id"), "tax_id").repartition("id").groupBy("id").agg(F.collect_list("tax_id").alias("_taxes"))
    part = lambda tax, net, amount: F.struct(tax.cast("long").alias("tax_id"), net.cast(MONEY).alias("net"), amount.cast(MONEY).alias("tax"))
    nothing, none = F.lit(None), F.array().cast("array<struct<tax_id: bigint, net: decimal(18,2), tax: decimal(18,2)>>")
    bases = F.coalesce(F.transform("_taxes", lambda t: part(t, F.col("balance"), nothing)), none)
    own = F.when(F.col("tax_line_id").isNotNull(), F.array(part(F.col("tax_line_id"), nothing, F.col("balance")))).otherwise(none)
    amounts = chosen.join(taxed, "id", "left").select(F.inline(F.concat(bases, own))).groupBy("tax_id").agg(
        *[F.abs(F.sum(n)).cast(MONEY).alias(n) for n in ("net", "tax")])
    return (reported_taxes(taxes).join(amounts.filter(F.col("tax") != 0), "tax_id")
            .select("section", "tax_id", "name", money(F.col("net")).alias("net"), "tax"))


def _tax_amounts(lines: DataFrame, line_taxes: DataFrame, periods: list[Period]) -> DataFrame:
    """Per tax a net and a tax sum for each period, from one pass over the ledger.

    A line carries the set of its periods as bits, so it is one row however many there are, and sums pick their bit.
    """
    day = F.col("date")
    inside = [(day <= F.lit(p.end)) & (day >= F.lit(p.start) if p.start else F.lit(True)) for p in periods]
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(inside)])
    marked = lines.filter(span(periods)).select("id", "tax_line_id", "balance", mask.alias("_in")).filter("_in <> 0")
    part = lambda tax, net, amount: F.struct(tax.cast("long").alias("tax_id"), net.cast(MONEY).alias("net"), amount.cast(MONEY).alias("tax"))
    nothing, none = F.lit(None), F.array().cast("array<struct<tax_id: bigint, net: decimal(18,2), tax: decimal(18,2)>>")
    bases = F.coalesce(F.transform("_taxes", lambda t: part(t, F.col("balance"), nothing)), none)
    own = F.when(F.col("tax_line_id").isNotNull(), F.array(part(F.col("tax_line_id"), nothing, F.col("balance")))).otherwise(none)
    tagged = marked.join(line_taxes.groupBy(F.col("line_id").alias("id")).agg(F.collect_list("tax_id").alias("_taxes")), "id", "left")
    amounts = [F.sum(F.when(F.col("_in").bitwiseAND(F.lit(1 << i)) != 0, F.col(n))).alias(f"_{n}_{i}") for i in range(len(periods)) for n in ("net", "tax")]
    return tagged.select("_in", F.inline(F.concat(bases, own))).groupBy("tax_id").agg(*amounts)


def taxes_by_period(lines: DataFrame, line_taxes: DataFrame, taxes: DataFrame, accounts: DataFrame, where: LedgerFilter,
                    periods: list[Period]) -> DataFrame:
    """One row per tax with a net and a tax column for each period (A14); sale amounts change sign.

    A group shows its own base and the tax of its children; children themselves stay hidden. A group's base also counts for its
    children due on invoice.
    """
    nets, owed = ([f"_{n}_{i}" for i in range(len(periods))] for n in ("net", "tax"))
    amounts = _tax_amounts(where.apply(lines, accounts), line_taxes, periods)
    nothing = F.lit(None).cast(MONEY)
    hidden = taxes.filter((F.col("type_tax_use") == "none") & F.col("parent_id").isNotNull())
    # Which other taxes an amount also counts for: a group's net for its children, a hidden child's tax for its group.
    through = taxes.filter(F.col("parent_id").isNotNull() & (F.col("exigibility") == "on_invoice") & (F.col("amount_type") != "group")).join(
        taxes.filter(F.col("amount_type") == "group").select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(
        F.col("parent_id").alias("tax_id"), F.col("id").alias("to"), F.lit("net").alias("what"))
    up = hidden.select(F.col("id").alias("tax_id"), F.col("parent_id").alias("to"), F.lit("tax").alias("what"))
    also = through.unionByName(up).groupBy("tax_id").agg(F.collect_list(F.struct("to", "what")).alias("_also"))
    itself = F.array(F.struct(F.col("tax_id").alias("to"), F.lit("both").alias("what")))
    spread = amounts.join(also, "tax_id", "left").withColumn("_t", F.explode(F.concat(itself, F.coalesce("_also", F.slice(itself, 1, 0)))))
    kept = lambda c, kind: F.when(F.col("_t.what").isin("both", kind), F.col(c)).otherwise(nothing).alias(c)
    wide = spread.select(F.col("_t.to").alias("tax_id"), *[kept(c, "net") for c in nets], *[kept(c, "tax") for c in owed]).groupBy("tax_id").agg(
        *[money(F.sum(c)).alias(c) for c in [*nets, *owed]])
    groups = hidden.select(F.col("parent_id").alias("tax_id")).distinct().withColumn("_has_children", F.lit(True))
    shown = taxes.filter(F.col("type_tax_use") != "none").withColumnRenamed("id", "tax_id").join(groups, "tax_id", "left")
    shown = shown.filter((F.col("amount_type") != "group") | F.col("_has_children"))
    label = F.when(F.col("amount_type") == "group", F.col("name")).otherwise(
        F.concat(F.col("name"), F.lit(" ("), F.col("amount").cast("string"), F.lit(")")))
    sign = F.when(F.col("type_tax_use") == "sale", -1).otherwise(1)
    return shown.join(wide, "tax_id").select(
        F.col("type_tax_use").alias("section"), "tax_id", label.alias("name"), "sequence",
        *[(F.col(f"_{n}_{i}") * sign).cast(MONEY).alias(f"{n}_{i}") for i in range(len(periods)) for n in ("net", "tax")])


def tax_totals(by_period: DataFrame, periods: int, with_difference: bool = False) -> DataFrame:
    """Section totals, their sum, and optionally sales less purchases, for every period."""
    columns = [f"{n}_{i}" for i in range(periods) for n in ("net", "tax")]
    per = by_period.groupBy("section").agg(*[F.sum(c).cast(MONEY).alias(c) for c in columns])
    total = per.agg(*[F.sum(c).cast(MONEY).alias(c) for c in columns]).select(F.lit("total").alias("section"), *columns)
    out = per.unionByName(total)
    if with_difference:
        signed = [F.sum(F.when(F.col("section") == "sale", F.col(c)).otherwise(-F.col(c))).cast(MONEY).alias(c) for c in columns]
        out = out.unionByName(per.agg(*signed).select(F.lit("difference").alias("section"), *columns))
    return out


def tax_grids(lines: DataFrame, line_tags: DataFrame, tags: DataFrame, report_tags: DataFrame, journals: DataFrame,
              accounts: DataFrame, where: LedgerFilter, refund: Column | None = None) -> DataFrame:
    """Balance per tax report line from tags, with tag, sale and refund signs.

    ``refund`` may replace the condition that marks refunds.
    """
    regular = F.col("cash_basis_rec_id").isNull()
    is_refund = refund if refund is not None else regular & F.col("move_type").isin("in_refund", "out_refund")
    signed = [F.when(F.col("tax_negate"), -1).otherwise(1), F.when(regular & (F.col("journal_type") == "sale"), -1).otherwise(1),
              F.when(is_refund, -1).otherwise(1)]
    j = journals.select(F.col("id").alias("journal_id"), F.col("type").alias("journal_type"))
    rows = (where.apply(lines, accounts).join(line_tags.withColumnRenamed("line_id", "id"), "id")
            .join(tags.select(F.col("id").alias("tag_id"), "tax_negate"), "tag_id").join(j, "journal_id"))
    value = F.coalesce("balance", F.lit(0)) * signed[0] * signed[1] * signed[2]
    per_tag = rows.groupBy("tag_id").agg(F.sum(value).cast(MONEY).alias("balance"))
    return per_tag.join(report_tags, "tag_id").groupBy("report_line_id").agg(F.sum("balance").cast(MONEY).alias("balance"))
