"""Predicates shared by the reports: ledger, product, display and KPI filters."""

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line kinds that never carry amounts.
NON_ACCOUNTABLE = ["line_section", "line_note"]
STRICT, INITIAL, OPEN_START = "strict", "initial", "open_start"


@dataclass(frozen=True)
class LedgerFilter:
    """Which ledger lines a report reads.

    ``mode`` decides what ``date_from`` means: ``strict`` keeps lines from that day on, ``initial``
    keeps the lines before it, and ``open_start`` also keeps earlier lines of accounts that carry
    their balance forward (``include_initial_balance``).
    """

    date_from: date | None = None
    date_to: date | None = None
    mode: str = STRICT
    use_maturity: bool = False
    state: str = "all"
    journal_ids: tuple[int, ...] = ()
    company_ids: tuple[int, ...] = ()
    account_ids: tuple[int, ...] = ()
    account_tag_ids: tuple[int, ...] = ()
    analytic_ids: tuple[int, ...] = ()
    analytic_tag_ids: tuple[int, ...] = ()
    partner_ids: tuple[int, ...] = ()
    partner_categories: tuple[str, ...] = ()
    reconcile_date: date | None = None

    def predicate(self) -> Column:
        """The part of the filter that reads ledger columns only."""
        day = F.col("date_maturity" if self.use_maturity else "date")
        cond = F.coalesce(~F.col("display_type").isin(NON_ACCOUNTABLE), F.lit(True))
        cond &= F.coalesce(F.col("parent_state") != "cancel", F.lit(True))
        if self.date_to:
            cond &= day <= F.lit(self.date_to)
        if self.date_from and self.mode == STRICT:
            cond &= day >= F.lit(self.date_from)
        if self.date_from and self.mode == INITIAL:
            cond &= day < F.lit(self.date_from)
        if self.state != "all":
            cond &= F.col("parent_state") == self.state
        for name, values in (("journal_id", self.journal_ids), ("company_id", self.company_ids),
                             ("account_id", self.account_ids), ("partner_id", self.partner_ids)):
            if values:
                cond &= F.col(name).isin(list(values))
        if self.analytic_ids:
            hits = [F.map_contains_key("analytic", F.lit(str(a))) for a in self.analytic_ids]
            any_hit = hits[0]
            for hit in hits[1:]:
                any_hit |= hit
            cond &= F.coalesce(any_hit, F.lit(False))
        if self.analytic_tag_ids:
            tags = F.array(*[F.lit(t).cast("long") for t in self.analytic_tag_ids])
            cond &= F.coalesce(F.arrays_overlap("analytic_tag_ids", tags), F.lit(False))
        return cond

    def apply(self, lines: DataFrame, accounts: DataFrame | None = None,
              partials: DataFrame | None = None, partners: DataFrame | None = None) -> DataFrame:
        """Filter ``lines``; the dimension tables are needed only for the options that read them."""
        out = lines.filter(self.predicate())
        if self.date_from and self.mode == OPEN_START:
            carried = accounts.select(F.col("id").alias("account_id"), "include_initial_balance")
            day = F.col("date_maturity" if self.use_maturity else "date")
            out = (out.join(carried, "account_id", "left")
                   .filter((day >= F.lit(self.date_from)) | F.col("include_initial_balance"))
                   .select(*lines.columns))
        if self.account_tag_ids:
            tags = F.array(*[F.lit(t).cast("long") for t in self.account_tag_ids])
            tagged = accounts.filter(F.arrays_overlap("tag_ids", tags)).select(F.col("id").alias("account_id"))
            out = out.join(tagged, "account_id", "left_semi")
        if self.partner_categories:
            chosen = partners.filter(F.col("segment").isin(list(self.partner_categories))).select(F.col("id").alias("partner_id"))
            out = out.join(chosen, "partner_id", "left_semi")
        if self.reconcile_date:
            out = open_or_matched_after(out, partials, self.reconcile_date)
        return out


def open_or_matched_after(lines: DataFrame, partials: DataFrame, day: date) -> DataFrame:
    """Lines not reconciled, or matched with an entry dated after ``day``."""
    later = partials.filter(F.col("max_date") > F.lit(day))
    touched = (later.select(F.explode(F.array("debit_line_id", "credit_line_id")).alias("id"))
               .groupBy("id").agg(F.lit(True).alias("_later")))
    return (lines.join(touched, "id", "left")
            .filter(~F.coalesce("reconciled", F.lit(False)) | F.col("_later"))
            .select(*lines.columns))


def states(target_move: str) -> list[str]:
    """Move states read by a report: posted only, or drafts as well."""
    return ["posted"] if target_move == "posted" else ["draft", "posted"]


def ledger_states(choice: str) -> Column:
    """State choice of the interactive reports: posted, draft, or both."""
    kept = {"posted": ["posted"], "draft": ["draft"], "both": ["posted", "draft"]}[choice]
    return F.col("parent_state").isin(kept)


def display_account(df: DataFrame, choice: str, scale: int = 2) -> DataFrame:
    """Keep all accounts, those with movements, or those with a balance."""
    nonzero = {n: F.round(F.col(n), scale) != 0 for n in ("debit", "credit", "balance")}
    if choice == "movement":
        return df.filter(nonzero["debit"] | nonzero["credit"])
    if choice == "not_zero":
        return df.filter(nonzero["balance"])
    return df


@dataclass(frozen=True)
class ProductFilter:
    """Products or categories (either matches), and companies, and warehouses."""

    product_ids: tuple[int, ...] = ()
    categories: tuple[str, ...] = ()
    company_ids: tuple[int, ...] = ()
    warehouse_ids: tuple[int, ...] = ()

    def predicate(self, product: str = "product_id", category: str = "category") -> Column:
        cond = F.lit(True)
        either = None
        if self.product_ids:
            either = F.col(product).isin(list(self.product_ids))
        if self.categories:
            match = F.col(category).isin(list(self.categories))
            either = match if either is None else either | match
        if either is not None:
            cond &= either
        if self.company_ids:
            cond &= F.col("company_id").isin(list(self.company_ids))
        return cond


def kpi_point(name: str) -> Column:
    """Row selection of one named procurement indicator."""
    return _KPI_POINTS[name]()


# Indicator names and their row conditions.
_KPI_POINTS = {
    "parts_arranged_1_day": lambda: F.col("received_date").isNotNull() & (F.col("days_to_received") <= 1),
    "parts_arranged_1_3_days": lambda: F.col("received_date").isNotNull() & F.col("days_to_received").between(1, 3),
    "parts_arranged_above_3_days": lambda: F.col("received_date").isNotNull() & (F.col("days_to_received") > 3),
    "total_parts_purchased": lambda: F.col("po_number").isNotNull(),
    "total_parts_received": lambda: F.col("received_date").isNotNull(),
    "total_parts_received_percentage": lambda: F.col("requested_qty") > 0,
    "total_parts_issued": lambda: F.col("issue_date").isNotNull(),
    "total_parts_issued_percentage": lambda: F.col("issue_date").isNotNull(),
    "total_parts_available": lambda: F.col("total_parts_available") > 0,
    "utilization_percentage": lambda: (F.col("received_qty") > 0) & (F.col("utilization_percentage") > 0),
}
KPI_POINTS = tuple(_KPI_POINTS)
