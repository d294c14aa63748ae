"""All registered queries."""

from ledgerlake.plans import ingest, inventory, ledger, planning, procurement, receivables, statements
from ledgerlake.plans.base import Query

FAMILIES = [ledger.FAMILY, statements.FAMILY, receivables.FAMILY, planning.FAMILY, inventory.FAMILY, procurement.FAMILY, ingest.FAMILY]


def queries() -> dict[str, Query]:
    return {name: run for family in FAMILIES for name, run in family.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for family in FAMILIES for name, text in family.oracle.items()}
