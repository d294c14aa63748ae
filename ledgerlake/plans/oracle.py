"""Builds the checking SQL: derived tables become CTEs in front of an independently written query."""

from ledgerlake.sources import testbed as t


def _select(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + f" FROM {source}"


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, list):
        return "[" + ", ".join(map(_lit, value)) + "]"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value + "'"


def _values(rows: list[tuple], schema: str) -> str:
    names = ", ".join('"' + c.split()[0] + '"' for c in schema.split(", "))
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


def _slots(array: str) -> str:
    return f"(SELECT *, UNNEST({array}) AS slot FROM sale)"


_SALE = ("SELECT *, " + ", ".join(f'{e} AS "{n}"' for n, e in t.SALE_AMOUNTS.items())
         + " FROM (" + _select(t.SALE, "lineitem JOIN orders ON l_orderkey = o_orderkey") + ")")
_STOCK_SLOTS = ("list_concat([0, 1], list_concat(CASE WHEN flag = 'R' AND status = 'F' THEN [2] ELSE [] END, "
                "CASE WHEN linenumber >= 5 THEN [3] ELSE [] END))")

TABLES: dict[str, tuple[str, list[str]]] = {
    "sale": (_SALE, []),
    "move_line": (_select(t.MOVE_LINE, _slots(f"CASE WHEN status = 'F' THEN {t.LINE_SLOTS_PAID} ELSE {t.LINE_SLOTS_OPEN} END")), ["sale"]),
    "partial": (_select(t.PARTIAL, "sale WHERE status = 'F'"), ["sale"]),
    "line_tax": (_select(t.LINE_TAX, _slots("[1, 5]")), ["sale"]),
    "invoice": (_select(t.INVOICE, _slots("[0, 1]")), ["sale"]),
    "stock_move": (_select(t.STOCK_MOVE, _slots(_STOCK_SLOTS)), ["sale"]),
    "valuation": (_select(t.VALUATION, "sale"), ["sale"]),
    "purchase_line": (_select(t.PURCHASE_LINE, "sale"), ["sale"]),
    "requisition_line": (_select(t.REQUISITION_LINE, "sale"), ["sale"]),
    "requisition": (_select(t.REQUISITION, "orders"), []),
    "product": (_select(t.PRODUCT, "part"), []),
    "partner": (_select(t.CUSTOMER_PARTNER, "customer") + " UNION ALL " + _select(t.SUPPLIER_PARTNER, "supplier"), []),
    "warehouse": (_select(t.WAREHOUSE, "nation"), []),
    "vehicle": (_select(t.VEHICLE, "supplier"), []),
    "asset": (_select(t.ASSET, "part"), []),
    "analytic_line": ("SELECT id, analytic_id, account_id AS general_account_id, date, -balance AS amount FROM move_line WHERE analytic_id IS NOT NULL", ["move_line"]),
    "budget_line": ("SELECT *, CASE position " + " ".join(f"WHEN {k} THEN {v}" for k, v in t.POSITIONS.items() if v) + " ELSE [] END AS account_ids FROM ("
                    + _select(t.BUDGET_LINE, "customer") + ")", []),
    "recurring": (_select(t.RECURRING, "customer"), []),
    "fiscal_year": (_select(t.FISCAL_YEAR, "customer"), []),
    "account": (_values(t.ACCOUNTS, t.ACCOUNT_SCHEMA), []),
    "journal": (_values(t.JOURNALS, t.JOURNAL_SCHEMA), []),
    "taxes": (_values(t.TAXES, t.TAX_SCHEMA), []),
    "line_tag": ("SELECT id AS line_id, account_id * 10 + id % 3 AS tag_id FROM move_line WHERE account_id IN (4, 5, 6)", ["move_line"]),
    "tag": (_values(t.TAGS, t.TAG_SCHEMA), []),
    "report_tag": (_values(t.REPORT_TAGS, t.REPORT_TAG_SCHEMA), []),
    "node": (_values(t.NODES, t.NODE_SCHEMA), []),
    "section": (_values(t.SECTIONS, t.SECTION_SCHEMA), []),
    "level": (_values(t.LEVELS, t.LEVEL_SCHEMA), []),
    "rate": ("SELECT currency_id, CAST(date AS DATE) AS date, CAST(rate AS DECIMAL(18,6)) AS rate FROM ("
             + _values(t.RATES, "currency_id long, date string, rate string") + ")", []),
    "asset_category": (_values(t.CATEGORIES, t.CATEGORY_SCHEMA), []),
}


def sql(tables: str, body: str, **ctes: str) -> str:
    """``WITH`` the named derived tables (and extra ``ctes``), then ``body``."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in TABLES[name][1]:
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in tables.split():
        add(name)
    parts = [f"{n} AS ({TABLES[n][0]})" for n in needed] + [f"{n} AS ({b})" for n, b in ctes.items()]
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body


def ratio(numerator: str, denominator: str, scale: int = 2, factor: int = 1, unit: int = 100) -> str:
    """Exact half-away-from-zero quotient of two decimals, as DOUBLE.

    Integer arithmetic on ``1/unit`` steps; the caller guards a zero denominator.
    """
    n = f"(CAST(({numerator}) * {unit} AS HUGEINT) * {factor * 10 ** scale})"
    d = f"CAST(({denominator}) * {unit} AS HUGEINT)"
    return f"(CAST(SIGN({n}) * SIGN({d}) * ((2 * ABS({n}) + ABS({d})) // (2 * ABS({d}))) AS DOUBLE) / {10 ** scale}.0)"
