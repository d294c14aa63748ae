"""ERP-shaped tables derived from the driver's star-schema parquet files.

Each column is one dialect-neutral expression, so that the same derivation can be handed to an
independent SQL engine for checking. Derived tables stay lazy: a query scans only the columns it
uses. One source line fans out to several ledger lines (or stock moves) by exploding a short
array of slot numbers, which keeps the fan-out narrow and free of joins.
"""

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MONEY = "DECIMAL(18,2)"


def _money(expr: str) -> str:
    return f"CAST({expr} AS {MONEY})"


# One row per source line, joined to its order.
SALE = {
    "lid": "(CAST(l_orderkey AS BIGINT) * 8 + l_linenumber) * 1048576 "
           "+ (CAST(ROUND(l_extendedprice * 100) AS BIGINT) + l_partkey * 7) % 1048576",
    "orderkey": "l_orderkey",
    "linenumber": "l_linenumber",
    "partkey": "l_partkey",
    "suppkey": "l_suppkey",
    "custkey": "o_custkey",
    "status": "o_orderstatus",
    "flag": "l_returnflag",
    "linestatus": "l_linestatus",
    "orderdate": "CAST(o_orderdate AS DATE)",
    "shipdate": "CAST(l_shipdate AS DATE)",
    "qty": _money("l_quantity"),
    "ext": _money("l_extendedprice"),
    "rate": "CAST(l_tax AS DECIMAL(4,2))",
    "net": _money("ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2)"),
}
SALE_AMOUNTS = {
    "tax": _money("ROUND(net * rate, 2)"),
    "cost": _money("ROUND(ext * CAST(0.60 AS DECIMAL(4,2)), 2)"),
    "cost_tax": _money("ROUND(CAST(ROUND(ext * CAST(0.60 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) * rate, 2)"),
}

# Ledger slots: 0 receivable, 1 income, 2 sale tax, 3 bank, 4 receivable settled, 5 cost,
# 6 payable, 7 purchase tax. Slots 3 and 4 exist only for finished orders.
LINE_SLOTS_PAID = [0, 1, 2, 3, 4, 5, 6, 7]
LINE_SLOTS_OPEN = [0, 1, 2, 5, 6, 7]
_DEBIT = ("CASE slot WHEN 0 THEN net + tax WHEN 3 THEN net + tax WHEN 5 THEN cost "
          "WHEN 7 THEN cost_tax ELSE CAST(0 AS DECIMAL(18,2)) END")
_CREDIT = ("CASE slot WHEN 1 THEN net WHEN 2 THEN tax WHEN 4 THEN net + tax "
           "WHEN 6 THEN cost + cost_tax ELSE CAST(0 AS DECIMAL(18,2)) END")
MOVE_LINE = {
    "id": "lid * 8 + slot",
    "move_id": "CASE WHEN slot IN (3, 4) THEN lid * 4 + 3 WHEN slot < 3 THEN orderkey * 4 + 1 ELSE orderkey * 4 + 2 END",
    "move_name": "CASE WHEN slot IN (3, 4) THEN 'BNK/' || CAST(lid AS STRING) "
                 "WHEN slot < 3 THEN 'INV/' || CAST(orderkey AS STRING) ELSE 'BILL/' || CAST(orderkey AS STRING) END",
    "account_id": "CAST(CASE slot WHEN 0 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 2 "
                  "WHEN 5 THEN 6 WHEN 6 THEN 3 ELSE 4 END AS BIGINT)",
    "journal_id": "CAST(CASE WHEN slot IN (3, 4) THEN 3 WHEN slot < 3 THEN 1 ELSE 2 END AS BIGINT)",
    "partner_id": "CASE WHEN slot < 5 THEN custkey * 2 ELSE suppkey * 2 + 1 END",
    "company_id": "CAST(1 + orderkey % 3 AS BIGINT)",
    "date": "CASE WHEN slot IN (3, 4) THEN shipdate ELSE orderdate END",
    "date_maturity": "CASE WHEN slot IN (0, 4, 6) THEN shipdate END",
    "debit": _money(_DEBIT),
    "credit": _money(_CREDIT),
    "balance": _money(f"({_DEBIT}) - ({_CREDIT})"),
    "currency_id": "CAST(1 + custkey % 3 AS BIGINT)",
    "amount_currency": _money(f"(({_DEBIT}) - ({_CREDIT})) * CAST(1 + custkey % 3 AS DECIMAL(4,0))"),
    "ref": "CASE WHEN slot > 4 THEN 'PO' || CAST(orderkey AS STRING) WHEN slot = 0 THEN '' END",
    "name": "CASE WHEN slot IN (3, 4) THEN '/' ELSE 'Line ' || CAST(linenumber AS STRING) END",
    "reconciled": "status = 'F' AND slot IN (0, 4)",
    "full_reconcile_id": "CASE WHEN status = 'F' AND slot IN (0, 4) THEN lid END",
    "tax_line_id": "CASE slot WHEN 2 THEN 1 + CAST(rate * 100 AS BIGINT) WHEN 7 THEN 101 + CAST(rate * 100 AS BIGINT) END",
    "parent_state": "CASE WHEN status = 'O' THEN 'draft' WHEN status = 'P' AND orderkey % 50 = 0 THEN 'cancel' ELSE 'posted' END",
    "display_type": "CASE slot WHEN 0 THEN 'payment_term' WHEN 2 THEN 'tax' WHEN 1 THEN 'product' END",
    "analytic_id": "CASE WHEN slot IN (1, 5) THEN 1 + partkey % 10 END",
    "followup_line_id": "CASE WHEN slot = 0 AND orderkey % 4 > 0 THEN CAST(orderkey % 4 AS BIGINT) END",
    "followup_date": "CASE WHEN slot = 0 AND orderkey % 4 > 0 THEN orderdate + 20 END",
    "move_type": "CASE WHEN slot IN (3, 4) THEN 'entry' ELSE CASE WHEN slot < 3 THEN 'out_' ELSE 'in_' END || CASE WHEN flag = 'R' THEN 'refund' ELSE 'invoice' END END",
    "cash_basis_rec_id": "CASE WHEN lid % 11 = 0 THEN lid END",
    "product_id": "partkey",
    "asset_category_id": "CASE WHEN slot IN (1, 5) AND partkey % 5 = 0 THEN CAST(1 + partkey % 3 AS BIGINT) END",
}
PARTIAL = {
    "debit_line_id": "lid * 8",
    "credit_line_id": "lid * 8 + 4",
    "amount": _money("net + tax"),
    "max_date": "shipdate",
    "company_id": "CAST(1 + orderkey % 3 AS BIGINT)",
}
_RATE = "CAST(rate * 100 AS BIGINT)"
LINE_TAX = {
    "line_id": "lid * 8 + slot",
    "tax_id": f"CASE WHEN {_RATE} >= 7 AND lid % 2 = 0 THEN CASE slot WHEN 1 THEN 201 ELSE 202 END "
              f"WHEN slot = 1 THEN 1 + {_RATE} ELSE 101 + {_RATE} END",
}
# Documents: slot 0 customer side, slot 1 supplier side; returned lines are refunds.
INVOICE = {
    "id": "lid * 2 + slot",
    "name": "CASE slot WHEN 0 THEN 'INV/' ELSE 'BILL/' END || CAST(lid AS STRING)",
    "partner_id": "CASE slot WHEN 0 THEN custkey * 2 ELSE suppkey * 2 + 1 END",
    "move_type": "CASE slot WHEN 0 THEN 'out_' ELSE 'in_' END || CASE WHEN flag = 'R' THEN 'refund' ELSE 'invoice' END",
    "state": "CASE WHEN status = 'O' THEN 'draft' WHEN status = 'P' AND orderkey % 50 = 0 THEN 'cancel' ELSE 'posted' END",
    "company_id": "CAST(1 + orderkey % 3 AS BIGINT)",
    "invoice_date": "orderdate",
    "invoice_date_due": "shipdate",
    "amount_total": _money("CASE slot WHEN 0 THEN net + tax ELSE cost + cost_tax END"),
    "amount_residual": _money("CASE WHEN status = 'F' THEN CAST(0 AS DECIMAL(18,2)) "
                              "WHEN status = 'P' THEN ROUND(CASE slot WHEN 0 THEN net + tax ELSE cost + cost_tax END * CAST(0.5 AS DECIMAL(2,1)), 2) "
                              "ELSE CASE slot WHEN 0 THEN net + tax ELSE cost + cost_tax END END"),
}

# Stock slots: 0 receipt, 1 delivery, 2 customer return, 3 internal use (production, transit, loss).
STOCK_MOVE = {
    "id": "lid * 4 + slot",
    "product_id": "partkey",
    "company_id": "CAST(1 + suppkey % 5 AS BIGINT)",
    "src_usage": "CASE slot WHEN 0 THEN 'supplier' WHEN 2 THEN 'customer' ELSE 'internal' END",
    "dest_usage": "CASE slot WHEN 0 THEN 'internal' WHEN 2 THEN 'internal' WHEN 1 THEN 'customer' "
                  "ELSE CASE linenumber WHEN 5 THEN 'production' WHEN 6 THEN 'transit' ELSE 'inventory' END END",
    "qty": _money("CASE WHEN slot = 3 THEN ROUND(qty * CAST(0.5 AS DECIMAL(2,1)), 2) ELSE qty END"),
    "date": "CASE slot WHEN 0 THEN orderdate + CAST(linenumber % 6 AS INT) WHEN 1 THEN shipdate WHEN 2 THEN shipdate + 7 ELSE orderdate + 30 END",
    "state": "CASE WHEN slot = 1 AND status <> 'F' THEN 'assigned' "
             "WHEN slot = 0 AND status = 'P' AND flag = 'N' AND linestatus = 'O' THEN 'assigned' ELSE 'done' END",
    "picking_id": "orderkey * 4 + slot",
    "picking_type": "CASE slot WHEN 0 THEN 'incoming' WHEN 2 THEN 'incoming' WHEN 1 THEN 'outgoing' ELSE 'internal' END",
    "returned_move_id": "CASE WHEN slot = 2 THEN lid * 4 + 1 END",
    "lot_id": "CASE WHEN linenumber < 7 THEN partkey * 10 + linenumber END",
    "requisition_id": "CASE WHEN orderkey % 2 = 0 THEN orderkey END",
    "car_id": "CASE WHEN custkey % 50 > 0 THEN CAST(custkey % 50 AS BIGINT) END",
    "department_id": "CAST(custkey % 7 AS BIGINT)",
    "partner_id": "suppkey * 2 + 1",
    "origin": "CASE slot WHEN 0 THEN 'PO' || CAST(orderkey * 2 + linenumber % 2 AS STRING) END",
    "location": "'Shelf ' || CAST(partkey % 9 AS STRING)",
}
VALUATION = {
    "stock_move_id": "lid * 4",
    "product_id": "partkey",
    "company_id": "CAST(1 + suppkey % 5 AS BIGINT)",
    "remaining_qty": _money("CASE WHEN status = 'O' THEN qty ELSE CAST(0 AS DECIMAL(18,2)) END"),
    "remaining_value": _money("CASE WHEN status = 'O' THEN ext ELSE CAST(0 AS DECIMAL(18,2)) END"),
}
PRODUCT = {
    "id": "p_partkey",
    "code": "CASE WHEN p_partkey % 10 > 0 THEN 'P' || CAST(p_partkey AS STRING) END",
    "name": "p_name",
    "category": "p_type",
    "standard_price": _money("p_retailprice"),
    "active": "p_partkey % 50 <> 1",
    "type": "CASE WHEN p_partkey % 40 = 3 THEN 'service' ELSE 'product' END",
}
PURCHASE_LINE = {
    "id": "lid",
    "order_id": "orderkey * 2 + linenumber % 2",
    "order_name": "'PO' || CAST(orderkey * 2 + linenumber % 2 AS STRING)",
    "date_order": "orderdate",
    "date_approve": "orderdate + linenumber",
    "state": "CASE WHEN status = 'O' THEN 'draft' ELSE 'purchase' END",
    "partner_id": "suppkey * 2 + 1",
    "requisition_id": "orderkey",
    "product_id": "partkey",
    "price_unit": _money("ext * CAST(0.05 AS DECIMAL(4,2))"),
    "product_qty": "qty",
    "price_total": "ext",
}
REQUISITION_LINE = {
    "id": "lid",
    "requisition_id": "orderkey",
    "product_id": "partkey",
    "qty": "qty",
    "part_type": "CASE flag WHEN 'A' THEN 'genuine' WHEN 'N' THEN 'aftermarket' ELSE 'used' END",
    "line_status": "CASE WHEN status = 'F' THEN 'picked' WHEN status = 'P' AND flag = 'R' THEN 'cancelled' "
                   "WHEN status = 'P' THEN 'received' ELSE 'draft' END",
    "line_type": "CASE WHEN linestatus = 'F' THEN 'internal' ELSE 'purchase' END",
    "lot_id": "CASE WHEN linenumber < 7 THEN partkey * 10 + linenumber END",
    "vendor_id": "CASE WHEN flag = 'N' THEN suppkey * 2 + 1 END",
    "vendor_1": "CASE WHEN linenumber > 1 THEN suppkey * 2 + 1 END",
    "vendor_2": "CASE WHEN partkey % 2 = 0 THEN (suppkey * 7 + 3) % 10 * 2 + 1 END",
    "request_date": "orderdate",
    "department_id": "CAST(custkey % 7 AS BIGINT)",
    "employee_id": "custkey",
    "car_id": "CAST(custkey % 50 AS BIGINT)",
}
REQUISITION = {
    "id": "o_orderkey",
    "request_date": "CAST(o_orderdate AS DATE)",
    "department_id": "CAST(o_custkey % 7 AS BIGINT)",
    "employee_id": "o_custkey",
    "car_id": "CAST(o_custkey % 50 AS BIGINT)",
}
CUSTOMER_PARTNER = {
    "id": "c_custkey * 2",
    "name": "c_name",
    "ref": "CASE WHEN c_custkey % 3 = 0 THEN 'C' || CAST(c_custkey AS STRING) END",
    "segment": "c_mktsegment",
    "warning_stage": _money("CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 200000 END"),
    "blocking_stage": _money("CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 600000 END"),
    "active_limit": "c_custkey % 6 <> 0",
}
SUPPLIER_PARTNER = {
    "id": "s_suppkey * 2 + 1",
    "name": "s_name",
    "ref": "CAST(NULL AS STRING)",
    "segment": "'SUPPLIER'",
    "warning_stage": _money("0"),
    "blocking_stage": _money("0"),
    "active_limit": "CAST(NULL AS BOOLEAN)",
}
VEHICLE = {
    "id": "s_suppkey",
    "vin_sn": "'VIN' || CAST(s_suppkey % 90 AS STRING)",
    "car_id": "'CAR' || CAST(s_suppkey % 95 AS STRING)",
    "title_en": "s_name",
}
WAREHOUSE = {
    "id": "CAST(n_nationkey AS BIGINT)",
    "company_id": "CAST(1 + n_regionkey AS BIGINT)",
    "name": "n_name",
}
ASSET = {
    "id": "p_partkey",
    "name": "p_name",
    "category_id": "CAST(1 + p_partkey % 3 AS BIGINT)",
    "date": "CAST('1995-01-01' AS DATE) + p_size * 7",
    "value": _money("p_retailprice"),
    "salvage": _money("CASE WHEN p_partkey % 7 = 0 THEN 50 ELSE 0 END"),
    "method": "CASE WHEN p_partkey % 2 = 0 THEN 'linear' ELSE 'degressive' END",
    "method_time": "CASE WHEN p_partkey % 6 = 4 THEN 'end' ELSE 'number' END",
    "method_number": "CAST(3 + p_size % 10 AS INT)",
    "method_period": "CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 12 END AS INT)",
    "method_end": "CAST('1997-06-30' AS DATE)",
    "factor": "CAST(0.30 AS DECIMAL(4,2))",
    "prorata": "p_partkey % 4 >= 2",
    "partner_id": "CAST(1 + p_partkey % 20 AS BIGINT)",
    "company_id": "CAST(1 + p_partkey % 3 AS BIGINT)",
    "state": "CASE WHEN p_partkey % 9 = 0 THEN 'draft' ELSE 'open' END",
}
BUDGET_LINE = {
    "id": "c_custkey",
    "budget_id": "CAST(c_custkey % 50 AS BIGINT)",
    "position": "CAST(c_custkey % 4 AS INT)",
    "analytic_id": "CASE WHEN c_custkey % 3 > 0 THEN CAST(1 + c_custkey % 10 AS BIGINT) END",
    "date_from": "CAST('1995-01-01' AS DATE) + CAST(c_custkey * 13 % 2000 AS INT)",
    "date_to": "CAST('1995-01-01' AS DATE) + CAST(c_custkey * 13 % 2000 + c_custkey % 400 AS INT)",
    "paid_date": "CASE WHEN c_custkey % 11 = 0 THEN CAST('1997-06-30' AS DATE) + CAST(c_custkey % 700 AS INT) END",
    "planned": _money("c_acctbal * CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE -100 END"),
}
# Budgetary positions: number -> accounts.
POSITIONS = {0: [], 1: [5], 2: [6], 3: [5, 6]}
RECURRING = {
    "id": "c_custkey",
    "date_begin": "CAST('1995-01-01' AS DATE) + CAST(c_custkey % 365 AS INT)",
    "date_end": "CAST('1996-03-31' AS DATE) + CAST(c_custkey % 200 AS INT)",
    "period": "CASE c_custkey % 4 WHEN 0 THEN 'days' WHEN 1 THEN 'weeks' WHEN 2 THEN 'months' ELSE 'years' END",
    "interval": "CAST(1 + c_custkey % 3 * 2 AS INT)",
    "amount": _money("c_acctbal"),
    "debit_account_id": "CAST(6 AS BIGINT)",
    "credit_account_id": "CAST(3 AS BIGINT)",
    "journal_id": "CAST(2 AS BIGINT)",
}
FISCAL_YEAR = {
    "id": "c_custkey",
    "company_id": "CAST(c_custkey % 500 AS BIGINT)",
    "date_from": "CAST('1995-01-01' AS DATE) + CAST(c_custkey * 7919 % 20000 AS INT)",
    "date_to": "CAST('1995-12-31' AS DATE) + CAST(c_custkey * 7919 % 20000 AS INT) - CAST(CASE WHEN c_custkey % 97 = 0 THEN 400 ELSE 0 END AS INT)",
}

# Fixed small dimensions (chart of accounts, journals, taxes, follow-up levels, rates).
ACCOUNTS = [
    (1, "101", "Bank", "asset_cash", "asset", True, False, [1]),
    (2, "121", "Receivable", "asset_receivable", "asset", True, False, [1]),
    (3, "211", "Payable", "liability_payable", "liability", True, False, [2]),
    (4, "251", "Tax", "liability_current", "liability", True, False, [2]),
    (5, "400", "Sales", "income", "income", False, False, [3]),
    (6, "500", "Cost of sales", "expense_direct_cost", "expense", False, False, [3]),
    (7, "999", "Current year earnings", "equity_unaffected", "equity", False, False, []),
    (8, "600", "Other expenses", "expense", "expense", False, False, [3]),
]
ACCOUNT_SCHEMA = ("id long, code string, name string, account_type string, internal_group string, "
                  "include_initial_balance boolean, deprecated boolean, tag_ids array<long>")
JOURNALS = [(1, "INV", "Customer invoices", "sale"), (2, "BILL", "Vendor bills", "purchase"), (3, "BNK", "Bank", "bank")]
JOURNAL_SCHEMA = "id long, code string, name string, type string"
TAXES = (
    [(1 + r, f"Sale {r}%", "none" if r >= 7 else "sale", "percent", "on_payment" if r % 4 == 3 else "on_invoice", r, r, 201 if r >= 7 else None)
     for r in range(9)]
    + [(101 + r, f"Purchase {r}%", "none" if r >= 7 else "purchase", "percent", "on_payment" if r % 4 == 3 else "on_invoice", r, r, 202 if r >= 7 else None)
       for r in range(9)]
    + [(201, "Sale high", "sale", "group", "on_invoice", 90, 0, None), (202, "Purchase high", "purchase", "group", "on_invoice", 91, 0, None)]
)
TAX_SCHEMA = "id long, name string, type_tax_use string, amount_type string, exigibility string, sequence int, amount int, parent_id long"
LEVELS = [(1, 15, "first reminder"), (2, 45, "second reminder"), (3, 90, "final notice")]
TAGS = [(t, t % 2 == 1) for t in (40, 41, 42, 50, 51, 52, 60, 61, 62)]
TAG_SCHEMA = "id long, tax_negate boolean"
REPORT_TAGS = [(t // 10, t) for t in (40, 41, 42, 50, 51, 52, 60, 61)] + [(9, 40), (9, 50)]
REPORT_TAG_SCHEMA = "report_line_id long, tag_id long"
# Report tree: id, parent, name, sequence, type, sign, account types, accounts, referenced node, detail.
NODES = [
    (1, None, "Profit and Loss", 1, "sum", -1, [], [], None, "no_detail"),
    (2, 1, "Income", 1, "account_type", -1, ["income"], [], None, "detail_flat"),
    (3, 1, "Expense", 2, "account_type", 1, ["expense", "expense_direct_cost"], [], None, "detail_flat"),
    (10, None, "Balance Sheet", 2, "sum", 1, [], [], None, "no_detail"),
    (11, 10, "Assets", 1, "sum", 1, [], [], None, "no_detail"),
    (12, 11, "Liquidity", 1, "accounts", 1, [], [1], None, "detail_with_hierarchy"),
    (13, 11, "Receivables", 2, "account_type", 1, ["asset_receivable"], [], None, "no_detail"),
    (17, 11, "Liquidity counted again", 3, "accounts", 1, [], [1, 2], None, "no_detail"),
    (14, 10, "Liabilities", 2, "sum", -1, [], [], None, "no_detail"),
    (15, 14, "Debts", 1, "account_type", -1, ["liability_payable", "liability_current"], [], None, "detail_with_hierarchy"),
    (16, 14, "Profit taken over", 2, "account_report", -1, [], [], 1, "no_detail"),
    (20, None, "Operating result", 3, "subtract", 1, [], [], None, "no_detail"),
    (21, 20, "Turnover", 1, "account_type", 1, ["income"], [], None, "no_detail"),
    (22, 20, "Direct cost", 2, "account_type", 1, ["expense_direct_cost"], [], None, "no_detail"),
    (23, 20, "Other cost", 3, "account_report", 1, [], [], 3, "no_detail"),
    (30, None, "Net Profit", 4, "subtract", -1, [], [], None, "no_detail"),
    (31, 30, "Earned", 1, "account_report", 1, [], [], 2, "no_detail"),
    (32, 30, "Spent", 2, "account_report", 1, [], [], 3, "no_detail"),
    (40, None, "Everything", 5, "total", 1, [], [], None, "no_detail"),
    (41, 40, "Sheet", 1, "account_report", 1, [], [], 10, "no_detail"),
    (42, 40, "Operating", 2, "account_report", 1, [], [], 20, "no_detail"),
]
NODE_SCHEMA = ("id long, parent_id long, name string, sequence int, type string, sign int, account_types array<string>, "
               "account_ids array<long>, ref_id long, display_detail string")
SECTIONS = [("operation", 2), ("operation", 3), ("financing", 4), ("investing", 5), ("investing", 6)]
SECTION_SCHEMA = "section string, account_id long"
LEVEL_SCHEMA = "id long, delay int, description string"
RATES = [(1, "1995-01-01", "1.000000"), (2, "1995-01-01", "2.000000"), (2, "1998-01-01", "1.900000"),
         (3, "1995-01-01", "3.000000"), (3, "1999-06-15", "3.300000")]
CATEGORIES = [(1, "Machines", 11, 12, 13, False, 12, 12), (2, "Vehicles", 21, 22, 23, True, 24, 1), (3, "Tools", 31, 32, 33, True, 6, 1)]
CATEGORY_SCHEMA = ("id long, name string, asset_account_id long, depreciation_account_id long, expense_account_id long, "
                   "group_entries boolean, method_number int, method_period int")


def local_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A fixed small table that the planner knows the size of."""
    schema = T.StructType.fromDDL(ddl)
    names = schema.fieldNames()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r)) for r in rows], to_arrow_schema(schema)))


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in columns.items()])


# A split becomes at most this many pieces when the input has too few of them.
PIECES_PER_SPLIT = 64


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over the cores when a scan has fewer splits than there are cores.

    A file of a single row group is read by one task however large the cluster. A real data set comes
    in more splits than cores and is left as it is, so nothing is shuffled there.
    """
    if df.isStreaming:
        return df
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if splits * 2 > cores else df.repartition(min(cores, splits * PIECES_PER_SPLIT))


# Schemas already read from file footers, so that later queries need not open them again.
_SCHEMAS: dict[str, T.StructType] = {}


class Testbed:
    """Lazily derived ERP tables over one directory of parquet files."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def _slots(self, column) -> DataFrame:
        return self.sale.withColumn("slot", F.explode(column))

    @cached_property
    def sale(self) -> DataFrame:
        joined = spread(self.raw("lineitem")).join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        base = _project(joined, SALE)
        return base.selectExpr("*", *[f"{e} AS `{n}`" for n, e in SALE_AMOUNTS.items()])

    @cached_property
    def move_line(self) -> DataFrame:
        paid = F.array(*[F.lit(s) for s in LINE_SLOTS_PAID])
        open_ = F.array(*[F.lit(s) for s in LINE_SLOTS_OPEN])
        return _project(self._slots(F.when(F.col("status") == "F", paid).otherwise(open_)), MOVE_LINE)

    @cached_property
    def partial(self) -> DataFrame:
        return _project(self.sale.filter("status = 'F'"), PARTIAL)

    @cached_property
    def line_tax(self) -> DataFrame:
        return _project(self._slots(F.array(F.lit(1), F.lit(5))), LINE_TAX)

    @cached_property
    def invoice(self) -> DataFrame:
        return _project(self._slots(F.array(F.lit(0), F.lit(1))), INVOICE)

    @cached_property
    def stock_move(self) -> DataFrame:
        base = F.array(F.lit(0), F.lit(1))
        returned = F.when((F.col("flag") == "R") & (F.col("status") == "F"), F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
        used = F.when(F.col("linenumber") >= 5, F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))
        return _project(self._slots(F.concat(base, returned, used)), STOCK_MOVE)

    @cached_property
    def valuation(self) -> DataFrame:
        return _project(self.sale, VALUATION)

    @cached_property
    def purchase_line(self) -> DataFrame:
        return _project(self.sale, PURCHASE_LINE)

    @cached_property
    def requisition_line(self) -> DataFrame:
        return _project(self.sale, REQUISITION_LINE)

    @cached_property
    def requisition(self) -> DataFrame:
        return _project(spread(self.raw("orders")), REQUISITION)

    @cached_property
    def product(self) -> DataFrame:
        return _project(self.raw("part"), PRODUCT)

    @cached_property
    def partner(self) -> DataFrame:
        return _project(self.raw("customer"), CUSTOMER_PARTNER).unionByName(_project(self.raw("supplier"), SUPPLIER_PARTNER))

    @cached_property
    def warehouse(self) -> DataFrame:
        return _project(self.raw("nation"), WAREHOUSE)

    @cached_property
    def vehicle(self) -> DataFrame:
        return _project(self.raw("supplier"), VEHICLE)

    @cached_property
    def asset(self) -> DataFrame:
        return _project(spread(self.raw("part")), ASSET)

    @cached_property
    def analytic_line(self) -> DataFrame:
        return self.move_line.filter("analytic_id IS NOT NULL").selectExpr(
            "id", "analytic_id", "account_id AS general_account_id", "date", "CAST(-balance AS DECIMAL(18,2)) AS amount")

    @cached_property
    def budget_line(self) -> DataFrame:
        accounts = F.create_map(*[x for k, v in POSITIONS.items()
                                  for x in (F.lit(k), F.array(*[F.lit(a).cast("long") for a in v]).cast("array<long>"))])
        return _project(self.raw("customer"), BUDGET_LINE).withColumn("account_ids", accounts[F.col("position")])

    @cached_property
    def recurring(self) -> DataFrame:
        return _project(spread(self.raw("customer")), RECURRING)

    @cached_property
    def fiscal_year(self) -> DataFrame:
        return _project(self.raw("customer"), FISCAL_YEAR)

    @cached_property
    def account(self) -> DataFrame:
        return local_rows(self.spark, ACCOUNTS, ACCOUNT_SCHEMA)

    @cached_property
    def journal(self) -> DataFrame:
        return local_rows(self.spark, JOURNALS, JOURNAL_SCHEMA)

    @cached_property
    def tax(self) -> DataFrame:
        return local_rows(self.spark, TAXES, TAX_SCHEMA)

    @cached_property
    def line_tag(self) -> DataFrame:
        return self.move_line.filter("account_id IN (4, 5, 6)").selectExpr("id AS line_id", "account_id * 10 + id % 3 AS tag_id")

    @cached_property
    def tag(self) -> DataFrame:
        return local_rows(self.spark, TAGS, TAG_SCHEMA)

    @cached_property
    def report_tag(self) -> DataFrame:
        return local_rows(self.spark, REPORT_TAGS, REPORT_TAG_SCHEMA)

    @cached_property
    def node(self) -> DataFrame:
        return local_rows(self.spark, NODES, NODE_SCHEMA)

    @cached_property
    def section(self) -> DataFrame:
        return local_rows(self.spark, SECTIONS, SECTION_SCHEMA)

    @cached_property
    def level(self) -> DataFrame:
        return local_rows(self.spark, LEVELS, LEVEL_SCHEMA)

    @cached_property
    def rate(self) -> DataFrame:
        raw = local_rows(self.spark, RATES, "currency_id long, date string, rate string")
        return raw.select("currency_id", F.to_date("date").alias("date"), F.col("rate").cast("decimal(18,6)").alias("rate"))

    @cached_property
    def asset_category(self) -> DataFrame:
        return local_rows(self.spark, CATEGORIES, CATEGORY_SCHEMA)
