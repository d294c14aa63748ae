"""Procurement queries over the derived tables."""

from pyspark.sql import functions as F

from ledgerlake.functions.filters import KPI_POINTS
from ledgerlake.operators import inventory
from ledgerlake.operators import procurement as op
from ledgerlake.plans.base import Family
from ledgerlake.plans.oracle import ratio, sql

FAMILY = Family()


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


_USED = f"CASE WHEN recv > 0 THEN {ratio('LEAST(iss, recv)', 'NULLIF(recv, 0)', 4)} ELSE 0 END"
_KPI = dict(
    po="""SELECT * FROM purchase_line QUALIFY ROW_NUMBER() OVER (PARTITION BY requisition_id, product_id ORDER BY order_id DESC, id DESC) = 1""",
    received="""SELECT product_id, origin, MIN(date) AS received_date, SUM(qty) AS recv FROM stock_move
      WHERE picking_type = 'incoming' AND state = 'done' AND origin IS NOT NULL GROUP BY product_id, origin""",
    issued="SELECT product_id, MIN(date) AS issue_date, SUM(qty) AS iss FROM stock_move WHERE picking_type = 'outgoing' AND state = 'done' GROUP BY product_id",
    kpi=f"""SELECT ROW_NUMBER() OVER (ORDER BY q.request_date DESC, q.id DESC, l.id DESC) AS row_no, q.id AS requisition_id, l.id AS line_id, q.car_id, v.vin_sn,
      q.department_id, q.employee_id, q.request_date, l.part_type, l.product_id, l.qty AS requested_qty, l.line_status, po.order_name AS po_number,
      po.date_order AS po_date, po.partner_id AS vendor_id, po.price_unit AS parts_price, po.product_qty AS ordered_quantity, received_date,
      COALESCE(recv, 0) AS received_qty, date_diff('day', q.request_date, received_date) AS days_to_received,
      CASE WHEN l.qty > 0 THEN {ratio("COALESCE(recv, 0)", "NULLIF(l.qty, 0)", 4)} ELSE 0 END AS total_parts_received_percentage,
      issue_date, COALESCE(iss, 0) AS issued_qty, {_USED} AS total_parts_issued_percentage,
      COALESCE(recv, 0) - COALESCE(iss, 0) AS total_parts_available, {_USED} AS utilization_percentage
      FROM requisition_line l JOIN requisition q ON q.id = l.requisition_id LEFT JOIN vehicle v ON v.id = q.car_id
      LEFT JOIN po ON po.requisition_id = q.id AND po.product_id = l.product_id
      LEFT JOIN received r ON r.product_id = l.product_id AND r.origin = po.order_name
      LEFT JOIN issued i ON i.product_id = l.product_id""")
_KPI_DBL = "* REPLACE (" + dbl("requested_qty", "parts_price", "ordered_quantity", "received_qty", "issued_qty", "total_parts_available") + ")"
_TABLES = "requisition_line requisition vehicle purchase_line stock_move"


def _kpi(t, numbered=True):
    return op.parts_kpi(t.requisition_line, t.requisition, t.purchase_line, t.stock_move, t.vehicle, numbered)


@FAMILY.query("e1_parts_kpi", sql(_TABLES, f"SELECT {_KPI_DBL} FROM kpi", **_KPI))
def _(t):
    return _kpi(t)


@FAMILY.query("f4_kpi_point_selection", sql(_TABLES, f"""SELECT {_KPI_DBL} FROM (SELECT * EXCLUDE (row_no) FROM kpi)
    WHERE received_date IS NOT NULL AND days_to_received BETWEEN 1 AND 3""", **_KPI))
def _(t):
    return op.kpi_selection(_kpi(t, numbered=False), "parts_arranged_1_3_days")


# Conditions written independently of the library's.
_POINTS = {
    "parts_arranged_1_day": "received_date IS NOT NULL AND days_to_received <= 1",
    "parts_arranged_1_3_days": "received_date IS NOT NULL AND days_to_received >= 1 AND days_to_received <= 3",
    "parts_arranged_above_3_days": "received_date IS NOT NULL AND days_to_received > 3",
    "total_parts_purchased": "po_number IS NOT NULL",
    "total_parts_received": "received_date IS NOT NULL",
    "total_parts_received_percentage": "requested_qty > 0",
    "total_parts_issued": "issue_date IS NOT NULL",
    "total_parts_issued_percentage": "issue_date IS NOT NULL",
    "total_parts_available": "total_parts_available > 0",
    "utilization_percentage": "received_qty > 0 AND utilization_percentage > 0",
}


@FAMILY.query("e2_kpi_summary", sql(_TABLES, " UNION ALL ".join(
    f"""SELECT '{p}' AS kpi_point, COUNT(*) AS rows, CAST(COALESCE(SUM(requested_qty), 0) AS DOUBLE) AS requested_qty,
    CAST(COALESCE(SUM(received_qty), 0) AS DOUBLE) AS received_qty, CAST(COALESCE(SUM(issued_qty), 0) AS DOUBLE) AS issued_qty FROM kpi WHERE {_POINTS[p]}"""
    for p in KPI_POINTS), **_KPI))
def _(t):
    return op.kpi_summary(_kpi(t, numbered=False))


@FAMILY.query("e3_direct_issues", sql("stock_move product vehicle", """
    SELECT ROW_NUMBER() OVER (ORDER BY m.date DESC, m.id DESC) AS row_no, m.id AS move_id, picking_id, m.date AS issue_date, m.car_id, v.vin_sn, department_id, product_id,
      CAST(m.qty AS DOUBLE) AS issued_qty, CAST(p.standard_price AS DOUBLE) AS unit_price, CAST(m.qty * p.standard_price AS DOUBLE) AS total_value
    FROM stock_move m JOIN product p ON p.id = m.product_id LEFT JOIN vehicle v ON v.id = m.car_id
    WHERE picking_type = 'outgoing' AND m.state = 'done' AND requisition_id IS NULL"""))
def _(t):
    products = t.product.withColumn("prices", F.create_map(F.lit("1"), F.col("standard_price")))
    return op.direct_issues(t.stock_move, products, t.vehicle, "1")


@FAMILY.query("e4_vehicle_stock", sql("stock_move product requisition_line", """
    SELECT m.id AS move_id, m.car_id, m.product_id, m.partner_id AS vendor_id, m.location, m.requisition_id, l.employee_id, m.picking_id, m.lot_id, CAST(m.qty - COALESCE(r.q, 0) AS DOUBLE) AS lot_qty
    FROM stock_move m JOIN requisition_line l ON l.requisition_id = m.requisition_id AND l.product_id = m.product_id AND l.lot_id = m.lot_id
    JOIN product p ON p.id = m.product_id AND p.category = 'PROMO'
    LEFT JOIN (SELECT returned_move_id, lot_id, SUM(qty) AS q FROM stock_move WHERE returned_move_id IS NOT NULL GROUP BY ALL) r ON r.returned_move_id = m.id AND r.lot_id = m.lot_id
    WHERE m.state = 'done' AND m.returned_move_id IS NULL AND m.car_id IS NOT NULL AND m.lot_id IS NOT NULL AND m.qty - COALESCE(r.q, 0) > 0"""))
def _(t):
    return op.vehicle_stock(t.stock_move, t.requisition_line, t.product, category="PROMO")


@FAMILY.query("e5_vehicle_listing", sql("stock_move partner", """SELECT m.date AS date_done, picking_id, m.id AS move_id, product_id, CAST(qty AS DOUBLE) AS qty, COALESCE(p.name, '') AS vendor, location
    FROM stock_move m LEFT JOIN partner p ON p.id = m.partner_id WHERE m.state = 'done' AND car_id = 7"""))
def _(t):
    return op.vehicle_listing(t.stock_move, t.partner, 7)


def _vendor_lines(t):
    return t.requisition_line.withColumn("vendor_ids", F.array_compact(F.array("vendor_1", "vendor_2")))


def _prices(t):
    bought = t.purchase_line.filter("state = 'purchase' AND product_qty > 25")
    return bought.groupBy(F.col("partner_id").alias("vendor_id"), "product_id").agg(F.max("price_unit").alias("price"))


_PLAN = dict(
    prices="SELECT partner_id AS vendor_id, product_id, MAX(price_unit) AS price FROM purchase_line WHERE state = 'purchase' AND product_qty > 25 GROUP BY ALL",
    asked="""SELECT DISTINCT requisition_id, vendor_id, line_id, product_id, product_qty FROM (
      SELECT requisition_id, vendor_1 AS vendor_id, id AS line_id, product_id, qty AS product_qty FROM requisition_line WHERE line_type = 'purchase' AND vendor_1 IS NOT NULL
      UNION ALL SELECT requisition_id, vendor_2, id, product_id, qty FROM requisition_line WHERE line_type = 'purchase' AND vendor_2 IS NOT NULL)""",
    plan="""SELECT a.*, COALESCE(NULLIF(x.price, 0), p.standard_price, 0) AS price_unit FROM asked a
      LEFT JOIN prices x ON x.vendor_id = a.vendor_id AND x.product_id = a.product_id LEFT JOIN product p ON p.id = a.product_id""")


@FAMILY.query("e6_purchase_plan", sql("requisition_line purchase_line product", f"SELECT * REPLACE ({dbl('product_qty', 'price_unit')}) FROM plan", **_PLAN))
def _(t):
    return op.purchase_plan(_vendor_lines(t), _prices(t), t.product)


@FAMILY.query("e6_purchase_orders", sql("requisition_line purchase_line product", """SELECT requisition_id, vendor_id, COUNT(*) AS line_count,
    CAST(SUM(CAST(product_qty * price_unit AS DECIMAL(20,2))) AS DOUBLE) AS amount FROM plan GROUP BY ALL""", **_PLAN))
def _(t):
    return op.purchase_orders(op.purchase_plan(_vendor_lines(t), _prices(t), t.product))


@FAMILY.query("e6_missing_vendors", sql("requisition_line", """SELECT 'vendor_missing' AS rule, CAST(id AS STRING) AS key, CAST(requisition_id AS STRING) AS detail
    FROM requisition_line WHERE line_type = 'purchase' AND vendor_1 IS NULL AND vendor_2 IS NULL"""))
def _(t):
    return op.missing_vendors(_vendor_lines(t))


@FAMILY.query("e7_quotation_split", sql("requisition_line", """
    SELECT request_id, supplier_id, line_id, product_id, part_type, CAST(qty AS DOUBLE) AS product_qty FROM lines WHERE supplier_id IS NOT NULL
    UNION ALL SELECT l.request_id, o.supplier_id, line_id, product_id, part_type, CAST(qty AS DOUBLE) FROM lines l JOIN (
      SELECT DISTINCT requisition_id AS request_id, vendor_2 AS supplier_id FROM requisition_line r WHERE vendor_2 IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM lines x WHERE x.request_id = r.requisition_id AND x.supplier_id = r.vendor_2)) o ON o.request_id = l.request_id
    WHERE l.supplier_id IS NULL""",
    lines="SELECT requisition_id AS request_id, vendor_id AS supplier_id, id AS line_id, product_id, part_type, qty FROM requisition_line"))
def _(t):
    lines = t.requisition_line.select(F.col("requisition_id").alias("request_id"), F.col("vendor_id").alias("supplier_id"),
                                      F.col("id").alias("line_id"), "product_id", "part_type", F.col("qty").alias("product_qty"))
    suppliers = t.requisition_line.filter("vendor_2 IS NOT NULL").select(
        F.col("requisition_id").alias("request_id"), F.col("vendor_2").alias("supplier_id"))
    return op.quotation_split(lines, suppliers)


_HELD = "SUM(CASE WHEN dest_usage = 'internal' THEN qty ELSE 0 END) - SUM(CASE WHEN src_usage = 'internal' THEN qty ELSE 0 END)"
_STOCK = dict(
    lots=f"SELECT lot_id, {_HELD} AS lot_qty FROM stock_move WHERE state = 'done' AND lot_id IS NOT NULL GROUP BY lot_id",
    held=f"SELECT product_id, {_HELD} AS q FROM stock_move WHERE state = 'done' GROUP BY product_id",
    stocked="""SELECT l.*, COALESCE(CASE WHEN line_type = 'purchase' AND l.lot_id IS NOT NULL THEN lot_qty ELSE q END, 0) AS stock_qty
      FROM requisition_line l LEFT JOIN lots ON lots.lot_id = l.lot_id LEFT JOIN held ON held.product_id = l.product_id""")


def _line_stock(t):
    return op.line_stock(t.requisition_line, op.lot_quantities(t.stock_move), inventory.stock_value(t.stock_move, t.product))


@FAMILY.query("e8_requisition_status", sql("requisition_line stock_move", """
    SELECT requisition_id, CASE WHEN bought > 0 THEN CASE WHEN short = 0 THEN 'approve' ELSE 'partial' END END AS approval_state,
      CASE WHEN closed THEN 'closed' ELSE 'partially_closed' END AS closing_state, has_non_stock_line, state,
      (state = 'approve' AND internal) OR (state = 'rfq' AND (purchase OR NOT internal)) OR state = 'purchase' AS is_locked
    FROM (SELECT requisition_id, COUNT(*) FILTER (line_type = 'purchase' AND line_status <> 'cancelled') AS bought,
        COUNT(*) FILTER (line_type = 'purchase' AND line_status <> 'cancelled' AND stock_qty <= 0) AS short,
        BOOL_AND(line_status IN ('cancelled', 'picked')) AS closed, BOOL_OR(stock_qty <= 0) AS has_non_stock_line,
        BOOL_AND(line_type = 'internal') AS internal, BOOL_AND(line_type = 'purchase') AS purchase,
        CASE requisition_id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'rfq' WHEN 2 THEN 'purchase' ELSE 'draft' END AS state
      FROM stocked GROUP BY requisition_id)""", **_STOCK))
def _(t):
    states = t.requisition.selectExpr("id AS requisition_id", "CASE id % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'rfq' WHEN 2 THEN 'purchase' ELSE 'draft' END AS state")
    return op.requisition_status(_line_stock(t), states)


@FAMILY.query("e9_line_stock", sql("requisition_line stock_move", "SELECT id AS line_id, CAST(stock_qty AS DOUBLE) AS stock_qty, stock_qty > 0 AS is_stock FROM stocked", **_STOCK))
def _(t):
    return _line_stock(t).select(F.col("id").alias("line_id"), "stock_qty", "is_stock")


@FAMILY.query("e10_lot_violations", sql("requisition_line stock_move", """
    SELECT 'lot_missing' AS rule, CAST(id AS STRING) AS key, CAST(requisition_id AS STRING) AS detail FROM requisition_line WHERE line_type = 'purchase' AND lot_id IS NULL
    UNION ALL SELECT 'lot_exceeded', CAST(l.id AS STRING), CAST(l.lot_id AS STRING) FROM requisition_line l JOIN lots ON lots.lot_id = l.lot_id
    WHERE line_type = 'purchase' AND lot_qty > 0 AND l.qty > lot_qty""", lots=_STOCK["lots"]))
def _(t):
    return op.lot_violations(t.requisition_line, op.lot_quantities(t.stock_move))


@FAMILY.query("e11_first_two_orders", sql("purchase_line", """SELECT requisition_id, MAX(CASE WHEN n = 1 THEN order_name END) AS po_1, MAX(CASE WHEN n = 2 THEN order_name END) AS po_2
    FROM (SELECT requisition_id, order_name, DENSE_RANK() OVER (PARTITION BY requisition_id ORDER BY order_id) AS n FROM purchase_line) GROUP BY requisition_id"""))
def _(t):
    return op.first_two_orders(t.purchase_line)


@FAMILY.query("e12_receipt_attribution", sql("stock_move purchase_line requisition_line", """
    SELECT m.id AS move_id, m.picking_id, o.requisition_id, m.product_id, COALESCE(l.lot_id, m.lot_id) AS lot_id, 'received' AS requisition_state
    FROM stock_move m JOIN (SELECT DISTINCT order_name, requisition_id FROM purchase_line) o ON o.order_name = m.origin
    LEFT JOIN (SELECT requisition_id, product_id, ARG_MIN(lot_id, id) AS lot_id FROM requisition_line WHERE lot_id IS NOT NULL GROUP BY ALL) l
      ON l.requisition_id = o.requisition_id AND l.product_id = m.product_id WHERE picking_type = 'incoming'"""))
def _(t):
    return op.receipt_attribution(t.stock_move, t.purchase_line, t.requisition_line)


@FAMILY.query("e13_duplicate_vin", sql("vehicle", """SELECT 'vin_used_twice' AS rule, CAST(id AS STRING) AS key, vin_sn AS detail
    FROM vehicle QUALIFY COUNT(*) OVER (PARTITION BY vin_sn) > 1"""))
def _(t):
    return op.duplicates(t.vehicle, "vin_sn", "vin_used_twice")


@FAMILY.query("e13_duplicate_car_id", sql("vehicle", """SELECT 'car_used_twice' AS rule, CAST(id AS STRING) AS key, car_id AS detail
    FROM vehicle QUALIFY COUNT(*) OVER (PARTITION BY car_id) > 1"""))
def _(t):
    return op.duplicates(t.vehicle, "car_id", "car_used_twice")


@FAMILY.query("e13_duplicate_part_number", sql("purchase_line", """SELECT 'part_number_used_twice' AS rule, CAST(id AS STRING) AS key, code AS detail
    FROM (SELECT id, CAST(order_id AS STRING) || '/' || CAST(product_id AS STRING) AS code FROM purchase_line) QUALIFY COUNT(*) OVER (PARTITION BY code) > 1"""))
def _(t):
    rows = t.purchase_line.selectExpr("id", "CAST(order_id AS STRING) || '/' || CAST(product_id AS STRING) AS code")
    return op.duplicates(rows, "code", "part_number_used_twice")
