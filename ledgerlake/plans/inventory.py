"""Stock queries over the derived tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlake.functions.filters import ProductFilter
from ledgerlake.functions.labels import product_label
from ledgerlake.operators import inventory as op
from ledgerlake.plans.base import ASOF, END, START, Family
from ledgerlake.plans.oracle import ratio, sql

FAMILY = Family()
S, E = f"DATE '{START}'", f"DATE '{END}'"
HORIZON = 60
LABEL = "CASE WHEN p.code IS NOT NULL THEN p.code || ' - ' || p.name ELSE p.name END AS product_label"


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


def level(cond: str) -> str:
    return (f"SUM(CASE WHEN {cond} AND dest_usage = 'internal' THEN qty ELSE 0 END) - "
            f"SUM(CASE WHEN {cond} AND src_usage = 'internal' THEN qty ELSE 0 END)")


def fsn_class(sales: str, num: str, den: str) -> str:
    r = f"(CASE WHEN {sales} > 0 THEN CASE WHEN {den} <> 0 THEN {ratio(num, 'NULLIF(' + den + ', 0)')} END ELSE 0 END)"
    return f"CASE WHEN {r} > 3 THEN 'Fast Moving' WHEN {r} >= 1 AND {r} <= 3 THEN 'Slow Moving' ELSE 'Non Moving' END"


_FSN_SUMS = f"""{level(f"m.date <= {S}")} AS opening_stock, {level(f"m.date <= {E}")} AS closing_stock,
    SUM(CASE WHEN m.date BETWEEN {S} AND {E} AND dest_usage = 'customer' THEN qty ELSE 0 END) AS sales"""
_DEN = "(opening_stock + closing_stock)"
_FSN_COLS = f"""{dbl("opening_stock", "closing_stock", "sales")}, CAST({_DEN} AS DOUBLE) / 2 AS average_stock,
    CASE WHEN sales > 0 THEN CASE WHEN {_DEN} <> 0 THEN {ratio("sales * 2", f"NULLIF({_DEN}, 0)")} END ELSE 0 END AS turnover_ratio,
    {fsn_class("sales", "sales * 2", _DEN)} AS fsn_classification"""
_FSN = f"""SELECT product_id, product_label, category, b.company_id, w.id AS warehouse_id, {_FSN_COLS}
    FROM base b JOIN warehouse w ON w.company_id = b.company_id"""
_FSN_BASE = f"""SELECT m.product_id, {LABEL}, p.category, m.company_id, {_FSN_SUMS} FROM stock_move m JOIN product p ON p.id = m.product_id
    WHERE m.state = 'done' GROUP BY ALL"""


@FAMILY.query("d1_fsn", sql("stock_move product warehouse", _FSN, base=_FSN_BASE))
def _(t):
    return op.fsn(t.stock_move, t.product, t.warehouse, START, END)


@FAMILY.query("f5_fsn_class_filter", sql("stock_move product warehouse", f"""SELECT * FROM ({_FSN}) WHERE fsn_classification = 'Slow Moving'""", base=_FSN_BASE))
def _(t):
    return op.fsn(t.stock_move, t.product, t.warehouse, START, END, keep="Slow Moving")


@FAMILY.query("f2_product_filter", sql("stock_move product warehouse", f"""SELECT * FROM ({_FSN})
    WHERE (product_id IN (3, 5, 8) OR category = 'PROMO') AND company_id IN (1, 2, 3) AND warehouse_id IN (0, 1, 5, 7)""", base=_FSN_BASE))
def _(t):
    return op.fsn(t.stock_move, t.product, t.warehouse, START, END,
                  ProductFilter(product_ids=(3, 5, 8), categories=("PROMO",), company_ids=(1, 2, 3), warehouse_ids=(0, 1, 5, 7)))


@FAMILY.query("d1_fsn_without_warehouses", sql("stock_move product", f"""SELECT product_id, product_label, category, company_id, CAST(NULL AS BIGINT) AS warehouse_id, {_FSN_COLS}
    FROM base""", base=_FSN_BASE))
def _(t):
    return op.fsn(t.stock_move, t.product, None, START, END)


_XYZ_CLASS = "CASE WHEN cumulative_percentage < 70 THEN 'X' WHEN cumulative_percentage <= 90 THEN 'Y' ELSE 'Z' END"


@FAMILY.query("d2_xyz", sql("valuation product", f"""SELECT product_id, company_id, product_label, category, {dbl("current_stock", "stock_value", "stock_percentage")},
    CAST(cumulative_percentage AS DOUBLE) AS cumulative_percentage, {_XYZ_CLASS} AS xyz_classification
    FROM (SELECT *, SUM(stock_percentage) OVER (ORDER BY stock_value DESC, product_id, company_id ROWS UNBOUNDED PRECEDING) AS cumulative_percentage FROM shares)""",
    base=f"""SELECT v.product_id, v.company_id, {LABEL}, p.category, SUM(remaining_qty) AS current_stock, SUM(remaining_value) AS stock_value
      FROM valuation v JOIN product p ON p.id = v.product_id WHERE p.active AND p.type = 'product' GROUP BY ALL""",
    shares=f"""SELECT *, CAST(CASE WHEN stock_value <> 0 THEN {ratio("stock_value", "(SELECT SUM(stock_value) FROM base)", 2, 100)} ELSE 0 END AS DECIMAL(18,2)) AS stock_percentage FROM base"""))
def _(t):
    return op.xyz(t.valuation, t.product)


_D3 = dict(
    base=f"""SELECT m.product_id, m.company_id, {LABEL}, p.category, SUM(remaining_qty) AS current_stock, SUM(remaining_value) AS stock_value, {_FSN_SUMS}
      FROM stock_move m JOIN product p ON p.id = m.product_id JOIN valuation v ON v.stock_move_id = m.id
      WHERE m.state = 'done' AND p.active AND p.type = 'product' GROUP BY ALL""",
    placed="SELECT b.*, w.id AS warehouse_id FROM base b JOIN warehouse w ON w.company_id = b.company_id",
    shares=f"""SELECT *, CAST(CASE WHEN stock_value <> 0 THEN {ratio("stock_value", "(SELECT SUM(stock_value) FROM placed)", 2, 100)} ELSE 0 END AS DECIMAL(18,2)) AS stock_percentage FROM placed""",
    cumulated="SELECT *, SUM(stock_percentage) OVER (ORDER BY stock_value DESC) AS cumulative_percentage FROM shares",
    classed=f"""SELECT product_id, product_label, category, company_id, warehouse_id, {dbl("current_stock", "stock_value", "stock_percentage", "cumulative_percentage")},
      {_FSN_COLS}, {_XYZ_CLASS} AS xyz_classification FROM cumulated""")


@FAMILY.query("d3_fsn_xyz", sql("stock_move product warehouse valuation",
              "SELECT *, SUBSTRING(fsn_classification, 1, 1) || xyz_classification AS combined_classification FROM classed", **_D3))
def _(t):
    return op.fsn_xyz(t.stock_move, t.valuation, t.product, t.warehouse, START, END)


@FAMILY.query("f5_combined_class_filter", sql("stock_move product warehouse valuation", """SELECT *, SUBSTRING(fsn_classification, 1, 1) || xyz_classification
    AS combined_classification FROM classed WHERE fsn_classification = 'Non Moving' AND xyz_classification = 'X'""", **_D3))
def _(t):
    return op.fsn_xyz(t.stock_move, t.valuation, t.product, t.warehouse, START, END, keep_fsn="Non Moving", keep_xyz="X")


@FAMILY.query("d4_stock_ageing", sql("stock_move product valuation", f"""
    SELECT product_id, product_label, category, company_id, {dbl("qty_available", "prev_qty_available")}, receipt_date,
      date_diff('day', receipt_date, DATE '{ASOF}') AS days_since_receipt, {dbl("current_value", "prev_value")},
      CASE WHEN qty_available <> 0 THEN {ratio("qty_available", "(SELECT SUM(qty_available) FROM priced)", 2, 100)} ELSE 0 END AS stock_percentage,
      CASE WHEN current_value <> 0 THEN {ratio("current_value", "(SELECT SUM(current_value) FROM priced)", 2, 100)} ELSE 0 END AS stock_value_percentage
    FROM priced""",
    base=f"""SELECT m.product_id, {LABEL}, p.category, m.company_id, p.standard_price, COALESCE(SUM(v.remaining_qty), 0) AS qty_available
      FROM stock_move m JOIN product p ON p.id = m.product_id JOIN valuation v ON v.stock_move_id = m.id WHERE p.type = 'product' AND m.state = 'done' GROUP BY ALL""",
    firsts="SELECT product_id, company_id, MIN(date) AS receipt_date, MAX(date) AS last_date FROM stock_move WHERE state = 'done' GROUP BY ALL",
    prevs="""SELECT m.product_id, SUM(qty) AS prev FROM stock_move m JOIN firsts f ON f.product_id = m.product_id AND f.company_id = m.company_id
      WHERE m.state = 'done' AND m.date < f.last_date GROUP BY m.product_id""",
    priced="""SELECT b.*, f.receipt_date, COALESCE(prev, qty_available) AS prev_qty_available, CAST(qty_available * standard_price AS DECIMAL(18,2)) AS current_value,
      CAST(COALESCE(prev, qty_available) * standard_price AS DECIMAL(18,2)) AS prev_value
      FROM base b JOIN firsts f ON f.product_id = b.product_id AND f.company_id = b.company_id LEFT JOIN prevs x ON x.product_id = b.product_id"""))
def _(t):
    return op.stock_ageing(t.stock_move, t.valuation, t.product, ASOF)


def _age_sql(days: int, column: str, name: str) -> str:
    age = f"date_diff('day', m.date, DATE '{ASOF}')"
    conds = [f"{age} BETWEEN {k * days + 1} AND {(k + 1) * days}" for k in range(4)] + [f"{age} >= {4 * days + 1}"]
    return ", ".join(f"CAST(SUM(CASE WHEN {c} THEN {column} ELSE 0 END) AS DOUBLE) AS {name}_{k}" for k, c in enumerate(conds, 1))


@FAMILY.query("d5_age_breakdown", sql("stock_move product valuation", f"""SELECT m.product_id, {LABEL}, p.category, m.company_id,
    CAST(SUM(remaining_qty) AS DOUBLE) AS qty_available, CAST(SUM(remaining_value) AS DOUBLE) AS stock_value,
    {_age_sql(180, "remaining_qty", "age_qty")}, {_age_sql(180, "remaining_value", "age_value")}
    FROM stock_move m JOIN product p ON p.id = m.product_id JOIN valuation v ON v.stock_move_id = m.id
    WHERE p.type = 'product' AND m.state = 'done' GROUP BY ALL"""))
def _(t):
    return op.age_breakdown(t.stock_move, t.valuation, t.product, ASOF, 180)


def _moved(cond: str) -> str:
    return ", ".join(f"CAST(SUM(CASE WHEN {cond} AND {'dest' if d == 'to' else 'src'}_usage = '{u}' THEN qty ELSE 0 END) AS DOUBLE) AS {n}"
                     for n, (d, u) in op.MOVEMENTS.items())


@FAMILY.query("d6_stock_movement", sql("stock_move product", f"""SELECT m.product_id, m.company_id, {LABEL}, p.category,
    CAST({level(f"m.date <= {S}")} AS DOUBLE) AS opening_stock, CAST({level(f"m.date <= {E}")} AS DOUBLE) AS closing_stock,
    {_moved(f"m.date BETWEEN {S} AND {E}")} FROM stock_move m JOIN product p ON p.id = m.product_id WHERE m.state = 'done' GROUP BY ALL"""))
def _(t):
    return op.stock_movement(t.stock_move, t.product, START, END)


@FAMILY.query("d6_stock_movement_up_to", sql("stock_move product warehouse", f"""SELECT m.product_id, m.company_id, {LABEL}, p.category,
    CAST(SUM(CASE WHEN m.date <= {E} AND dest_usage = 'inventory' THEN qty ELSE 0 END) AS DOUBLE) AS opening_stock,
    CAST({level(f"m.date <= {E}")} AS DOUBLE) AS closing_stock, {_moved(f"m.date <= {E}")}
    FROM stock_move m JOIN product p ON p.id = m.product_id
    WHERE m.state = 'done' AND m.company_id IN (SELECT company_id FROM warehouse WHERE id IN (1, 2, 7)) GROUP BY ALL"""))
def _(t):
    return op.stock_movement(t.stock_move, t.product, None, END, t.warehouse, ProductFilter(warehouse_ids=(1, 2, 7)))


_DAYS = (END - START).days + 1
_PLANNED = "m.state IN ('assigned', 'confirmed', 'waiting')"
_ADS = ratio("out_qty", f"CAST({_DAYS} AS DECIMAL(18,2))")
_POSITION = dict(
    base=f"""SELECT m.product_id, {LABEL}, p.category, m.company_id, p.standard_price, {level("m.state = 'done'")} AS current_stock,
      SUM(CASE WHEN dest_usage = 'internal' AND {_PLANNED} THEN qty ELSE 0 END) AS incoming_quantity,
      SUM(CASE WHEN src_usage = 'internal' AND {_PLANNED} THEN qty ELSE 0 END) AS outgoing_quantity,
      SUM(CASE WHEN m.date BETWEEN {S} AND {E} AND dest_usage = 'customer' THEN qty ELSE 0 END) AS sales,
      SUM(CASE WHEN m.date BETWEEN {S} AND {E} AND src_usage = 'internal' AND m.state = 'done' THEN qty ELSE 0 END) AS out_qty
      FROM stock_move m JOIN product p ON p.id = m.product_id WHERE p.active AND p.type = 'product' GROUP BY ALL""",
    placed=f"""SELECT b.*, w.id AS warehouse_id, current_stock + incoming_quantity - outgoing_quantity AS virtual_stock, CAST({_ADS} AS DECIMAL(18,2)) AS ads
      FROM base b JOIN warehouse w ON w.company_id = b.company_id""")
_COVER0 = f"CASE WHEN ads = 0 THEN CAST(ROUND(virtual_stock * 1000, 0) AS DOUBLE) ELSE {ratio('virtual_stock', 'NULLIF(ads, 0)', 0)} END"
_COVER2 = f"CASE WHEN ads = 0 THEN CAST(virtual_stock * 1000 AS DECIMAL(24,2)) ELSE CAST({ratio('virtual_stock', 'NULLIF(ads, 0)', 2)} AS DECIMAL(24,2)) END"
_POS_COLS = f"""product_id, product_label, category, company_id, warehouse_id, {dbl("current_stock", "incoming_quantity", "outgoing_quantity", "virtual_stock", "sales", "ads")},
    CAST(ROUND(ads * {HORIZON}, 0) AS DOUBLE) AS demanded_quantity, {_COVER0} AS in_stock_days,
    CASE WHEN virtual_stock = 0 THEN 0 ELSE {ratio("sales", "NULLIF(virtual_stock, 0)")} END AS turnover_ratio,
    {fsn_class("sales", "sales", "virtual_stock")} AS fsn_classification"""


_LATEST_PO = f"""SELECT * FROM (SELECT product_id, date_approve AS po_date, CAST(product_qty AS DOUBLE) AS po_qty, CAST(price_total AS DOUBLE) AS po_price_total, partner_id AS po_partner_id
    FROM purchase_line WHERE state = 'purchase' QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY date_approve DESC, id) = 1)"""
_PO_START = date(2001, 1, 1)


@FAMILY.query("d7_over_stock", sql("stock_move product warehouse purchase_line", f"""SELECT {_POS_COLS.replace("product_id,", "q.product_id,", 1)}, CAST(over_stock_qty AS DOUBLE) AS over_stock_qty,
    CASE WHEN over_stock_qty <> 0 THEN {ratio("over_stock_qty", "(SELECT SUM(over_stock_qty) FROM firsts)", 2, 100)} ELSE 0 END AS over_stock_qty_percentage,
    CAST(standard_price AS DOUBLE) AS cost, CAST(over_stock_value AS DOUBLE) AS over_stock_value,
    CASE WHEN over_stock_value <> 0 THEN {ratio("over_stock_value", "(SELECT SUM(over_stock_value) FROM firsts)", 2, 100)} ELSE 0 END AS over_stock_value_percentage,
    po_date, po_qty, po_price_total, po_partner_id FROM firsts q LEFT JOIN po ON po.product_id = q.product_id""", **_POSITION,
    firsts=f"""SELECT *, ROUND(virtual_stock - ads * {HORIZON}, 0) AS over_stock_qty, CAST(ROUND(virtual_stock - ads * {HORIZON}, 0) * standard_price AS DECIMAL(20,2)) AS over_stock_value
      FROM placed QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY company_id, warehouse_id) = 1""",
    po=f"SELECT * FROM ({_LATEST_PO}) WHERE po_date BETWEEN {S} AND {E}"))
def _(t):
    return op.over_stock(t.stock_move, t.product, t.warehouse, t.purchase_line, START, END, HORIZON)


@FAMILY.query("d8_out_of_stock", sql("stock_move product warehouse", f"""SELECT {_POS_COLS}, CAST(ROUND(missing, 0) AS DOUBLE) AS out_of_stock_days,
    CAST(ROUND(missing, 2) AS DOUBLE) AS out_of_stock_ratio, CAST(out_of_stock_qty AS DOUBLE) AS out_of_stock_qty,
    CASE WHEN out_of_stock_qty <> 0 THEN {ratio("out_of_stock_qty", "(SELECT SUM(out_of_stock_qty) FROM short)", 2, 100)} ELSE 0 END AS out_of_stock_qty_percentage,
    CAST(standard_price AS DOUBLE) AS cost, CAST(out_of_stock_qty * standard_price AS DOUBLE) AS out_of_stock_value FROM short""", **_POSITION,
    missed=f"SELECT *, GREATEST(CAST({HORIZON} AS DECIMAL(24,2)) - ({_COVER2}), CAST(0 AS DECIMAL(24,2))) AS missing FROM placed",
    short="SELECT *, ROUND(missing * ads, 0) AS out_of_stock_qty FROM missed"))
def _(t):
    return op.out_of_stock(t.stock_move, t.product, t.warehouse, START, END, HORIZON)


@FAMILY.query("d9_latest_purchase", sql("purchase_line", f"SELECT * FROM ({_LATEST_PO}) WHERE po_date BETWEEN DATE '{_PO_START}' AND DATE '{ASOF}'"))
def _(t):
    return op.latest_purchase(t.purchase_line, _PO_START, ASOF)


_VALUE = f"""SELECT p.id AS product_id, {LABEL}, p.category, COALESCE(q, 0) AS qty_available, p.standard_price * COALESCE(q, 0) AS stock_value
    FROM product p LEFT JOIN (SELECT product_id, {level("TRUE")} AS q FROM stock_move WHERE state = 'done' GROUP BY product_id) m ON m.product_id = p.id"""


@FAMILY.query("d10_stock_value", sql("stock_move product", f"SELECT product_id, product_label, category, {dbl('qty_available', 'stock_value')} FROM ({_VALUE})"))
def _(t):
    return op.stock_value(t.stock_move, t.product)


@FAMILY.query("d10_stock_value_by_category", sql("stock_move product", f"SELECT category, CAST(SUM(stock_value) AS DOUBLE) AS stock_value FROM ({_VALUE}) GROUP BY category"))
def _(t):
    return op.stock_value(t.stock_move, t.product).groupBy("category").agg(F.sum("stock_value").alias("stock_value"))


@FAMILY.query("d11_oe_numbers", sql("sale", """SELECT product_id, STRING_AGG(oe, ', ' ORDER BY oe) AS names
    FROM (SELECT DISTINCT partkey AS product_id, 'OE' || CAST(suppkey AS STRING) AS oe FROM sale) GROUP BY product_id"""))
def _(t):
    links = t.sale.selectExpr("partkey AS product_id", "'OE' || CAST(suppkey AS STRING) AS oe")
    return op.joined_names(links, "product_id", "oe")


@FAMILY.query("p1_product_label", sql("product", f"SELECT p.id AS product_id, {LABEL} FROM product p"))
def _(t):
    return t.product.select(F.col("id").alias("product_id"), product_label().alias("product_label"))
