"""Requisitions, purchase planning and procurement indicators."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.filters import KPI_POINTS, kpi_point
from ledgerlake.functions.prefix import block, document_numbers, row_numbers
from ledgerlake.operators.inventory import _level
from ledgerlake.operators.ledger import MONEY, money

RATE = "decimal(18,4)"
# A product's lines and receipts are dealt out in this many parts; its issue figures are repeated for each.
PRODUCT_PARTS = 8


def parts_kpi(requisition_lines: DataFrame, requisitions: DataFrame, purchase_lines: DataFrame, moves: DataFrame,
              vehicles: DataFrame, numbered: bool = True) -> DataFrame:
    """One row per requisition line with its purchase, receipt and issue figures.

    The purchase is the newest order of the requisition for the product. Issued quantities are per
    product, so every line of a product shows the same figure. Lines are dealt out twice: by
    requisition, where they are numbered and meet their orders, and by product, where they meet receipts and issues.
    """
    bought = purchase_lines.filter(F.col("requisition_id").isNotNull() & F.col("product_id").isNotNull()).select(
        "requisition_id", "product_id", F.struct("order_id", "id").alias("_newest"), F.col("order_name").alias("po_number"), F.col("date_order").alias("po_date"),
        F.col("partner_id").alias("vendor_id"), F.col("price_unit").alias("parts_price"), F.col("product_qty").alias("ordered_quantity"))
    done = moves.filter(F.col("state") == "done")
    received = done.filter((F.col("picking_type") == "incoming") & F.col("origin").isNotNull() & F.col("product_id").isNotNull()).select(
        "product_id", F.col("origin").alias("po_number"), F.col("date").alias("_date"), F.col("qty").alias("_qty"))
    issued = done.filter(F.col("picking_type") == "outgoing").groupBy("product_id").agg(
        F.min("date").alias("issue_date"), money(F.sum("qty")).alias("_issued"))
    # The vehicle meets the requisition, of which there are fewer than lines, and narrower ones.
    head = requisitions.select(F.col("id").alias("requisition_id"), "car_id", "department_id", "employee_id", "request_date").join(
        vehicles.select(F.col("id").alias("car_id"), "vin_sn"), "car_id", "left")
    lines = requisition_lines.select(F.col("id").alias("line_id"), "requisition_id", "product_id", "part_type", "line_status",
                                     F.col("qty").alias("requested_qty"))
    rows = lines.join(head, "requisition_id")
    if numbered:
        # Numbered while still narrow: every later join keeps the rows as they are.
        rows, bought = document_numbers(rows, "row_no", "request_date", "requisition_id", "line_id"), bought.repartition("requisition_id")

    # Where lines share a table with rows of another kind, their other columns are one value that those rows lack, which keeps these narrow in a sort. A numbered list
    # is wanted whole; without numbers the columns stay apart, since those that are not read are dropped then.
    def packed(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name)) if numbered else df.withColumn(name, F.lit(True))

    def unpacked(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[c for c in df.columns if c != name], f"{name}.*") if numbered else df.drop(name)

    # Orders and lines of a requisition become rows of one table; the window needs no further shuffle where the rows lie by requisition already.
    key = ["requisition_id", "product_id"]
    of_line, order = Window.partitionBy(*key), bought.columns[3:]
    both = packed(rows, "_line", *key).unionByName(packed(bought, "_order", *key), allowMissingColumns=True)
    newest = {"_order": F.max("_order")} if numbered else {c: F.max_by(c, "_newest") for c in order}
    rows = both.withColumns({c: e.over(of_line) for c, e in newest.items()}).filter(F.col("_line").isNotNull())
    rows = unpacked(unpacked(rows, "_line"), "_order").drop("_newest")

    # So do receipts and lines of a product, each dealt out while narrow. A product is cut into parts by order, so that a frequent one is not one task;
    # its issues go to each part, which a size estimate does not see, so they are joined by sorting.
    def dealt(df: DataFrame, key: Column) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PRODUCT_PARTS)).cast("int")).repartition("product_id", "_part")

    key = ["product_id", "_part", "po_number"]
    of_order = Window.partitionBy(*key)
    both = packed(dealt(rows, F.coalesce("po_number", F.col("requisition_id").cast("string"))), "_line", *key).unionByName(
        dealt(received, F.col("po_number")), allowMissingColumns=True)
    rows = both.withColumns({"received_date": F.min("_date").over(of_order), "_received": money(F.sum("_qty").over(of_order))})
    rows = unpacked(rows.filter(F.col("_line").isNotNull()).drop("_date", "_qty"), "_line")
    parts = F.explode(F.array(*[F.lit(i) for i in range(PRODUCT_PARTS)]))
    rows = rows.join(issued.withColumn("_part", parts).hint("merge"), ["product_id", "_part"], "left")
    zero = F.lit(0).cast(MONEY)
    used = F.when(F.col("_received") > 0, F.round(F.least("_issued", "_received") / F.nullif(F.col("_received"), F.lit(0)), 4)).otherwise(F.lit(0)).cast(RATE)
    return rows.select(
        *(["row_no"] if numbered else []), "requisition_id", "line_id", "car_id", "vin_sn", "department_id", "employee_id", "request_date", "part_type", "product_id",
        "requested_qty", "line_status", "po_number", "po_date", "vendor_id", "parts_price", "ordered_quantity", "received_date",
        F.coalesce("_received", zero).alias("received_qty"), F.datediff("received_date", "request_date").alias("days_to_received"),
        F.when(F.col("requested_qty") > 0, F.round(F.coalesce("_received", zero) / F.nullif(F.col("requested_qty"), F.lit(0)), 4))
        .otherwise(F.lit(0)).cast(RATE).alias("total_parts_received_percentage"),
        "issue_date", F.coalesce("_issued", zero).alias("issued_qty"), used.alias("total_parts_issued_percentage"),
        (F.coalesce("_received", zero) - F.coalesce("_issued", zero)).cast(MONEY).alias("total_parts_available"),
        used.alias("utilization_percentage"))


def kpi_selection(kpi: DataFrame, point: str) -> DataFrame:
    """Rows of one indicator."""
    return kpi.filter(kpi_point(point))


def kpi_summary(kpi: DataFrame) -> DataFrame:
    """Rows, quantities and mean rates of every indicator, in one pass."""
    measures = []
    for point in KPI_POINTS:
        hit = kpi_point(point)
        measures.append(F.struct(
            F.lit(point).alias("kpi_point"), F.count_if(hit).alias("rows"),
            money(F.sum(F.when(hit, F.col("requested_qty")))).alias("requested_qty"),
            money(F.sum(F.when(hit, F.col("received_qty")))).alias("received_qty"),
            money(F.sum(F.when(hit, F.col("issued_qty")))).alias("issued_qty")).alias(point))
    return kpi.agg(*measures).select(F.explode(F.array(*KPI_POINTS)).alias("k")).select("k.*")


def direct_issues(moves: DataFrame, products: DataFrame, vehicles: DataFrame, company: str) -> DataFrame:
    """Done deliveries without a requisition, valued at the company's standard price.

    ``products.prices`` maps a company number to its price.
    """
    issued = moves.filter((F.col("picking_type") == "outgoing") & (F.col("state") == "done") & F.col("requisition_id").isNull())
    price = F.coalesce(F.col("prices")[company], F.lit(0)).cast(MONEY)
    p = products.select(F.col("id").alias("product_id"), price.alias("unit_price"))
    v = vehicles.select(F.col("id").alias("car_id"), "vin_sn")
    issued = issued.select(F.col("id").alias("move_id"), "picking_id", F.col("date").alias("issue_date"), "car_id", "department_id", "product_id", "qty")
    rows = row_numbers(issued, "row_no", [F.col("issue_date").desc(), F.col("move_id").desc()], {"day": F.to_date("issue_date")},
                       {"time": F.col("issue_date"), "moves": block("move_id")}, descending=("day", "time", "moves"))
    return rows.join(p, "product_id").join(v, "car_id", "left").select(
        "row_no", "move_id", "picking_id", "issue_date", "car_id", "vin_sn", "department_id", "product_id",
        F.col("qty").alias("issued_qty"), "unit_price", (F.col("qty") * F.col("unit_price")).cast("decimal(20,2)").alias("total_value"))


def vehicle_stock(moves: DataFrame, requisition_lines: DataFrame, products: DataFrame, category: str = "Non Inventory") -> DataFrame:
    """Lot quantities still with a vehicle: delivered less returned, above zero."""
    returned = moves.filter(F.col("returned_move_id").isNotNull()).groupBy(F.col("returned_move_id").alias("id"), "lot_id").agg(
        F.sum("qty").alias("_returned"))
    out = moves.filter((F.col("state") == "done") & F.col("returned_move_id").isNull() & F.col("car_id").isNotNull()
                       & F.col("lot_id").isNotNull() & F.col("requisition_id").isNotNull())
    chosen = products.filter(F.col("category") == category).select(F.col("id").alias("product_id"))
    wanted = requisition_lines.select("requisition_id", "product_id", "lot_id", "employee_id")
    rows = (out.join(chosen, "product_id", "left_semi").join(wanted, ["requisition_id", "product_id", "lot_id"])
            .join(returned, ["id", "lot_id"], "left"))
    return rows.withColumn("lot_qty", F.round(F.col("qty") - F.coalesce("_returned", F.lit(0)), 6).cast("decimal(18,6)")).filter("lot_qty > 0").select(
        F.col("id").alias("move_id"), "car_id", "product_id", F.col("partner_id").alias("vendor_id"), "location", "requisition_id", "employee_id",
        "picking_id", "lot_id", "lot_qty")


def vehicle_listing(moves: DataFrame, partners: DataFrame, car_id: int | None = None) -> DataFrame:
    """Done movements of a vehicle; present by ``date_done`` (E5)."""
    rows = moves.filter((F.col("state") == "done") & (F.col("car_id") == car_id if car_id is not None else F.lit(True)))
    names = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("vendor"))
    return rows.join(names, "partner_id", "left").select(
        F.col("date").alias("date_done"), "picking_id", F.col("id").alias("move_id"), "product_id", "qty", F.coalesce("vendor", F.lit("")).alias("vendor"), "location")


def purchase_plan(lines: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    """Purchase lines of a requisition: one order per (requisition, vendor).

    ``lines.vendor_ids`` lists the vendors to ask; the price is the vendor's, else the standard price.
    """
    per_vendor = lines.filter(F.col("line_type") == "purchase").withColumn("vendor_id", F.explode(F.array_distinct("vendor_ids")))
    cost = products.select(F.col("id").alias("product_id"), F.col("standard_price").alias("_cost"))
    asked = per_vendor.join(prices.select("vendor_id", "product_id", F.nullif(F.col("price"), F.lit(0)).alias("_price")), ["vendor_id", "product_id"], "left")
    return asked.join(cost, "product_id", "left").select(
        "requisition_id", "vendor_id", F.col("id").alias("line_id"), "product_id", F.col("qty").alias("product_qty"),
        F.coalesce("_price", "_cost", F.lit(0)).cast(MONEY).alias("price_unit"))


def purchase_orders(plan: DataFrame) -> DataFrame:
    """Order heads of a purchase plan."""
    amount = (F.col("product_qty") * F.col("price_unit")).cast("decimal(20,2)")
    return plan.groupBy("requisition_id", "vendor_id").agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(amount).cast("decimal(20,2)").alias("amount"))


def missing_vendors(lines: DataFrame) -> DataFrame:
    """Purchase lines that name no vendor."""
    bad = lines.filter((F.col("line_type") == "purchase") & (F.size("vendor_ids") == 0))
    return violations(bad, "vendor_missing", "id", F.col("requisition_id").cast("string"))


def violations(rows: DataFrame, rule: str, key: str, detail: Column) -> DataFrame:
    """Rows that break a rule, as (rule, key, detail)."""
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.alias("detail"))


def quotation_split(lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Request lines per supplier.

    A line naming a supplier goes to that supplier only. Lines naming none go to every listed
    supplier that has not been served through a line of its own.
    """
    named = lines.filter(F.col("supplier_id").isNotNull())
    served = named.select("request_id", "supplier_id").distinct()
    others = suppliers.select("request_id", "supplier_id").distinct().join(served, ["request_id", "supplier_id"], "left_anti")
    open_lines = lines.filter(F.col("supplier_id").isNull()).drop("supplier_id").join(others, "request_id")
    return named.unionByName(open_lines.select(*named.columns))


def lot_quantities(moves: DataFrame) -> DataFrame:
    """Quantity on hand of each lot."""
    done = moves.filter((F.col("state") == "done") & F.col("lot_id").isNotNull())
    return done.groupBy("lot_id").agg(_level(F.lit(True), "lot_qty"))


def line_stock(lines: DataFrame, lots: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock behind a requisition line: its lot for purchase lines, else its product."""
    rows = lines.join(lots, "lot_id", "left").join(stock.select("product_id", F.col("qty_available").alias("_product_qty")), "product_id", "left")
    by_lot = (F.col("line_type") == "purchase") & F.col("lot_id").isNotNull()
    qty = F.when(by_lot, F.col("lot_qty")).otherwise(F.col("_product_qty"))
    return rows.select(*lines.columns, money(qty).alias("stock_qty")).withColumn("is_stock", F.col("stock_qty") > 0)


def requisition_status(stocked_lines: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Approval and closing state per requisition, non-stock flag, and lock.

    ``states`` (requisition_id, state) is needed for the lock rule only.
    """
    cancelled = F.coalesce(F.col("line_status") == "cancelled", F.lit(False))
    bought = (F.col("line_type") == "purchase") & ~cancelled
    finished = cancelled | F.coalesce(F.col("line_status") == "picked", F.lit(False))
    per = stocked_lines.groupBy("requisition_id").agg(
        F.count_if(bought).alias("_bought"), F.count_if(bought & ~F.col("is_stock")).alias("_short"),
        F.bool_and(finished).alias("_closed"), F.bool_or(~F.col("is_stock")).alias("has_non_stock_line"),
        F.bool_and(F.col("line_type") == "internal").alias("_internal"), F.bool_and(F.col("line_type") == "purchase").alias("_purchase"))
    out = (per.withColumn("approval_state", F.when(F.col("_bought") > 0, F.when(F.col("_short") == 0, "approve").otherwise("partial")))
           .withColumn("closing_state", F.when(F.col("_closed"), "closed").otherwise("partially_closed")))
    columns = ["requisition_id", "approval_state", "closing_state", "has_non_stock_line"]
    if states is not None:
        mixed = ~F.col("_internal") & ~F.col("_purchase")
        out = out.join(states, "requisition_id")
        out = out.withColumn("is_locked", ((F.col("state") == "approve") & F.col("_internal"))
                             | ((F.col("state") == "rfq") & (F.col("_purchase") | mixed)) | (F.col("state") == "purchase"))
        columns += ["state", "is_locked"]
    return out.select(*columns)


def lot_violations(lines: DataFrame, lots: DataFrame) -> DataFrame:
    """Purchase lines without a lot, or asking for more than a stocked lot holds."""
    bought = lines.filter(F.col("line_type") == "purchase")
    missing = violations(bought.filter(F.col("lot_id").isNull()), "lot_missing", "id", F.col("requisition_id").cast("string"))
    over = bought.join(lots, "lot_id").filter((F.col("lot_qty") > 0) & (F.col("qty") > F.col("lot_qty")))
    return missing.unionByName(violations(over, "lot_exceeded", "id", F.col("lot_id").cast("string")))


def first_two_orders(purchase_lines: DataFrame) -> DataFrame:
    """The two oldest purchase orders of a requisition side by side."""
    orders = purchase_lines.groupBy("requisition_id", "order_id").agg(F.min("order_name").alias("order_name"))
    n = F.row_number().over(Window.partitionBy("requisition_id").orderBy("order_id"))
    top = orders.withColumn("_n", n).filter(F.col("_n") <= 2)
    return top.groupBy("requisition_id").agg(*[F.max(F.when(F.col("_n") == i, F.col("order_name"))).alias(f"po_{i}") for i in (1, 2)])


def receipt_attribution(moves: DataFrame, purchase_lines: DataFrame, requisition_lines: DataFrame) -> DataFrame:
    """Incoming moves traced to their requisition through the order name, with the lot to use."""
    orders = purchase_lines.filter(F.col("requisition_id").isNotNull()).groupBy(F.col("order_name").alias("origin")).agg(
        F.max_by("requisition_id", "order_id").alias("_requisition"))
    lots = requisition_lines.filter(F.col("lot_id").isNotNull()).groupBy(F.col("requisition_id").alias("_requisition"), "product_id").agg(
        F.min_by("lot_id", "id").alias("_lot"))
    rows = moves.filter(F.col("picking_type") == "incoming").join(orders, "origin").join(lots, ["_requisition", "product_id"], "left")
    return rows.select(F.col("id").alias("move_id"), "picking_id", F.col("_requisition").alias("requisition_id"), "product_id",
                       F.coalesce("_lot", "lot_id").alias("lot_id"), F.lit("received").alias("requisition_state"))


def duplicates(rows: DataFrame, key: str, rule: str, record: str = "id") -> DataFrame:
    """Records that share a non-empty key with another record."""
    filled = rows.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    twice = filled.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return violations(filled.join(twice, key, "left_semi"), rule, record, F.col(key))
