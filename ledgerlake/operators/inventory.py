"""Stock analyses over moves and valuation layers.

Move tables carry: id, product_id, company_id, src_usage, dest_usage, qty, date, state. Conditional
sums run per (product, company) before any dimension is joined, so only aggregated rows meet the
product and warehouse tables. Warehouses are attached by company, which repeats a row for every
warehouse of its company; ``warehouses=None`` leaves that out.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.filters import ProductFilter
from ledgerlake.functions.labels import product_label
from ledgerlake.functions.prefix import row_numbers, scan_totals, used
from ledgerlake.operators.ledger import MONEY, money

ALL_PRODUCTS = ProductFilter()
# Move states that announce future stock.
PLANNED = ["assigned", "confirmed", "waiting"]


def _part(cond: Column, value: str = "qty") -> Column:
    return F.when(cond, F.col(value))


def _q(cond: Column, name: str, value: str = "qty") -> Column:
    return money(F.sum(_part(cond, value))).alias(name)


def _into(usage: str) -> Column:
    return F.coalesce(F.col("dest_usage") == usage, F.lit(False))


def _from(usage: str) -> Column:
    return F.coalesce(F.col("src_usage") == usage, F.lit(False))


def _net(cond: Column) -> Column:
    signed = F.when(_into("internal"), F.col("qty")).otherwise(F.lit(0)) - F.when(_from("internal"), F.col("qty")).otherwise(F.lit(0))
    return F.when(cond, signed)


def _level(cond: Column, name: str) -> Column:
    """Net stock of internal locations."""
    return money(F.sum(_net(cond))).alias(name)


def _percent(part: Column, whole: Column) -> Column:
    return F.when((whole != 0) & (part != 0), F.round(part * 100 / whole, 2)).otherwise(F.lit(0)).cast(MONEY)


def _labelled(df: DataFrame, products: DataFrame, only_stocked: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    p = products.filter((F.col("type") == "product") & F.col("active")) if only_stocked else products
    dims = p.select(F.col("id").alias("product_id"), product_label().alias("product_label"), "category", *extra)
    return df.join(dims, "product_id")


def _with_warehouses(df: DataFrame, warehouses: DataFrame | None, where: ProductFilter) -> DataFrame:
    if warehouses is None:
        return df.withColumn("warehouse_id", F.lit(None).cast("long"))
    w = warehouses.select(F.col("id").alias("warehouse_id"), "company_id")
    if where.warehouse_ids:
        w = w.filter(F.col("warehouse_id").isin(list(where.warehouse_ids)))
    return df.join(w, "company_id")


def turnover_class(turnover: Column) -> Column:
    """Fast above 3, slow from 1 to 3, otherwise (or unknown) non-moving."""
    return F.when(turnover > 3, "Fast Moving").when((turnover >= 1) & (turnover <= 3), "Slow Moving").otherwise("Non Moving")


def share_class(cumulative: Column) -> Column:
    return F.when(cumulative < 70, "X").when(cumulative <= 90, "Y").otherwise("Z")


def _fsn_parts(start: date, end: date) -> dict[str, Column]:
    """What a move adds to each figure."""
    return {"opening_stock": _net(F.col("date") <= F.lit(start)), "closing_stock": _net(F.col("date") <= F.lit(end)),
            "sales": _part(F.col("date").between(F.lit(start), F.lit(end)) & _into("customer"))}


def _fsn_measures(start: date, end: date) -> list[Column]:
    return [money(F.sum(part)).alias(name) for name, part in _fsn_parts(start, end).items()]


def _fsn(df: DataFrame) -> DataFrame:
    average = ((F.col("opening_stock") + F.col("closing_stock")) / 2).cast("decimal(18,3)")
    ratio = F.when(F.col("sales") > 0, F.round(F.col("sales") / F.nullif(F.col("average_stock"), F.lit(0)), 2)).otherwise(F.lit(0))
    return (df.withColumn("average_stock", average).withColumn("turnover_ratio", ratio.cast(MONEY))
            .withColumn("fsn_classification", turnover_class(F.col("turnover_ratio"))))


def fsn(moves: DataFrame, products: DataFrame, warehouses: DataFrame | None, start: date, end: date,
        where: ProductFilter = ALL_PRODUCTS, keep: str | None = None) -> DataFrame:
    """Fast, slow and non-moving products by stock turnover."""
    sums = moves.filter((F.col("state") == "done") & (F.col("date").isNotNull())).groupBy("product_id", "company_id").agg(*_fsn_measures(start, end))
    out = _fsn(_labelled(sums, products, False)).filter(where.predicate())
    out = _with_warehouses(out, warehouses, where).select(
        "product_id", "product_label", "category", "company_id", "warehouse_id", "opening_stock", "closing_stock", "sales",
        "average_stock", "turnover_ratio", "fsn_classification")
    return out.filter(F.col("fsn_classification") == keep) if keep else out


def _with_share(rows: DataFrame) -> DataFrame:
    """Adds each row's share of all stock value, rounded."""
    total = rows.agg(F.struct(F.sum("stock_value").alias("value"), used(rows))).scalar()["value"]
    return rows.withColumn("stock_percentage", _percent(F.col("stock_value"), F.coalesce(total, F.lit(0))))


def xyz(layers: DataFrame, products: DataFrame, where: ProductFilter = ALL_PRODUCTS, keep: str | None = None) -> DataFrame:
    """Products by share of stock value, largest first, with rounded shares added up.

    Equal values follow the product and company numbers.
    """
    sums = layers.filter(F.col("remaining_value").isNotNull()).groupBy("product_id", "company_id").agg(
        money(F.sum("remaining_qty")).alias("current_stock"), money(F.sum("remaining_value")).alias("stock_value"))
    rows = _labelled(sums, products, True).filter(where.predicate())
    rows = _with_share(rows)
    out = scan_totals(rows, {"v": -F.col("stock_value"), "p": F.col("product_id"), "c": F.col("company_id")}, F.col("stock_percentage"), "cumulative_percentage")
    out = out.withColumn("cumulative_percentage", F.col("cumulative_percentage").cast(MONEY)).withColumn(
        "xyz_classification", share_class(F.col("cumulative_percentage")))
    return out.filter(F.col("xyz_classification") == keep) if keep else out


def fsn_xyz(moves: DataFrame, layers: DataFrame, products: DataFrame, warehouses: DataFrame | None, start: date, end: date,
            where: ProductFilter = ALL_PRODUCTS, keep_fsn: str | None = None, keep_xyz: str | None = None) -> DataFrame:
    """Turnover class and value class combined (D3); equal values share one cumulative figure."""
    valued = layers.filter(F.col("remaining_value").isNotNull()).select(F.col("stock_move_id").alias("id"), "remaining_qty", "remaining_value")
    # Moves meet their layers with what they add to the figures: narrower than their places and dates.
    parts = _fsn_parts(start, end)
    done = moves.filter(F.col("state") == "done").select("id", "product_id", "company_id", *[c.cast(MONEY).alias(n) for n, c in parts.items()])
    sums = done.join(valued, "id").groupBy("product_id", "company_id").agg(
        money(F.sum("remaining_qty")).alias("current_stock"), money(F.sum("remaining_value")).alias("stock_value"), *[money(F.sum(n)).alias(n) for n in parts])
    rows = _with_warehouses(_fsn(_labelled(sums, products, True)).filter(where.predicate()), warehouses, where)
    rows = _with_share(rows)
    per_value = rows.groupBy("stock_value").agg(F.sum("stock_percentage").alias("_p"), used(rows))
    upto = scan_totals(per_value, {"v": -F.col("stock_value")}, F.col("_p"), "cumulative_percentage").filter(F.col("_used").isNotNull())
    out = rows.join(upto.select("stock_value", F.col("cumulative_percentage").cast(MONEY).alias("cumulative_percentage")), "stock_value")
    out = out.withColumn("xyz_classification", share_class(F.col("cumulative_percentage")))
    out = out.withColumn("combined_classification", F.concat(F.substring("fsn_classification", 1, 1), F.col("xyz_classification"))).select(
        "product_id", "product_label", "category", "company_id", "warehouse_id", "current_stock", "stock_value", "stock_percentage",
        "cumulative_percentage", "opening_stock", "closing_stock", "sales", "average_stock", "turnover_ratio",
        "fsn_classification", "xyz_classification", "combined_classification")
    return classified(out, keep_fsn, keep_xyz)


def classified(df: DataFrame, keep_fsn: str | None = None, keep_xyz: str | None = None) -> DataFrame:
    """Rows of one class, or of one combination."""
    if keep_fsn:
        df = df.filter(F.col("fsn_classification") == keep_fsn)
    if keep_xyz:
        df = df.filter(F.col("xyz_classification") == keep_xyz)
    return df


def stock_ageing(moves: DataFrame, layers: DataFrame, products: DataFrame, asof: date, where: ProductFilter = ALL_PRODUCTS) -> DataFrame:
    """Stock on hand with first receipt, stock before the last movement day, and shares."""
    done = moves.filter(F.col("state") == "done")
    # Layers are added up per move first, so that a move stays one row and is read once for its dates and its stock.
    left = layers.groupBy(F.col("stock_move_id").alias("id")).agg(F.sum("remaining_qty").alias("_left"), F.lit(True).alias("_held"))
    stock = done.select("id", "product_id", "company_id", "date", "qty").join(left, "id", "left").drop("id")
    # One exchange for days and products: sums by day hold too many groups to be worth one of their own.
    per_day = stock.repartition("product_id", "company_id").groupBy("product_id", "company_id", "date").agg(
        money(F.sum("qty")).alias("_q"), F.sum("_left").alias("_left"), F.max("_held").alias("_held"))
    per_company = per_day.groupBy("product_id", "company_id").agg(
        F.min("date").alias("receipt_date"),
        F.when(F.count(F.lit(1)) > 1, F.sum("_q") - F.max_by("_q", "date")).alias("_before"),
        money(F.sum("_left")).alias("qty_available"), F.max("_held").alias("_held"))
    # A window over the companies of a product; it counts those that hold nothing as well.
    before = per_company.withColumn("_prev", F.sum("_before").over(Window.partitionBy("product_id")).cast(MONEY))
    held = before.filter(F.col("_held") & F.col("company_id").isNotNull()).drop("_held", "_before")
    p = products.filter(F.col("type") == "product")
    rows = _labelled(held, p, False, ("standard_price",)).filter(where.predicate())
    price = F.coalesce("standard_price", F.lit(0))
    rows = (rows.withColumn("prev_qty_available", F.coalesce("_prev", "qty_available"))
            .withColumn("days_since_receipt", F.datediff(F.lit(asof), "receipt_date"))
            .withColumn("current_value", (F.col("qty_available") * price).cast(MONEY))
            .withColumn("prev_value", (F.col("prev_qty_available") * price).cast(MONEY)))
    rows = rows.drop("_prev", "standard_price")
    totals = rows.agg(F.struct(F.sum("qty_available").alias("q"), F.sum("current_value").alias("v"), used(rows))).scalar()
    return rows.select(
        "product_id", "product_label", "category", "company_id", "qty_available", "prev_qty_available", "receipt_date",
        "days_since_receipt", "current_value", "prev_value",
        _percent(F.col("qty_available"), F.coalesce(totals.getField("q"), F.lit(0))).alias("stock_percentage"),
        _percent(F.col("current_value"), F.coalesce(totals.getField("v"), F.lit(0))).alias("stock_value_percentage"))


def age_breakdown(moves: DataFrame, layers: DataFrame, products: DataFrame, asof: date, days: int = 30,
                  where: ProductFilter = ALL_PRODUCTS) -> DataFrame:
    """Remaining quantity and value in five age bands of equal length."""
    valued = layers.filter(F.col("remaining_value").isNotNull()).select(F.col("stock_move_id").alias("id"), "remaining_qty", "remaining_value")
    rows = moves.filter(F.col("state") == "done").select("id", "product_id", "company_id", "date").join(valued, "id")
    age = F.datediff(F.lit(asof), F.col("date"))
    bands = [age.between(k * days + 1, (k + 1) * days) for k in range(4)] + [age >= 4 * days + 1]
    sums = rows.groupBy("product_id", "company_id").agg(
        money(F.sum("remaining_qty")).alias("qty_available"), money(F.sum("remaining_value")).alias("stock_value"),
        *[_q(b, f"age_qty_{k}", "remaining_qty") for k, b in enumerate(bands, 1)],
        *[_q(b, f"age_value_{k}", "remaining_value") for k, b in enumerate(bands, 1)])
    return _labelled(sums, products.filter(F.col("type") == "product"), False).filter(where.predicate())


# Counted move directions of the movement report.
MOVEMENTS = {
    "sales": ("to", "customer"), "sales_return": ("from", "customer"),
    "purchase": ("from", "supplier"), "purchase_return": ("to", "supplier"),
    "internal_in": ("to", "internal"), "internal_out": ("from", "internal"),
    "adj_in": ("to", "inventory"), "adj_out": ("from", "inventory"),
    "production_in": ("to", "production"), "production_out": ("from", "production"),
    "transit_in": ("to", "transit"), "transit_out": ("from", "transit"),
}


def stock_movement(moves: DataFrame, products: DataFrame, start: date | None, end: date, warehouses: DataFrame | None = None,
                   where: ProductFilter = ALL_PRODUCTS) -> DataFrame:
    """Quantities by direction in a range, or up to ``end`` when ``start`` is None.

    In the up-to form the opening figure is what went to inventory-loss locations. Quantities are not
    multiplied by the number of warehouses; a warehouse choice only selects companies.
    """
    upto = F.col("date") <= F.lit(end)
    inside = F.col("date").between(F.lit(start), F.lit(end)) if start else upto
    opening = _level(F.col("date") <= F.lit(start), "opening_stock") if start else _q(upto & _into("inventory"), "opening_stock")
    flows = [_q(inside & (_into(u) if d == "to" else _from(u)), name) for name, (d, u) in MOVEMENTS.items()]
    done = moves.filter(F.col("state") == "done")
    if warehouses is not None and where.warehouse_ids:
        done = done.join(warehouses.filter(F.col("id").isin(list(where.warehouse_ids))).select("company_id"), "company_id", "left_semi")
    sums = done.groupBy("product_id", "company_id").agg(opening, _level(upto, "closing_stock"), *flows)
    return _labelled(sums, products, False).filter(where.predicate())


def _position(moves: DataFrame, products: DataFrame, warehouses: DataFrame | None, start: date, end: date, horizon: int,
              where: ProductFilter) -> DataFrame:
    done, planned = F.col("state") == "done", F.col("state").isin(PLANNED)
    inside = F.col("date").between(F.lit(start), F.lit(end))
    sums = moves.groupBy("product_id", "company_id").agg(
        _q(_into("internal") & planned, "incoming_quantity"), _q(_from("internal") & planned, "outgoing_quantity"),
        _level(done, "current_stock"), _q(inside & _into("customer"), "sales"), _q(inside & _from("internal") & done, "_out"))
    days = (end - start).days + 1
    rows = _labelled(sums, products, True, ("standard_price",)).filter(where.predicate())
    rows = _with_warehouses(rows, warehouses, where)
    rows = (rows.withColumn("virtual_stock", (F.col("current_stock") + F.col("incoming_quantity") - F.col("outgoing_quantity")).cast(MONEY))
            .withColumn("ads", F.round(F.col("_out") / F.lit(days), 2).cast(MONEY)).drop("_out"))
    floor_ads = F.when(F.col("ads") == 0, F.lit("0.001").cast("decimal(18,3)")).otherwise(F.col("ads").cast("decimal(18,3)"))
    turnover = F.when(F.col("virtual_stock") == 0, F.lit(0)).otherwise(
        F.round(F.col("sales") / F.nullif(F.col("virtual_stock"), F.lit(0)), 2)).cast(MONEY)
    fsn_ratio = F.when(F.col("sales") > 0, F.round(F.col("sales") / F.nullif(F.col("virtual_stock"), F.lit(0)), 2)).otherwise(F.lit(0))
    return (rows.withColumn("_ads", floor_ads)
            .withColumn("demanded_quantity", F.round(F.col("ads") * horizon, 0).cast(MONEY))
            .withColumn("in_stock_days", F.round(F.col("virtual_stock") / F.col("_ads"), 0).cast(MONEY))
            .withColumn("turnover_ratio", turnover)
            .withColumn("fsn_classification", turnover_class(fsn_ratio)))


_POSITION = ["product_id", "product_label", "category", "company_id", "warehouse_id", "current_stock", "incoming_quantity",
             "outgoing_quantity", "virtual_stock", "sales", "ads", "demanded_quantity", "in_stock_days", "turnover_ratio",
             "fsn_classification"]


def latest_purchase(purchase_lines: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Newest confirmed purchase line per product, kept only when approved in the range.

    Of several lines approved on one day the one with the smallest number counts.
    """
    best = purchase_lines.filter(F.col("state") == "purchase").groupBy("product_id").agg(
        F.max_by(F.struct("date_approve", "product_qty", "price_total", "partner_id", "order_name"),
                 F.struct(F.col("date_approve"), -F.col("id"))).alias("po"))
    out = best.select("product_id", F.col("po.date_approve").alias("po_date"), F.col("po.product_qty").alias("po_qty"),
                      F.col("po.price_total").alias("po_price_total"), F.col("po.partner_id").alias("po_partner_id"))
    return out.filter(F.col("po_date").between(F.lit(start), F.lit(end))) if start else out


def over_stock(moves: DataFrame, products: DataFrame, warehouses: DataFrame | None, purchase_lines: DataFrame, start: date, end: date,
               horizon: int, where: ProductFilter = ALL_PRODUCTS) -> DataFrame:
    """Stock beyond the demand of the coming days, one row per product.

    A product kept in several places is shown for its smallest (company, warehouse).
    """
    if warehouses is not None:  # only the smallest of a company can be shown, so rows are not multiplied first
        wanted = warehouses.filter(F.col("id").isin(list(where.warehouse_ids))) if where.warehouse_ids else warehouses
        warehouses = wanted.groupBy("company_id").agg(F.min("id").alias("id"))
    rows = _position(moves, products, warehouses, start, end, horizon, where)
    place = F.struct("company_id", "warehouse_id")
    first = rows.groupBy("product_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "product_id"]), place).alias("r"))
    rows = first.select("product_id", "r.*")
    rows = rows.withColumn("over_stock_qty", F.round(F.col("virtual_stock") - F.col("ads") * horizon, 0).cast(MONEY))
    rows = rows.withColumn("over_stock_value", (F.col("over_stock_qty") * F.col("standard_price")).cast("decimal(20,2)"))
    totals = rows.agg(F.struct(F.sum("over_stock_qty").alias("q"), F.sum("over_stock_value").alias("v"))).scalar()
    rows = rows.select(
        *_POSITION, "over_stock_qty", _percent(F.col("over_stock_qty"), totals.getField("q")).alias("over_stock_qty_percentage"),
        F.col("standard_price").alias("cost"), "over_stock_value",
        _percent(F.col("over_stock_value"), totals.getField("v")).alias("over_stock_value_percentage"))
    return rows.join(latest_purchase(purchase_lines, start, end), "product_id", "left")


def out_of_stock(moves: DataFrame, products: DataFrame, warehouses: DataFrame | None, start: date, end: date, horizon: int,
                 where: ProductFilter = ALL_PRODUCTS) -> DataFrame:
    """Days and quantity missing over the coming days (D8); the ratio is the rounded day count."""
    rows = _position(moves, products, warehouses, start, end, horizon, where)
    cover = F.round(F.col("virtual_stock") / F.col("_ads"), 2)
    missing = F.greatest(F.lit(horizon).cast("decimal(18,2)") - cover.cast("decimal(24,2)"), F.lit(0).cast("decimal(24,2)"))
    rows = rows.withColumn("_missing", missing.cast("decimal(24,2)"))
    rows = rows.withColumn("out_of_stock_qty", F.round(F.col("_missing") * F.col("ads"), 0).cast(MONEY))
    total = rows.agg(F.sum("out_of_stock_qty")).scalar()
    return rows.select(
        *_POSITION, F.round("_missing", 0).cast(MONEY).alias("out_of_stock_days"),
        F.when(F.lit(horizon) == 0, F.lit(0)).otherwise(F.round("_missing", 2)).cast(MONEY).alias("out_of_stock_ratio"), "out_of_stock_qty",
        _percent(F.col("out_of_stock_qty"), total).alias("out_of_stock_qty_percentage"), F.col("standard_price").alias("cost"),
        (F.col("out_of_stock_qty") * F.col("standard_price")).cast("decimal(20,2)").alias("out_of_stock_value"))


def stock_value(moves: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity on hand times standard price per product (D10); add up over any grouping."""
    held = moves.filter(F.col("state") == "done").groupBy("product_id").agg(_level(F.lit(True), "qty_available"))
    p = products.select(F.col("id").alias("product_id"), product_label().alias("product_label"), "category", "standard_price")
    return p.join(held, "product_id", "left").select(
        "product_id", "product_label", "category", money(F.col("qty_available")).alias("qty_available"),
        (F.col("standard_price") * F.coalesce("qty_available", F.lit(0))).cast("decimal(20,2)").alias("stock_value"))


def joined_names(links: DataFrame, key: str, name: str, chunk: int = 8) -> DataFrame:
    """The distinct names of each key as one text, in name order.

    Names that start alike in ``chunk`` letters are sorted and joined first, then these pieces by what they start with: beginnings are in the order of the names.
    """
    rows = links.select(key, F.col(name).alias("_name")).distinct()

    def joined(order: str) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "_name"))), lambda x: x["_name"]), ", ")

    alike = F.array_join(F.sort_array(F.collect_list("_name")), ", ")
    pieces = rows.groupBy(key, F.substring("_name", 1, chunk).alias("_start")).agg(F.when(F.count("_name") > 0, alike).alias("_name"))
    return pieces.groupBy(key).agg(joined("_start").alias("names"))
