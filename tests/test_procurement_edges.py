"""Hand-made edge rows of the procurement indicators."""

import pytest
from ledger_helpers import day, money, rows

from ledgerlake.operators import procurement as op


@pytest.fixture
def kpi(spark):
    def build(lines, orders, moves):
        lines = spark.createDataFrame([(i, r, p, "genuine", "draft", money(10)) for i, r, p in lines],
                                      "id long, requisition_id long, product_id long, part_type string, line_status string, qty decimal(18,2)")
        heads = spark.createDataFrame([(r, 1, 1, 1, day("2020-01-01")) for r in (1, 2, 3)], "id long, car_id long, department_id long, employee_id long, request_date date")
        orders = spark.createDataFrame([(i, o, name, day("2020-01-02"), 5, r, p, money(2), money(q)) for i, o, name, r, p, q in orders],
                                       "id long, order_id long, order_name string, date_order date, partner_id long, requisition_id long, product_id long, "
                                       "price_unit decimal(18,2), product_qty decimal(18,2)")
        moves = spark.createDataFrame([(p, day(d), kind, state, origin, money(q)) for p, d, kind, state, origin, q in moves],
                                      "product_id long, date date, picking_type string, state string, origin string, qty decimal(18,2)")
        return op.parts_kpi(lines, heads, orders, moves, spark.createDataFrame([(1, "V")], "id long, vin_sn string"), numbered=False)
    return build


def test_order_receipt_and_issue_of_a_line(kpi):
    out = kpi([(1, 1, 7), (2, 1, 7), (3, 2, 7), (4, 2, None), (5, 9, 7), (6, None, 7), (7, 3, 8)],
              [(1, 1, "A", 1, 7, 3), (2, 2, "B", 1, 7, 4), (3, 2, "B", 1, 7, 5), (4, 3, None, 2, 7, 6), (5, 4, "N", 2, None, 1), (6, 5, "X", None, 7, 1)],
              [(7, "2020-01-05", "incoming", "done", "A", 1), (7, "2020-01-06", "incoming", "done", "B", 2), (7, "2020-01-04", "incoming", "done", "B", 3),
               (7, "2020-01-03", "incoming", "assigned", "B", 9), (7, "2020-01-03", "incoming", "done", None, 9), (None, "2020-01-03", "incoming", "done", "N", 9),
               (8, "2020-01-03", "incoming", "done", "B", 9), (7, "2020-02-01", "outgoing", "done", None, 4), (7, "2020-01-30", "outgoing", "done", "B", 1)])
    assert rows(out, "line_id", "po_number", "ordered_quantity", "received_date", "received_qty", "issue_date", "issued_qty", "vin_sn") == [
        (1, "B", 5.0, day("2020-01-04"), 5.0, day("2020-01-30"), 5.0, "V"), (2, "B", 5.0, day("2020-01-04"), 5.0, day("2020-01-30"), 5.0, "V"),
        (3, None, 6.0, None, 0.0, day("2020-01-30"), 5.0, "V"), (4, None, None, None, 0.0, None, 0.0, "V"), (7, None, None, None, 0.0, None, 0.0, "V")]


def test_every_part_of_a_frequent_product_has_its_issues(kpi):
    n = 60
    out = kpi([(i, 1 + i % 3, 7) for i in range(n)], [(r, r, f"P{r}", r, 7, 1) for r in (1, 2)],
              [(7, "2020-01-05", "incoming", "done", f"P{r}", r) for r in range(40)] + [(7, "2020-01-09", "outgoing", "done", None, 3)] * 2)
    assert rows(out, "line_id", "received_qty", "issued_qty") == [(i, [1.0, 2.0, 0.0][i % 3], 6.0) for i in range(n)]


def test_numbered_lines_have_the_same_figures(spark):
    """Rows with numbers share tables in a packed form; missing orders, receipts, vehicles and dates and orders without numbers must come through alike."""
    lines = spark.createDataFrame([(i, r, p, None if i % 7 == 0 else "genuine", "draft", None if i % 5 == 0 else money(i)) for i, (r, p) in
                                   enumerate([(r, p) for r in (1, 2, 3, 4, None) for p in (7, 8, None) for _ in range(4)])],
                                  "id long, requisition_id long, product_id long, part_type string, line_status string, qty decimal(18,2)")
    heads = spark.createDataFrame([(1, 1, 1, 1, day("2020-01-01")), (2, None, 1, 1, day("2020-01-01")), (3, 9, None, None, None), (5, 1, 1, 1, day("2020-01-09"))],
                                  "id long, car_id long, department_id long, employee_id long, request_date date")
    orders = spark.createDataFrame([(1, 1, "A", 1, 7), (2, 2, None, 1, 7), (3, None, "C", 1, 8), (4, 4, "D", 2, 7), (None, 4, "E", 2, 7), (6, 5, "F", 3, 8)],
                                   "id long, order_id long, order_name string, requisition_id long, product_id long").selectExpr(
        "*", "date'2020-01-02' AS date_order", "5L AS partner_id", "CAST(id AS DECIMAL(18,2)) AS price_unit", "CAST(NULL AS DECIMAL(18,2)) AS product_qty")
    moves = spark.createDataFrame([(7, day("2020-01-05"), "incoming", "done", "D", money(2)), (8, None, "incoming", "done", "F", None), (7, day("2020-01-06"), "outgoing", "done", None, money(1))],
                                  "product_id long, date date, picking_type string, state string, origin string, qty decimal(18,2)")
    kpi = [op.parts_kpi(lines, heads, orders, moves, spark.createDataFrame([(1, "V")], "id long, vin_sn string"), numbered=n) for n in (True, False)]
    assert kpi[0].columns == ["row_no", *kpi[1].columns]
    assert rows(kpi[0].drop("row_no")) == rows(kpi[1]) and kpi[1].count() == 36
    want = sorted(((r.request_date is not None, r.request_date, r.requisition_id, r.line_id) for r in kpi[1].collect()), key=lambda r: (r[0], str(r[1]), *r[2:]), reverse=True)
    assert [(r.requisition_id, r.line_id) for r in kpi[0].orderBy("row_no").collect()] == [r[2:] for r in want]
    assert {r.po_number for r in kpi[0].filter("requisition_id = 2 AND product_id = 7").collect()} == {"D"}


def test_receipts_and_orders_are_sorted_narrow(spark):
    """In the tables that lines share with orders and receipts the columns of a line are one value, so that the rows of the others are not as wide as lines."""
    from check import load_entry
    df = load_entry().queries()["e1_parts_kpi"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in text and "line_status#" in text and "null AS line_status#" not in text
