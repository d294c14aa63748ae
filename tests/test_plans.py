"""Physical plans: what must not appear, and what must reach the scan."""

import re

import pytest
from check import load_entry

from ledgerlake.functions.filters import LedgerFilter
from ledgerlake.operators import ledger as gl
from ledgerlake.operators import receivables as rec
from ledgerlake.plans.base import END, START
from ledgerlake.sources.testbed import Testbed

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load_entry().queries()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
SAMPLE = ["a1_trial_balance", "a4_general_ledger", "a7_partner_ledger", "a14_taxes_by_period", "a21_executive_summary", "b1_aged_balance", "b13_dunning_escalation",
          "b18_followup_status", "c1_practical_amount", "c7_depreciation_board", "c17_fiscal_year_violations", "d2_xyz", "d3_fsn_xyz", "d7_over_stock", "e1_parts_kpi",
          "e7_quotation_split", "s6_vehicle_feed", "s7_keyed_upsert"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", SAMPLE)
def test_no_pair_products_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert not [word for word in FORBIDDEN if word in text]


def written_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    Testbed(spark, SF_DIR).move_line.write.partitionBy("company_id").parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_a_ledger_scan(spark, accounts, tmp_path):
    lines = written_ledger(spark, tmp_path)
    text = formatted(gl.trial_balance(lines, accounts, LedgerFilter(date_from=START, date_to=END, state="posted", company_ids=(1,))))
    found = {key: re.search(rf"{key}: (.*)", text).group(1) for key in ("PartitionFilters", "PushedFilters", "ReadSchema")}
    assert "company_id" in found["PartitionFilters"]
    assert all(f in found["PushedFilters"] for f in ("GreaterThanOrEqual(date,1998-01-01)", "LessThanOrEqual(date,1998-12-31)", "EqualTo(parent_state,posted)"))
    assert set(re.findall(r"(\w+):", found["ReadSchema"])) <= {"account_id", "date", "debit", "credit", "parent_state", "display_type"}


def ledger_scans(df) -> int:
    """Scans of the written ledger in the plan before execution: by its columns, since long paths are cut off."""
    return len([s for s in re.findall(r"ReadSchema: struct<([^>]*)", formatted(df)) if "account_id:" in s and ("debit:" in s or "balance:" in s)])


def test_ageing_reads_the_ledger_once(spark, accounts, tmp_path):
    lines = written_ledger(spark, tmp_path)
    t = Testbed(spark, SF_DIR)
    assert ledger_scans(rec.aged_balance(lines, accounts, t.partial, t.partner, rec.AgeingParams(asof=END))) == 1


def test_running_balance_shuffles_rows_by_cell(spark, accounts, journals, tmp_path):
    lines = written_ledger(spark, tmp_path)
    text = plan(gl.general_ledger(lines, accounts, journals, LedgerFilter(date_from=START, date_to=END)))
    assert re.search(r"hashpartitioning\(_k#\d+, _l0#\d+, _l1#\d+, _l2#\d+", text)


def executed(df, kind: str) -> list:
    """The operators of a kind that were really run, those of subqueries among them and reused ones once; without adaptive re-planning."""
    df.collect()
    found = []

    def walk(node):
        if node.nodeName().startswith("Reused"):
            return
        if node.nodeName().startswith(kind):
            found.append(node)
        for plans in (node.children(), node.subqueries()):
            for i in range(plans.size()):
                walk(plans.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def executed_scans(df, columns=("debit", "account_id")) -> list[int]:
    """Rows out of each scan of the written ledger that was run."""
    scans = {n.id(): n for n in executed(df, "Scan parquet") if all(f"{c}#" in n.output().toString() for c in columns)}
    return [n.metrics().get("numOutputRows").get().value() for n in scans.values()]


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_opening_balances_cost_no_further_scan(spark, accounts, journals, tmp_path, fixed_plans):
    lines = written_ledger(spark, tmp_path)
    where = LedgerFilter(date_from=START, date_to=END)
    assert len(executed_scans(gl.general_ledger(lines, accounts, journals, where, initial_balance=True))) <= 2
    kept = spark.createDataFrame([(3, 1)], "journal_id long, account_id long")
    assert len(executed_scans(gl.liquidity_book(lines, accounts, journals, where, "bank", journal_accounts=kept))) <= 2


@pytest.mark.parametrize("sort_by, windows", [("date", 4), ("journal_partner", 6)])
def test_totals_and_rows_of_a_ledger_share_one_shuffle(spark, accounts, journals, partners, tmp_path, fixed_plans, sort_by, windows):
    lines = written_ledger(spark, tmp_path)
    df = gl.general_ledger(lines, accounts, journals, LedgerFilter(date_from=START, date_to=END), partners, sort_by=sort_by)
    assert len(executed_scans(df)) == 1
    assert len({n.id() for n in executed(df, "Window")}) <= windows


def test_a_page_reads_only_the_days_that_hold_it(spark, accounts, journals, tmp_path, fixed_plans):
    path = str(tmp_path / "by_day")
    Testbed(spark, SF_DIR).move_line.repartitionByRange(40, "date").sortWithinPartitions("date").write.parquet(path)
    lines = spark.read.parquet(path)
    days = str(tmp_path / "days")
    gl.ledger_days(lines.filter("parent_state = 'posted'")).write.parquet(days)
    page = gl.ledger_page(lines, accounts, journals, 2, START, END, 2, where=LedgerFilter(state="posted"), days=spark.read.parquet(days))
    read = executed_scans(page)
    assert len(page.collect()) == 20 and len(read) <= 2 and max(read) < lines.count() / 8


def test_taxes_by_period_read_the_ledger_once(spark, accounts, tmp_path, fixed_plans):
    from ledgerlake.operators import taxes
    from ledgerlake.plans.statements import POSTED_ANY, YEARS
    lines, t = written_ledger(spark, tmp_path), Testbed(spark, SF_DIR)
    assert len(executed_scans(taxes.taxes_by_period(lines, t.line_tax, t.tax, accounts, POSTED_ANY, YEARS), ("balance", "tax_line_id"))) == 1


def test_cumulative_share_needs_few_exchanges(spark, fixed_plans):
    assert len(executed(QUERIES["d2_xyz"](spark, SF_DIR), "Exchange")) <= 6


@pytest.mark.parametrize("name, small", [("c7_depreciation_board_continued", 0), ("c8_residual_value", 0), ("c9_last_depreciation", 0), ("c10_disposal_lines", 0),
                                         ("c11_depreciation_entries", 1), ("c12_asset_analysis", 0), ("c14_outstanding_occurrences", 0)])
def test_rows_out_of_schedules_are_not_broadcast(spark, name, small):
    assert plan(QUERIES[name](spark, SF_DIR)).count("BroadcastHashJoin") == small


@pytest.mark.parametrize("name", ["a13_tax_report", "b2_aged_lines", "p4_aged_lines_labelled", "d3_fsn_xyz", "d4_stock_ageing", "f5_combined_class_filter"])
def test_moves_and_layers_are_read_once(spark, fixed_plans, name):
    scans = {n.id() for n in executed(QUERIES[name](spark, SF_DIR), "Scan parquet") if "l_orderkey#" in n.output().toString()}
    assert len(scans) == 2


def test_report_items_are_not_shuffled_by_account(spark, accounts, tmp_path):
    from ledgerlake.operators import statements
    lines = written_ledger(spark, tmp_path)
    text = plan(statements.report_items(lines, accounts, Testbed(spark, SF_DIR).node, 1, LedgerFilter()))
    probe = text[:text.index("BroadcastExchange")]
    assert "BroadcastHashJoin [account_id" in probe and "SortMergeJoin" not in probe


def test_joined_names_need_no_numbers(spark, fixed_plans):
    links = spark.createDataFrame([(1, "abcdefghZ"), (1, "abcdefghA"), (1, "ab"), (1, None), (1, "\u00e9"), (1, "ab"), (2, None)], "k long, n string")
    from ledgerlake.operators import inventory
    df = inventory.joined_names(links, "k", "n")
    assert sorted(map(tuple, df.collect())) == [(1, "ab, abcdefghA, abcdefghZ, \u00e9"), (2, "")]
    assert len(executed(df, "Exchange")) <= 3


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_indicator_lines_move_once_after_their_requisition(spark, fixed_plans, no_broadcasts):
    shuffles = {n.id(): n.output().toString() for n in executed(QUERIES["f4_kpi_point_selection"](spark, SF_DIR), "Exchange")}
    # Without broadcasts the rows move once more at the end, for the names of the vehicles.
    assert len([columns for columns in shuffles.values() if "line_status#" in columns and "issue_date#" not in columns]) == 1


def test_numbered_indicator_lines_move_once_after_their_requisition(spark, fixed_plans, no_broadcasts):
    df = QUERIES["e1_parts_kpi"](spark, SF_DIR)
    shuffles = {n.id(): n.output().toString() for n in executed(df, "Exchange")}
    assert len([columns for columns in shuffles.values() if "line_status#" in columns]) == 1
    # Lines, purchases and moves; the numbers read the lines from where they lie.
    assert len({n.id() for n in executed(df, "Scan parquet") if "l_orderkey#" in n.output().toString()}) == 3
