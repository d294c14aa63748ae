"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names, or ``all``) choose what runs.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlake.plans import registry  # noqa: E402
from ledgerlake.session import build_session  # noqa: E402

HEADLINE = [
    "a1_trial_balance", "a2_trial_balance_periods", "a4_general_ledger", "a7_partner_ledger", "a9_partner_ledger_summary", "a14_taxes_by_period",
    "a16_financial_report", "a21_executive_summary", "a24_day_book", "a25_consolidated_journals", "b1_aged_balance", "b4_aged_buckets",
    "b12_followup_by_partner", "b13_dunning_escalation", "b18_followup_status", "c1_practical_amount", "c7_depreciation_board", "d1_fsn", "d2_xyz",
    "d3_fsn_xyz", "d4_stock_ageing", "d6_stock_movement", "d7_over_stock", "e1_parts_kpi", "e4_vehicle_stock", "e7_quotation_split", "s6_vehicle_feed",
]


def run(df) -> None:
    """Computes every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = registry.queries()
    names = list(queries) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false", spark__log__level="ERROR")
    run(queries["a1_trial_balance"](spark, sf_dir))
    seconds = {}
    for name in names:
        started = time.perf_counter()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
