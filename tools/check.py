"""Compare every registered query with its checking SQL on one data directory.

usage: python tools/check.py [sf_dir] [name-prefix ...]
"""

import importlib.util
import math
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

from ledgerlake.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(float(value)) if abs(value) < 2**53 else str(value)
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return repr(value) if isinstance(value, float) else str(value)


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(row[i]) for i in order) for row in rows)


def compare(spark_df, con, text):
    got_cols = spark_df.columns
    got = canon_rows(got_cols, spark_df.collect())
    cur = con.execute(text)
    want_cols = [d[0] for d in cur.description]
    want = canon_rows(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns differ: {sorted(got_cols)} / {sorted(want_cols)}", len(got)
    if len(got) != len(want):
        return f"row counts differ: {len(got)} / {len(want)}" + _diff(got, want), len(got)
    if got != want:
        return "values differ" + _diff(got, want), len(got)
    return None, len(got)


def _diff(got, want):
    a, b = set(got), set(want)
    return f"\n   only spark: {sorted(a - b)[:3]}\n   only sql:   {sorted(b - a)[:3]}  ({len(a - b)}/{len(b - a)})"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    entry = load_entry()
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g", spark__log__level="ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracle:
                error, n = compare(df, con, oracle[name])
            else:
                error, n = None, df.count()
        except Exception as exc:  # report and go on
            error, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        bad += error is not None
        print(f"{'ok  ' if not error else 'FAIL'} {name} rows={n} {time.time() - started:.1f}s"
              f"{'' if name in oracle else ' (no sql)'}{' ' + error if error else ''}", flush=True)
        if n == 0:
            print(f"     note: {name} is empty", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
