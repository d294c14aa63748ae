import math

import duckdb
import pytest
from text_data import SF

from ledgerlake.llm.queries import ORACLE_SQL, QUERIES


def comparable(rows):
    return sorted(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert comparable(got.select(*columns).collect()) == comparable(want) and want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_over_its_table(spark, name):
    """Queries beyond SQL: as many documents come back as there are (the operators' own tests compare values)."""
    got = QUERIES[name](spark, SF)
    key = next(c for c in ("doc_id", "page_id", "length") if c in got.columns)
    table = "pages" if key == "page_id" else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert (got.agg({"n_docs": "sum"}).first()[0] if key == "length" else got.select(key).distinct().count()) == n
