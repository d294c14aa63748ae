import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools"), str(ROOT / "tests")]

from ledger_helpers import LINE_SCHEMA, day, money  # noqa: E402

from ledgerlake.session import build_session  # noqa: E402
from ledgerlake.sources.testbed import (ACCOUNT_SCHEMA, ACCOUNTS, JOURNAL_SCHEMA, JOURNALS, local_rows)  # noqa: E402

PARTIAL_SCHEMA = "debit_line_id long, credit_line_id long, amount decimal(18,2), max_date date"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__log__level="ERROR",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def ledger(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LINE_SCHEMA)


@pytest.fixture
def partials(spark):
    return lambda *rows: spark.createDataFrame([(a, b, money(m), day(d)) for a, b, m, d in rows], PARTIAL_SCHEMA)


@pytest.fixture(scope="session")
def accounts(spark):
    return local_rows(spark, ACCOUNTS, ACCOUNT_SCHEMA)


@pytest.fixture(scope="session")
def journals(spark):
    return local_rows(spark, JOURNALS, JOURNAL_SCHEMA)


@pytest.fixture(scope="session")
def partners(spark):
    return spark.createDataFrame([(1, "Anna", None, "A"), (2, "B" * 45, "r", "B"), (3, "Cleo", None, "A")], "id long, name string, ref string, segment string")
