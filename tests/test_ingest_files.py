"""Readers on real files, feeds, upserts, sinks."""

from datetime import date

import pytest
from ledger_helpers import rows
from pyspark.sql import functions as F

from ledgerlake.sources import bank, sinks, vehicles

TODAY = date(2024, 5, 1)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(4, "Azure"), (5, "Deco")], "id long, name string")


def test_csv_statement(spark, people, tmp_path):
    for n, body in enumerate(["S1,10.5,1.5,2023-04-14,Azure,9\nS2,7,,,Deco,1\nS3,7,0,2023-01-01,,1\n", "S4,1,1,2023-01-01,Nobody,1\nS5,1\n,5,1,2023-01-01,Deco,1\nS6,,1,2023-01-01,Deco,1\nS7,x,1,2023-01-01,Deco,1\n"]):
        (tmp_path / f"s{n}.csv").write_text("Account name,Amount,Amount in Currency,Date,Partner,Running Balance\n" + body)
    out = bank.parse_csv(bank.read_csv_records(spark, str(tmp_path)), people, TODAY)
    good = rows(out.filter("reject_reason IS NULL"), "name", "amount", "amount_currency", "date", "partner_id")
    assert good == [("S1", 10.5, 1.5, date(2023, 4, 14), 4), ("S2", 7.0, None, TODAY, 5), ("S3", 7.0, 0.0, date(2023, 1, 1), None)]
    assert dict(rows(out.filter("reject_reason IS NOT NULL"), "name", "reject_reason")) == {
        "": "account name missing", "S4": "partner unknown", "S5": "invalid row format", "S6": "amount missing", "S7": "amount not a number"}


def test_qif_statement(spark, people, tmp_path):
    (tmp_path / "a.qif").write_text("!Type:Bank\nD14/04/2023\nT2000.00\nPAzure\n^\nD\nT-5.25\nPDeco\n^\nD01/01/2023\nT0\nPDeco\n^\nD01/01/2023\nT9\nPNobody\n^\n")
    out = bank.parse_qif(bank.read_qif_records(spark, str(tmp_path)), people, TODAY)
    assert rows(out, "amount", "date", "partner_id", "reject_reason") == [
        (-5.25, TODAY, 5, None), (9.0, date(2023, 1, 1), None, "partner unknown"), (2000.0, date(2023, 4, 14), 4, None)]


def test_unreadable_records_keep_a_reason(spark, people, tmp_path):
    (tmp_path / "a.qif").write_text("!Type:Bank\nD14/04/2023\nT1,234.50\nPAzure\n^\nD14/04/2023\nT5\n^\nD2023-04-14\nT5\nPDeco\n^\nD14/04/2023\nPDeco\n^\n")
    out = bank.parse_qif(bank.read_qif_records(spark, str(tmp_path / "a.qif")), people, TODAY)
    assert sorted(r.reject_reason for r in out.collect()) == ["amount missing", "amount not a number", "date not a date", "payee missing"]
    block = "<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>{}<TRNAMT>{}<NAME>{}</STMTTRN>\n"
    (tmp_path / "a.ofx").write_text("<BANKID>1\n" + block.format("20230230", "1", "Deco") + block.format("20230101", "5,00", "Deco") + block.format("20230101", "5", "Bob &amp; Co"))
    pair = spark.createDataFrame([(4, "Bob & Co"), (5, "Deco")], "id long, name string")
    out = bank.parse_ofx(bank.read_ofx_records(spark, str(tmp_path / "a.ofx")), pair, TODAY)
    assert rows(out, "partner_id", "reject_reason") == [(4, None), (5, "amount not a number"), (5, "date not a date")]


def test_feed_reader_and_rejects(spark, tmp_path):
    (tmp_path / "feed.json").write_text('[{"VIN":"A"},{"make":"x"}]\n\n{broken\n{"other":1}\n')
    docs = vehicles.read_feed(spark, str(tmp_path))
    assert [r.vin_sn for r in vehicles.parse_feed(docs).collect()] == ["A"]
    assert sorted(r.reject_reason for r in vehicles.feed_rejects(docs).collect()) == ["VIN missing", "no list of vehicles", "no list of vehicles"]


def test_ofx_statement(spark, people, tmp_path):
    block = "<STMTTRN><TRNTYPE>{}<DTPOSTED>{}<TRNAMT>{}<FITID>1<NAME>{}</STMTTRN>\n"
    head = "OFXHEADER:100\n<OFX><STMTRS><BANKACCTFROM><BANKID>123<ACCTID>9</BANKACCTFROM>\n"
    (tmp_path / "a.ofx").write_text(head + block.format("DEBIT", "20230414120000", "-12.00", "Azure") + block.format("CREDIT", "", "0.00", "Deco")
                                    + block.format("CREDIT", "", "3.50", "Nobody") + block.format("FEE", "20230101", "1", "Deco") + "</STMTRS></OFX>")
    out = bank.parse_ofx(bank.read_ofx_records(spark, str(tmp_path)), people, TODAY)
    assert rows(out, "name", "amount", "date", "partner_id", "reject_reason") == [
        ("123", -12.0, date(2023, 4, 14), 4, None), ("123", 3.5, TODAY, None, "partner unknown")]


def test_vehicle_csv_headings(spark, tmp_path):
    (tmp_path / "v.csv").write_text(" Name ,VIN_NO,vin,Plate\nC1, ,V1,P1\n , , , \nC2,V2,,\n")
    out = vehicles.normalise_vehicles(vehicles.read_vehicle_csv(spark, str(tmp_path)))
    assert rows(out) == [("C1", "V1", "P1"), ("C2", "V2", None)]


def test_feed_shapes_and_first_record(spark):
    docs = spark.createDataFrame([(1, '[{"VIN":"A","year":2020,"make":"m","trim":""},{"VIN":"","make":"x"},{"VIN":"A","make":"late"}]'), (2, '{"body":[{"VIN":"B","car_id":7}]}'), (3, '{"other":1}')],
                                 "seq int, value string")
    known = spark.createDataFrame([("Z",)], "vin_sn string")
    out = vehicles.new_vehicles(vehicles.parse_feed(docs, ("seq",)), known, ["seq", "position"])
    assert rows(out, "vin_sn", "car_id", "title_en") == [("A", "", "2020 m"), ("B", "7", "")]


def test_report_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, k string")
    for fmt in ("parquet", "csv"):
        sinks.write_report(df, str(tmp_path / fmt), fmt, ("k",))
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt)).count() == 2
    sinks.save_report(df, "kept_report", str(tmp_path / "table"))
    sinks.save_report(df.filter("n = 1"), "kept_report", str(tmp_path / "table"))
    assert spark.table("kept_report").count() == 1
    broken = df.select(F.raise_error(F.lit("no report")).alias("n"))
    with pytest.raises(Exception, match="no report"):
        sinks.save_report(broken, "kept_report", str(tmp_path / "table"))
    assert spark.table("kept_report").count() == 1
    assert len([x for x in spark.catalog.listTables() if x.name.startswith("kept_report__")]) == 1 and len(list((tmp_path / "table").iterdir())) == 1
    spark.sql("DROP VIEW kept_report")


def test_each_ofx_statement_has_its_account_number(spark, people, tmp_path):
    block = "<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20230414<TRNAMT>{}<NAME>Deco</STMTTRN>\n"
    amounts = {"111": range(1, 40), "222": range(40, 41), "333": range(41, 90)}
    text = "".join(f"<STMTRS><BANKID>{n}<ACCTID>1\n" + "".join(block.format(a) for a in some) + "</STMTRS><STMTRS><BANKID>none\n</STMTRS>" for n, some in amounts.items())
    (tmp_path / "a.ofx").write_text("OFXHEADER:100\n<OFX>" + text + "</OFX>")
    (tmp_path / "b.ofx").write_text("<OFX><BANKID>444\n" + block.format(1000) + "</OFX>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "300"):  # the second cuts the file into many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        records = bank.read_ofx_records(spark, str(tmp_path))
        got = sorted((int(r.amount), r.name) for r in bank.parse_ofx(records, people, TODAY).collect())
        splits = records.select("file", "split").distinct().count()
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == [(a, n) for n, some in amounts.items() for a in some] + [(1000, "444")] and (splits > 10) == (size == "300")
