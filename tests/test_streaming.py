"""Streaming forms: watermark, restarts, repeats."""

import json
from datetime import date

from ledger_helpers import rows

from ledgerlake.streaming import jobs

LINES = "date date, debit decimal(18,2), credit decimal(18,2)"


def drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def forget(state, batch):
    """As if the batch had not been noted as done."""
    for name in (f"{batch}", f".{batch}.crc"):
        (state / "commits" / name).unlink()


def test_daily_totals_leave_out_late_rows(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(LINES).json(str(inbox))
        jobs.daily_totals(stream, "1 day").writeStream.format("parquet").outputMode("append").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    drop(inbox, "1.json", [{"date": "2024-01-01", "debit": 5, "credit": 0}, {"date": "2024-01-01", "debit": 1, "credit": 6}, {"date": "2024-01-10", "debit": 1, "credit": 0}])
    run()
    drop(inbox, "2.json", [{"date": "2024-01-01", "debit": 100, "credit": 0}, {"date": "2024-01-10", "debit": 2, "credit": 0}, {"date": "2024-01-20", "debit": 1, "credit": 0}])
    run()
    got = spark.read.schema("date date, debit decimal(18,2), credit decimal(18,2), line_count long").parquet(out)
    assert rows(got) == [(date(2024, 1, 1), 6.0, 6.0, 2), (date(2024, 1, 10), 3.0, 0.0, 2)]


def test_back_dated_lines_count(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for name, records in (("1.json", [{"date": "2024-01-01", "debit": 5, "credit": 0}, {"date": "2024-01-20", "debit": 1, "credit": 0}]),
                          ("2.json", [{"date": "2024-01-01", "debit": 100, "credit": 6}])):
        drop(inbox, name, records)
        jobs.add_daily_totals(spark.readStream.schema(LINES).json(str(inbox)), out, state).awaitTermination()
    assert rows(jobs.read_daily_totals(spark, out)) == [(date(2024, 1, 1), 105.0, 6.0, 2), (date(2024, 1, 20), 1.0, 0.0, 1)]


def test_daily_totals_stay_as_small_as_the_days(spark, tmp_path):
    inbox, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    assert jobs.read_daily_totals(spark, str(out)).count() == 0
    for n in range(4):
        drop(inbox, f"{n}.json", [{"date": f"2024-01-0{1 + n % 2}", "debit": 1, "credit": n}])
        jobs.add_daily_totals(spark.readStream.schema(LINES).json(str(inbox)), str(out), str(state)).awaitTermination()
    want = [(date(2024, 1, 1), 2.0, 2.0, 2), (date(2024, 1, 2), 2.0, 4.0, 2)]
    assert rows(jobs.read_daily_totals(spark, str(out))) == want
    assert sorted(p.name for p in out.iterdir()) == ["version=2", "version=3"]
    forget(state, 3)
    jobs.add_daily_totals(spark.readStream.schema(LINES).json(str(inbox)), str(out), str(state)).awaitTermination()
    assert rows(jobs.read_daily_totals(spark, str(out))) == want
    (out / "version=3" / "_SUCCESS").unlink()  # a snapshot half written
    assert rows(jobs.read_daily_totals(spark, str(out))) == [(date(2024, 1, 1), 2.0, 2.0, 2), (date(2024, 1, 2), 1.0, 1.0, 1)]


def feed(spark, inbox):
    return spark.readStream.schema("seq long, value string, ts timestamp").json(str(inbox))


def test_feed_appends_each_vin_once(spark, tmp_path):
    inbox, register, state = tmp_path / "in", str(tmp_path / "register"), str(tmp_path / "state")
    doc = lambda seq, *vins: {"seq": seq, "ts": f"2024-01-0{seq}T00:00:00", "value": json.dumps([{"VIN": v, "make": f"m{seq}"} for v in vins])}
    read = lambda: rows(spark.read.schema(jobs.REGISTER_SCHEMA).parquet(register), "vin_sn", "title_en")
    drop(inbox, "1.json", [doc(2, "A"), doc(1, "A", "B")])
    jobs.register_feed(feed(spark, inbox), register, state, ["seq", "position"]).awaitTermination()
    assert read() == [("A", "m1"), ("B", "m1")]
    drop(inbox, "2.json", [doc(3, "B", "C")])
    jobs.register_feed(feed(spark, inbox), register, state, ["seq", "position"]).awaitTermination()
    assert read() == [("A", "m1"), ("B", "m1"), ("C", "m3")]
    (tmp_path / "register" / "batch=0").rename(tmp_path / "away")  # no batch reads what an earlier one wrote
    drop(inbox, "3.json", [doc(4, "A", "D")])
    jobs.register_feed(feed(spark, inbox), register, state, ["seq", "position"]).awaitTermination()
    assert read() == [("C", "m3"), ("D", "m4")]
    forget(tmp_path / "state", 2)
    jobs.register_feed(feed(spark, inbox), register, state, ["seq", "position"]).awaitTermination()
    assert read() == [("C", "m3"), ("D", "m4")]
    known = spark.createDataFrame([("A",), ("Z",)], "vin_sn string")
    other = str(tmp_path / "other")
    jobs.register_feed(feed(spark, inbox), other, str(tmp_path / "state2"), ["seq", "position"], known).awaitTermination()
    assert sorted(r.vin_sn for r in spark.read.schema(jobs.REGISTER_SCHEMA).parquet(other).collect()) == ["B", "C", "D"]


def test_distinct_vins(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    drop(inbox, "1.json", [{"seq": i, "ts": "2024-01-01T00:00:00", "value": '[{"VIN":"A"},{"VIN":"B"}]'} for i in range(3)])
    jobs.distinct_vins(feed(spark, inbox), "ts").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.vin_sn for r in spark.read.schema("ts timestamp, vin_sn string").parquet(out).collect()) == ["A", "B"]
