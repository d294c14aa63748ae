"""Source, sink and streaming queries; their input text is derived from the given tables."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlake.functions.filters import LedgerFilter
from ledgerlake.functions.workspace import fresh_folder, shared_folder
from ledgerlake.operators import ledger
from ledgerlake.plans.base import Family
from ledgerlake.plans.ledger import POSTED, _TB, d
from ledgerlake.plans.oracle import sql
from ledgerlake.sources import bank, sinks, vehicles
from ledgerlake.sources.testbed import Testbed, spread
from ledgerlake.streaming import jobs

FAMILY = Family()
TODAY = date(2001, 8, 1)

# Text columns both engines can build: every order gives one statement record, some of them faulty.
_NAME = "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Statement ' || CAST(o_orderkey AS STRING) END"
_AMOUNT = "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END"
_DATE = "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
_PARTNER = "CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'Nobody' ELSE 'Customer#' || LPAD(CAST(o_custkey AS STRING), 9, '0') END"
_CUSTOMER = "CASE WHEN o_orderkey % 11 = 0 THEN 'Nobody' ELSE 'Customer#' || LPAD(CAST(o_custkey AS STRING), 9, '0') END"
_KNOWN = "(SELECT name AS partner_name, MIN(id) AS partner_id FROM partner GROUP BY name)"


def _files(records, purpose: str, **options) -> str:
    """Derived record text as files, for the readers."""
    path = fresh_folder(records.sparkSession, purpose)
    kind = options.pop("kind", "text")
    records.write.options(**options).format(kind).save(path)
    return path


_RAW = dict(kind="csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@FAMILY.query("s1_table_scan", "SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM lineitem")
def _(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@FAMILY.query("s2_statement_csv", sql("partner", f"""SELECT name, CAST(NULLIF(amount, '') AS DOUBLE) AS amount,
    CAST(CASE WHEN n >= 5 OR n = 3 THEN NULLIF(amount, '') END AS DOUBLE) AS amount_currency,
    CASE WHEN n < 5 OR day = '' THEN DATE '{TODAY}' ELSE CAST(day AS DATE) END AS date, p.partner_id, 'csv file' AS payment_ref,
    CASE WHEN n < 5 THEN 'invalid row format' WHEN name = '' THEN 'account name missing' WHEN amount = '' THEN 'amount missing'
      WHEN partner <> '' AND p.partner_id IS NULL THEN 'partner unknown' END AS reject_reason
    FROM (SELECT o_orderkey AS o, {_NAME} AS name, {_AMOUNT} AS amount, {_DATE} AS day, {_PARTNER} AS partner, CASE WHEN o_orderkey % 19 = 0 THEN 3 ELSE 6 END AS n FROM orders) s
    LEFT JOIN {_KNOWN} p ON n >= 5 AND p.partner_name = s.partner"""))
def _(t):
    full = f"concat_ws(',', {_NAME}, {_AMOUNT}, {_AMOUNT}, {_DATE}, {_PARTNER}, '0')"
    records = spread(t.raw("orders")).selectExpr(f"CASE WHEN o_orderkey % 19 = 0 THEN concat_ws(',', {_NAME}, {_AMOUNT}, {_AMOUNT}) ELSE {full} END AS value")
    path = _files(records, "s2", **_RAW, sep="\u0001", quote="")
    return bank.parse_csv(bank.read_csv_records(t.spark, path), t.partner, TODAY)


_KIND = "CASE o_orderkey % 4 WHEN 0 THEN 'DEBIT' WHEN 1 THEN 'CREDIT' WHEN 2 THEN 'XFER' ELSE 'debit' END"
_SIGNED = "CAST(CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE o_totalprice END AS DECIMAL(18,2))"


@FAMILY.query("s3_statement_ofx", sql("partner", f"""SELECT '9' || CAST(f AS STRING) AS name, CAST(amount AS DOUBLE) AS amount,
    CASE WHEN o % 5 = 0 THEN DATE '{TODAY}' ELSE day END AS date, p.partner_id, partner AS partner_name, 'ofx file' AS payment_ref,
    CASE WHEN p.partner_id IS NULL THEN 'partner unknown' END AS reject_reason
    FROM (SELECT o_orderkey AS o, o_orderkey // 500 AS f, {_SIGNED} AS amount, CAST(o_orderdate AS DATE) AS day, {_CUSTOMER} AS partner, {_KIND} AS kind FROM orders) s
    LEFT JOIN {_KNOWN} p ON p.partner_name = s.partner WHERE lower(kind) IN ('debit', 'credit') AND amount <> 0"""))
def _(t):
    # Statements of 500 order numbers follow one another in the files; the first order of each carries the heading.
    body = (f"'<STMTTRN><TRNTYPE>' || {_KIND} || '\\n<DTPOSTED>' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE date_format(o_orderdate, 'yyyyMMdd') || '120000' END "
            f"|| '\\n<TRNAMT>' || CAST({_SIGNED} AS STRING) || '\\n<FITID>1\\n<NAME>' || {_CUSTOMER} || '\\n'")
    orders = t.raw("orders").selectExpr("*", "o_orderkey DIV 500 AS statement")
    orders = orders.join(orders.groupBy("statement").agg(F.min("o_orderkey").alias("first")), "statement")
    records = orders.repartitionByRange("statement").sortWithinPartitions("o_orderkey").selectExpr(
        f"CASE WHEN o_orderkey = first THEN '<OFX><BANKID>9' || CAST(statement AS STRING) || '<ACCTID>5' ELSE '' END || {body} AS value")
    path = _files(records, "s3", lineSep=bank.OFX_END)
    return bank.parse_ofx(bank.read_ofx_records(t.spark, path), t.partner, TODAY)


@FAMILY.query("s4_statement_qif", sql("partner", f"""SELECT CAST(amount AS DOUBLE) AS amount, CASE WHEN o % 5 = 0 THEN DATE '{TODAY}' ELSE day END AS date, p.partner_id, partner AS partner_name,
    'qif file' AS payment_ref, CASE WHEN partner = '' THEN 'payee missing' WHEN p.partner_id IS NULL THEN 'partner unknown' END AS reject_reason
    FROM (SELECT o_orderkey AS o, {_SIGNED} AS amount, CAST(o_orderdate AS DATE) AS day, {_PARTNER} AS partner FROM orders) s
    LEFT JOIN {_KNOWN} p ON p.partner_name = s.partner WHERE amount <> 0"""))
def _(t):
    records = spread(t.raw("orders")).selectExpr(
        f"""CASE WHEN o_orderkey % 100 = 0 THEN '!Type:Bank' ELSE '' END || '\\nD' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE date_format(o_orderdate, 'dd/MM/yyyy') END
        || '\\nT' || CAST({_SIGNED} AS STRING) || '\\nP' || {_PARTNER} || '\\n' AS value""")
    return bank.parse_qif(bank.read_qif_records(t.spark, _files(records, "s4", lineSep=bank.QIF_END)), t.partner, TODAY)


@FAMILY.query("s5_vehicle_csv", """SELECT * FROM (SELECT NULLIF(TRIM(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name || ' ' END), '') AS car_id,
      COALESCE(CASE WHEN c_custkey % 5 = 0 THEN 'V' || CAST(c_custkey AS STRING) END, CASE WHEN c_custkey % 2 = 0 THEN 'CH' || CAST(c_custkey AS STRING) END) AS vin_sn,
      CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS title_en FROM customer) WHERE COALESCE(car_id, vin_sn, title_en) IS NOT NULL""")
def _(t):
    raw = t.raw("customer").selectExpr(
        "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name || ' ' END AS ` Vehicle `", "CASE WHEN c_custkey % 5 = 0 THEN 'V' || CAST(c_custkey AS STRING) ELSE '' END AS `VIN_NO`",
        "CASE WHEN c_custkey % 2 = 0 THEN ' CH' || CAST(c_custkey AS STRING) END AS `Chassis `", "CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE '  ' END AS `Plate`")
    return vehicles.normalise_vehicles(vehicles.read_vehicle_csv(t.spark, _files(raw, "s5", **_RAW)))


@FAMILY.query("s5_vehicle_csv_without_header", """SELECT NULLIF(TRIM(c_name), '') AS car_id, CASE WHEN c_custkey % 2 = 0 THEN 'CH' || CAST(c_custkey AS STRING) END AS vin_sn, c_mktsegment AS title_en FROM customer""")
def _(t):
    raw = t.raw("customer").selectExpr("c_name || ' ' AS `_c0`", "CASE WHEN c_custkey % 2 = 0 THEN ' CH' || CAST(c_custkey AS STRING) END AS `_c1`", "c_mktsegment AS `_c2`", "'x' AS `_c3`")
    path = _files(raw, "s5", **_RAW | {"header": False})
    return vehicles.normalise_vehicles(vehicles.read_vehicle_csv(t.spark, path, header=False), header=False)


def _feed(t):
    item = """'{"VIN": "' || CASE WHEN user_id % 9 = 0 THEN '' ELSE 'VIN' || CAST(user_id AS STRING) END || '", "year": ' || CAST(1990 + event_id % 30 AS STRING)
      || ', "make": "' || event_type || '", "model": "", "trim": "T' || CAST(event_id % 5 AS STRING) || '", "car_id": ' || CAST(event_id AS STRING) || '}'"""
    other = """'{"VIN": "ALT' || CAST(event_id % 400 AS STRING) || '", "make": "' || event_type || '"}'"""
    return spread(t.raw("events")).selectExpr(
        "ts", "event_id", f"CASE WHEN event_id % 2 = 0 THEN '[' || {item} || ', ' || {other} || ']' ELSE '{{\"body\": [' || {item} || ']}}' END AS value")


_FEED = """SELECT car_id, vin_sn, title_en FROM (
    SELECT CAST(event_id AS STRING) AS car_id, 'VIN' || CAST(user_id AS STRING) AS vin_sn, CAST(1990 + event_id % 30 AS STRING) || ' ' || event_type || ' T' || CAST(event_id % 5 AS STRING) AS title_en,
      ts, event_id, 0 AS position FROM events WHERE user_id % 9 <> 0
    UNION ALL SELECT '', 'ALT' || CAST(event_id % 400 AS STRING), event_type, ts, event_id, 1 FROM events WHERE event_id % 2 = 0)
    WHERE vin_sn NOT IN (SELECT vin_sn FROM vehicle) QUALIFY ROW_NUMBER() OVER (PARTITION BY vin_sn ORDER BY ts, event_id, position) = 1"""
_ORDER = ["ts", "event_id", "position"]


@FAMILY.query("s6_vehicle_feed", sql("vehicle", _FEED))
def _(t):
    # Files in the order of the events, so that the place in the files decides which record is first.
    place = ("file", "split", "row")
    path = _files(_feed(t).repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").select("value"), "s6")
    return vehicles.new_vehicles(vehicles.parse_feed(vehicles.read_feed(t.spark, path), place), t.vehicle, [*place, "position"])


_INCOMING = """SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'CAR' || CAST(c_custkey % 120 AS STRING) END AS car_id,
    CASE WHEN c_custkey % 3 = 0 THEN 'VIN' || CAST(c_custkey % 130 AS STRING) END AS vin_sn,
    CASE WHEN c_custkey % 5 < 3 THEN 'Supplier#' || LPAD(CAST(c_custkey % 140 AS STRING), 9, '0') END AS title_en FROM {}"""


def _incoming(t):
    return t.spark.sql(_INCOMING.format("{customer}"), customer=t.raw("customer")).filter("coalesce(car_id, vin_sn, title_en) IS NOT NULL")


_NEW, _NONE = 10**12, 10**15  # created rows are numbered after all others, by the record that created them


def _held(field: str, changes: str, rest: str) -> dict[str, str]:
    """Who holds a title or car number over time, and the rows that the records without a better key find or create."""
    f = field[0]
    return {
        f"{f}_span": f"SELECT *, LEAD(since) OVER (PARTITION BY r ORDER BY since) AS until FROM ({changes})",
        f"{f}_found": f"""SELECT i.*, (SELECT MIN(r) FROM {f}_span s WHERE s.v = i.{field} AND s.since < i.seq AND (s.until IS NULL OR i.seq < s.until)) AS found
          FROM incoming i WHERE {rest} AND {field} IS NOT NULL""",
        f"{f}_event": f"""SELECT seq, car_id, vin_sn, title_en, LEAST(COALESCE(found, {_NONE}), CASE WHEN seq >= first THEN {_NEW} + first ELSE {_NONE} END) AS r
          FROM (SELECT *, MIN(seq) FILTER (found IS NULL) OVER (PARTITION BY {field}) AS first FROM {f}_found)"""}


_OLD = "SELECT id AS r, -1 AS since, {0} AS v FROM vehicle WHERE {0} <> '' UNION ALL SELECT r, seq, {0} FROM v_event WHERE {0} IS NOT NULL"
_MERGE = dict(
    incoming=f"SELECT * FROM ({_INCOMING.format('customer')}) WHERE COALESCE(car_id, vin_sn, title_en) IS NOT NULL",
    v_event=f"""SELECT seq, car_id, vin_sn, title_en, COALESCE((SELECT MIN(id) FROM vehicle x WHERE x.vin_sn = i.vin_sn), {_NEW} + MIN(seq) OVER (PARTITION BY vin_sn)) AS r
      FROM incoming i WHERE vin_sn IS NOT NULL""",
    **_held("title_en", _OLD.format("title_en"), "vin_sn IS NULL"),
    **_held("car_id", _OLD.format("car_id") + " UNION ALL SELECT r, seq, car_id FROM t_event WHERE car_id IS NOT NULL", "vin_sn IS NULL AND title_en IS NULL"),
    event="SELECT * FROM v_event UNION ALL SELECT * FROM t_event UNION ALL SELECT * FROM c_event",
    register="""SELECT r, ARG_MAX(car_id, seq) FILTER (car_id IS NOT NULL) AS car_id, ARG_MAX(vin_sn, seq) FILTER (vin_sn IS NOT NULL) AS vin_sn,
      ARG_MAX(title_en, seq) FILTER (title_en IS NOT NULL) AS title_en, COUNT(seq) FILTER (seq >= 0) AS records
      FROM (SELECT seq, car_id, vin_sn, title_en, r FROM event UNION ALL SELECT -1, car_id, vin_sn, title_en, id FROM vehicle) GROUP BY r""")


@FAMILY.query("s7_keyed_upsert", sql("vehicle", f"""SELECT CASE WHEN r < {_NEW} THEN r END AS id, car_id, vin_sn, title_en,
    CASE WHEN r >= {_NEW} THEN 'created' WHEN records > 0 THEN 'updated' ELSE 'kept' END AS action, records FROM register""", **_MERGE))
def _(t):
    return vehicles.upsert_vehicles(t.vehicle, _incoming(t), "seq")


@FAMILY.query("s7_upsert_counts", sql("vehicle", f"""SELECT 'created' AS action, COUNT(*) AS n FROM register WHERE r >= {_NEW}
    UNION ALL SELECT 'updated', (SELECT COUNT(*) FROM event) - (SELECT COUNT(*) FROM register WHERE r >= {_NEW})
    UNION ALL SELECT 'kept', COUNT(*) FROM register WHERE records = 0""", **_MERGE))
def _(t):
    return vehicles.upsert_counts(vehicles.upsert_vehicles(t.vehicle, _incoming(t), "seq"))


@FAMILY.query("s8_insert_if_absent", sql("vehicle", """SELECT car_id, vin_sn, title_en, seq, CASE WHEN car_id IS NULL THEN 'car_id is required' WHEN vin_sn IS NULL THEN 'vin_sn is required'
      WHEN title_en IS NULL THEN 'title_en is required' WHEN vin_sn IN (SELECT vin_sn FROM vehicle) OR seq > MIN(seq) FILTER (car_id IS NOT NULL AND title_en IS NOT NULL) OVER (PARTITION BY vin_sn)
      THEN 'VIN already exists' END AS reject_reason FROM incoming""", incoming=_MERGE["incoming"]))
def _(t):
    return vehicles.insert_vehicles(t.vehicle, _incoming(t), "seq")


@FAMILY.query("k1_report_files", sql("move_line account", _TB))
def _(t):
    path = fresh_folder(t.spark, "k1")
    report = ledger.trial_balance(t.move_line, t.account, POSTED)
    sinks.write_report(report, path, partition_by=("code",))
    return t.spark.read.schema(report.schema).parquet(path)


@FAMILY.query("k2_report_table", sql("move_line account", _TB))
def _(t):
    report = ledger.trial_balance(t.move_line, t.account, POSTED)
    sinks.save_report(report, "ledgerlake_trial_balance", f"{shared_folder(t.spark)}/ledgerlake/k2")
    return t.spark.table("ledgerlake_trial_balance")


class StreamedTestbed(Testbed):
    """The same derivation with some of the source files read as a stream."""

    streamed = ("lineitem",)

    def raw(self, name):
        static = super().raw(name)
        if name not in self.streamed:
            return static
        # A glob, since the file source lists folders and patterns.
        return self.spark.readStream.schema(static.schema).parquet(f"{self.sf_dir}/{name[:-1]}[{name[-1]}].parquet")


class StreamedEvents(StreamedTestbed):
    streamed = ("events",)


_LINES = "move_line WHERE COALESCE(display_type NOT IN ('line_section', 'line_note'), TRUE) AND parent_state <> 'cancel'"


@FAMILY.query("t_a24_daily_totals_stream", sql("move_line", f"""SELECT date, {d("debit", "credit")}, line_count FROM (
    SELECT date, SUM(debit) AS debit, SUM(credit) AS credit, COUNT(*) AS line_count FROM {_LINES} GROUP BY date)"""))
def _(t):
    out, state = fresh_folder(t.spark, "a24"), fresh_folder(t.spark, "a24-state")
    jobs.add_daily_totals(LedgerFilter().apply(StreamedTestbed(t.spark, t.sf_dir).move_line), out, state).awaitTermination()
    return jobs.read_daily_totals(t.spark, out)


@FAMILY.query("t_s6_vehicle_feed_stream", sql("vehicle", _FEED))
def _(t):
    register, state = fresh_folder(t.spark, "s6"), fresh_folder(t.spark, "s6-state")
    jobs.register_feed(_feed(StreamedEvents(t.spark, t.sf_dir)), register, state, _ORDER, t.vehicle).awaitTermination()
    return t.spark.read.schema(jobs.REGISTER_SCHEMA).parquet(register).select(*vehicles.FIELDS)
