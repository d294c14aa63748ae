"""Bank statement files: CSV, OFX and QIF.

Readers give one row per record, split by Spark while reading, so that a large file is not held in
one task. Parsers turn record text into statement lines; a line that cannot be taken over keeps its
``reject_reason`` instead of stopping the import.
"""

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.functions.prefix import block, running_totals
from ledgerlake.operators.ledger import MONEY

# Record ends of the transaction formats.
OFX_END, QIF_END = "</STMTTRN>", "^"


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Lines of statement CSV files as (value), without the heading of each file."""
    return spark.read.csv(path, schema="value string", sep="\u0001", quote="", header=True)


def with_place(records: DataFrame) -> DataFrame:
    """Adds where each record of a text file lies: its file, where the split that it was read in begins, and its number in that task."""
    return records.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                          F.monotonically_increasing_id().alias("row"))


def read_ofx_records(spark: SparkSession, path: str) -> DataFrame:
    """Transaction blocks of OFX files as (value, file, split, row), the last three in file order."""
    return with_place(spark.read.text(path, lineSep=OFX_END))


def read_qif_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of QIF files as (value)."""
    return spark.read.text(path, lineSep=QIF_END)


def _by_name(partners: DataFrame) -> DataFrame:
    return partners.groupBy(F.col("name").alias("partner_name")).agg(F.min("id").alias("partner_id"))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def parse_csv(records: DataFrame, partners: DataFrame, today: date) -> DataFrame:
    """Statement lines of CSV records: name, amount, amount in currency, date, partner.

    An empty date means today; an empty partner is allowed, an unknown one is not.
    """
    v = F.split(F.regexp_replace("value", "\r$", ""), ",")
    rows = records.select(
        F.size(v).alias("_n"), *[F.get(v, F.lit(i)).alias(n) for i, n in enumerate(("name", "_amount", "_currency", "_date", "partner_name"))])
    rows = rows.join(_by_name(partners), "partner_name", "left")
    reason = (F.when(F.col("_n") < 5, "invalid row format").when(_blank(F.col("name")), "account name missing").when(_blank(F.col("_amount")), "amount missing")
              .when(~_blank(F.col("partner_name")) & F.col("partner_id").isNull(), "partner unknown"))
    day = F.when(_blank(F.col("_date")), F.lit(today)).otherwise(F.expr("try_to_date(_date, 'yyyy-MM-dd')"))
    amount = F.col("_amount").try_cast(MONEY)
    reason = F.coalesce(reason, F.when(amount.isNull(), "amount not a number"), F.when(day.isNull(), "date not a date"))
    return rows.select("name", amount.alias("amount"), F.col("_currency").try_cast(MONEY).alias("amount_currency"), day.alias("date"), "partner_id",
                       F.lit("csv file").alias("payment_ref"), reason.alias("reject_reason"))


# Character references of the format; the ampersand itself comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def _tag(name: str) -> Column:
    text = F.regexp_extract("value", f"<{name}>([^<\r\n]*)", 1)
    return F.trim(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text))


def parse_ofx(records: DataFrame, partners: DataFrame, today: date) -> DataFrame:
    """Debit and credit transactions of OFX blocks with an amount other than zero (S3).

    The account number is that of the statement, the last heading before the transaction in file order, whichever split it was read in.
    An amount that is no number or a date that is none is kept with a reason.
    """
    last = F.regexp_extract("value", r"(?s).*<BANKID>([^<\r\n]*)", 1)
    heading = F.when(F.col("value").contains("<BANKID>"), F.struct("split", "row", F.trim(last).alias("name")))
    rows = running_totals(records, ["file"], [F.col("split"), F.col("row")], {"_heading": heading}, {"split": F.col("split")}, {"rows": block("row", 4096)}, how="max")
    rows = rows.filter(F.col("value").contains("<STMTTRN>"))
    posted = F.substring(_tag("DTPOSTED"), 1, 8)
    rows = rows.select(F.col("_heading.name").alias("name"), F.lower(_tag("TRNTYPE")).alias("kind"), _tag("TRNAMT").try_cast(MONEY).alias("amount"), posted.alias("_d"), _tag("NAME").alias("partner_name"))
    rows = rows.withColumn("date", F.when(F.col("_d") == "", F.lit(today)).otherwise(F.expr("try_to_date(_d, 'yyyyMMdd')")))
    rows = rows.filter(F.col("kind").isin("debit", "credit") & F.coalesce(F.col("amount") != 0, F.lit(True)))
    rows = rows.join(_by_name(partners), "partner_name", "left")
    return rows.select("name", "amount", "date", "partner_id", "partner_name", F.lit("ofx file").alias("payment_ref"),
                       F.when(F.col("amount").isNull(), "amount not a number").when(F.col("date").isNull(), "date not a date")
                       .when(F.col("partner_id").isNull(), "partner unknown").alias("reject_reason"))


def _line(letter: str) -> Column:
    return F.trim(F.regexp_extract("value", f"(?m)^{letter}(.*)$", 1))


def parse_qif(records: DataFrame, partners: DataFrame, today: date) -> DataFrame:
    """Lines of QIF records from their date, amount and payee.

    A record without amount or payee, or with an amount or date that cannot be read, is kept with a reason; amounts of zero are left out.
    """
    rows = records.select(F.regexp_replace("value", "\r", "").alias("value")).filter(F.trim(F.regexp_replace("value", "\n", "")) != "")
    rows = rows.select(_line("D").alias("_d"), _line("T").alias("_t"), _line("P").alias("partner_name")).filter(F.concat("_d", "_t", "partner_name") != "")
    rows = rows.withColumn("amount", F.col("_t").try_cast(MONEY)).filter(F.coalesce(F.col("amount") != 0, F.lit(True)))
    rows = rows.join(_by_name(partners), "partner_name", "left")
    day = F.when(F.col("_d") == "", F.lit(today)).otherwise(F.expr("try_to_date(_d, 'dd/MM/yyyy')"))
    return rows.select("amount", day.alias("date"), "partner_id", "partner_name", F.lit("qif file").alias("payment_ref"),
                       F.when(F.col("_t") == "", "amount missing").when(F.col("amount").isNull(), "amount not a number").when(day.isNull(), "date not a date")
                       .when(F.col("partner_name") == "", "payee missing").when(F.col("partner_id").isNull(), "partner unknown").alias("reject_reason"))
