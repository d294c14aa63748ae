"""WARC archives of captured pages, read back, and their capture index.

Writing: payload digests decide, before anything is written, which record of equal payloads is the
response; the others become revisit records. Each task writes one archive through Spark's file writer, so a
repeated task replaces what the lost one had written. Reading: archives are read record by record and parsed;
lengths and digests come from the records' own headers and are checked against the payload.

Index: every archive gives a run of index rows, sorted where it was read. Runs are exchanged by ranges of (URL key,
timestamp, page), and each range merges the sorted pieces that reach it with a loser tree. The result is in
global order: capture histories by URL. A busy URL key is cut by the timestamps in it.
"""

import base64
import hashlib
import re
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import new_folder, settle, ship, table

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
# What lies between two records; a payload that forms it, also with the blank lines around it, is sent in chunks cut inside it.
BETWEEN = END.encode() + VERSION
PAGE = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id long, url_key string, captured string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "archive string, intact boolean")
ORDER = ["url_key", "captured", "page_id"]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_message(payload: bytes) -> bytes:
    """The response with its body; in chunks if the body could be taken for the end of a record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    placed = END.encode() + payload + END.encode()
    if BETWEEN not in placed:
        return head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    cuts = [m.start() + 2 for m in re.finditer(b"(?=" + re.escape(BETWEEN) + b")", placed)]  # after WA of the payload
    chunks = [payload[a:b] for a, b in zip([0, *cuts], [*cuts, len(payload)])]
    return head + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in chunks if c) + b"0\r\n\r\n"


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record without the blank lines that end it."""
    if refers_to is None:
        block, kind = http_message(payload), [("WARC-Type", "response")]
    else:  # the original's header, which tells its length, without the body
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    fields = [*kind, ("WARC-Record-ID", f"<{PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", captured),
              ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def unchunk(body: bytes) -> bytes:
    parts, at = [], 0
    while size := int(body[at:(line := body.index(b"\r\n", at))], 16):
        parts.append(body[line + 2:line + 2 + size])
        at = line + size + 4
    return b"".join(parts)


def url_key(url: str) -> str:
    """The sort key of an address: host labels from the last to the first, then path and query."""
    parts = urlsplit(url)
    host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    return f"{host}{f':{parts.port}' if parts.port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}".lower()


def parse(raw: bytes, archive: str) -> tuple:
    """An index row from one record."""
    raw = raw.removeprefix(VERSION)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda k: int(i) if (i := fields[k].removeprefix(f"<{PAGE}").removesuffix(">")) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        payload = unchunk(body) if http_fields.get("Transfer-Encoding") == "chunked" else body
        length, intact, refers_to = len(payload), digest_of(payload) == digest and len(block) == int(fields["Content-Length"]), None
    else:
        length, intact, refers_to = int(http_fields["Content-Length"]), True, number("WARC-Refers-To")
    try:
        key = url_key(fields["WARC-Target-URI"])
    except ValueError:  # not an address
        key = fields["WARC-Target-URI"]
    return number("WARC-Record-ID"), key, fields["WARC-Date"], kind, refers_to, length, digest, archive, intact


class LoserTree:
    """Merges sorted runs; each step replays one path from a leaf to the root."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for i in reversed(range(self.k)):
            self.replay(i)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # while building: the first to come waits for its opponent
                self.losers[node] = winner
                return
            if self.beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.losers[0]] is not None:
            top = self.losers[0]
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self.replay(top)


def natural_runs(keys: list[tuple]) -> list[range]:
    """The ascending stretches in what reached a task."""
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] < keys[i - 1]], len(keys)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def first_captures(pages: DataFrame, payload: Column, least_bytes: int) -> DataFrame:
    """page_id, sha256, refers_to for the records that repeat a payload; combined in the map tasks, bytes told apart by length and two digests."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(payload).alias("_n"), F.sha1(payload).alias("_sha1"),
                          F.sha2(payload, 256).alias("_sha256")).filter(F.col("_n") >= least_bytes)
    same = ["_n", "_sha1", "_sha256"]
    firsts = narrow.groupBy(*same).agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").drop("_rows")
    return narrow.join(firsts, same).filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to").select("page_id", "_sha256", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, captured: Column | None = None) -> None:
    """Writes a record per row of ``pages`` (page_id, url, html); one gzip file per task."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    when = captured if captured is not None else F.date_format(F.timestamp_seconds(
        F.lit(int(datetime(2024, 1, 1, tzinfo=UTC).timestamp())) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisits = first_captures(pages, payload, least_bytes).select(F.col("page_id").alias("_page"), F.col("_sha256").alias("_same"), "refers_to")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", when.alias("captured"), payload.alias("payload"), F.sha2(payload, 256).alias("_sha256"))
    rows = rows.join(revisits.hint("merge"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha256") == F.col("_same")), "left")

    def build(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": pa.array([record(*r) for r in zip(*(c.to_pylist() for c in batch.columns))], pa.binary())})

    ship(pages.sparkSession)
    rows.select("page_id", "url", "captured", "payload", "refers_to").mapInArrow(build, "value binary").select(
        F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Index rows of all records below ``folder``; each task's rows are sorted: one run per archive."""
    ship(spark)
    raw = spark.read.option("lineSep", BETWEEN.decode()).text(folder).select(F.col("value").cast("binary"), F.col("_metadata.file_name").alias("archive"))

    def index(batches):
        for batch in batches:
            rows = [parse(v.as_py(), a.as_py()) for v, a in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, (
                pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))],
                names=[c.split()[0] for c in INDEX.split(", ")])

    return raw.mapInArrow(index, INDEX).sortWithinPartitions(*ORDER)


RANGE_ROWS = 250_000  # captures that one task merges, about


def merge_index(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Sorted runs to one globally ordered index; as many ranges as keep the merge of one within a task's memory."""
    ranges = ranges or max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def merge(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        sortable = lambda c: [(v is not None, v) for v in rows.column(c).to_pylist()]  # noqa: E731  null first, as Spark sorts
        keys = list(zip(*(sortable(c) if rows.column(c).null_count else rows.column(c).to_pylist() for c in ORDER)))
        order = [i for _, i in LoserTree([[(keys[i], i) for i in run] for run in natural_runs(keys)])]
        yield from rows.take(pa.array(order, pa.int64())).to_batches(max_chunksize=10_000)

    ship(runs.sparkSession)
    return runs.repartitionByRange(ranges, *ORDER).mapInArrow(merge, runs.schema)


def warc_captures(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as WARC archives and returns the merged index read back from them.

    Of equal payloads of at least ``least_bytes`` bytes the smallest ``page_id`` is the response and the others revisit it; rows
    that repeat both page and payload repeat the record. A null html is an empty payload; a null url is an empty address. A
    page without ``page_id`` has a record whose number is empty, read back as null, captured as page 0 is; it revisits an equal page that has
    one, and is a response if there is none. An empty table gives an empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    write_archives(pages, folder, least_bytes)
    return merge_index(settle(read_archives(spark, folder), "capture-runs"))


def checked(captures: DataFrame) -> DataFrame:
    """The captures; a payload that does not match its digest or length is an error."""
    broken = F.raise_error(F.concat(F.lit("record does not match its digest: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without number"))))
    return captures.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(broken))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return checked(warc_captures(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
