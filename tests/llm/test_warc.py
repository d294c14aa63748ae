import base64
import gzip
import hashlib
import random

from ledgerlake.llm.common import new_folder
from ledgerlake.llm.warc import BETWEEN, LoserTree, digest_of, http_message, merge_index, natural_runs, parse, read_archives, record, unchunk, warc_captures, write_archives

TRAP = "a\r\n\r\nWARC/1.1\r\nb\r\n\r\nWARC/1.1\r\n"
SCHEMA = "page_id long, url string, html string, captured string, archive int, value string"
ROWS = [(1, "http://www.b.com/x?q=1", TRAP), (2, None, None), (3, "bad\r\nurl é", "é<p>"), (4, "http://[::1", TRAP), (5, "x", ""), (6, "http://a.b.com:8080/", "p" * 300_000),
        (7, "http://b.com/x?q=1", "same"), (8, "http://b.com/x?q=1", "same"), (9, "http://b.com/a", "\r\n\r\n"), (10, "http://b.com/", "tail\r\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "v") for r in rows], SCHEMA)


def test_capture_rows(spark):
    got = {r.page_id: r for r in warc_captures(frame(spark, ROWS).repartition(3)).collect()}
    first = {}
    for i, _, h in ROWS:
        payload = (h or "").encode()
        r, original = got[i], first.setdefault(payload, i)
        assert r.intact and (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if original == i else ("revisit", original))
    assert got[1].url_key == got[7].url_key.removeprefix("www.") == "com,b)/x?q=1"


def test_small_payloads_may_stay_responses(spark):
    got = {r.page_id: r.record_type for r in warc_captures(frame(spark, ROWS), least_bytes=5).collect()}
    assert got[5] == got[8] == "response" and got[4] == "revisit"


def test_repeated_rows_and_empty_table(spark):
    got = sorted((r.page_id, r.record_type) for r in warc_captures(frame(spark, [ROWS[6], ROWS[6], ROWS[7]])).collect())
    assert got == [(7, "response"), (7, "response"), (8, "revisit")]
    assert warc_captures(frame(spark, [])).count() == 0


def test_index_is_in_global_order(spark):
    rows = [(i, f"http://h{i % 3}.org/{i % 7}", f"page {i}") for i in range(400)]
    folder = new_folder(spark, "warc-test")
    write_archives(frame(spark, rows).repartition(6), folder)
    index = merge_index(read_archives(spark, folder), 5).select("url_key", "captured", "page_id").collect()
    assert len(index) == 400 and [tuple(r) for r in index] == sorted(tuple(r) for r in index)


def test_files_are_plain_archives(spark, tmp_path):
    write_archives(frame(spark, ROWS).coalesce(1), str(tmp_path / "w"))
    [name] = (tmp_path / "w").glob("part-*.gz")
    raw, n = gzip.decompress(name.read_bytes()), 0
    while raw:  # record after record by the lengths in the headers
        head, _, rest = raw.partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
        assert head.startswith(b"WARC/1.1") and rest[size:size + 4] == b"\r\n\r\n"
        raw, n = rest[size + 4:], n + 1
    assert n == len(ROWS)


def test_chunks_hide_the_record_separator():
    payload = BETWEEN * 3 + b"x" + BETWEEN
    message = http_message(payload)
    assert BETWEEN not in message and unchunk(message.partition(b"\r\n\r\n")[2]) == payload
    row = parse(record(5, "http://a/", "t", payload, None), "f")
    assert row[5] == len(payload) and row[-1]


# The separator arises across the payload's borders: with the blank line before it, with the one after it, with both.
BORDERS = ["WARC/1.1\r\nx", "\r\nWARC/1.1\r\nx", "x\r\n\r\nWARC/1.1", "WARC/1.1", "\r\n\r\nWARC/1.1", "WARC/1.1\r\n\r\nWARC/1.1", "\r\nWARC/1.1\r\nb\r\n\r\nWARC/1.1"]


def test_separator_across_the_borders_of_a_payload(spark):
    for payload in (b.encode() for b in BORDERS):
        raw = record(5, "http://a/", "t", payload, None) + b"\r\n\r\n"
        assert BETWEEN not in raw and unchunk(http_message(payload).partition(b"\r\n\r\n")[2]) == payload
    rows = [(i, "http://a.b/", h) for i, h in enumerate(BORDERS + ["last"])]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.intact) for r in warc_captures(frame(spark, rows).coalesce(1)).collect()}
    assert got == {i: (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response", True) for i, _, h in rows}


def test_pages_without_number(spark):
    rows = [(None, "http://a/", "one"), (None, "http://a/", "two"), (None, "http://a/", "two"), (3, "http://a/", "one"), (4, "http://a/", "one"), (0, "http://a/", "zero")]
    got = warc_captures(frame(spark, rows).repartition(3)).collect()
    expected = [(-1, b"one", "revisit", 3), (-1, b"two", "response", -1), (-1, b"two", "response", -1), (0, b"zero", "response", -1), (3, b"one", "response", -1), (4, b"one", "revisit", 3)]
    told = lambda i: -1 if i is None else i
    assert sorted((told(r.page_id), r.payload_digest, r.record_type, told(r.refers_to), r.intact) for r in got) == sorted(
        (i, digest_of(h), kind, to, True) for i, h, kind, to in expected)


def test_loser_tree_merges_any_runs():
    r = random.Random(1)
    for k in range(12):
        runs = [sorted(r.randint(0, 30) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for run in runs for x in run)
    keys = [3, 4, 4, 1, 2, 2, 0]
    assert [[keys[i] for i in run] for run in natural_runs(keys)] == [[3, 4, 4], [1, 2, 2], [0]] and natural_runs([]) == []
