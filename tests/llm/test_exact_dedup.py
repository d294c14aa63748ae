import hashlib
from collections import defaultdict

import pytest
from text_data import awkward, frame
from pyspark.sql import functions as F

from ledgerlake.llm.exact_dedup import dedup, sha256


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    return {i: (max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)])) for i, t in rows}


def plain(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_awkward_rows_and_digest(spark):
    rows = awkward()
    got = dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == expected(rows)
    texts = dict(rows)
    assert all(bytes(r.digest) == hashlib.sha256(lower(texts[r.doc_id]).encode()).digest() for r in got)


@pytest.mark.parametrize("files", [1, 3])
def test_state_carries_over_batches(spark, files):
    rows = awkward() * 1 + [(1000 + i, t) for i, t in awkward()]
    assert plain(dedup(frame(spark, rows).repartition(5), files_per_batch=files)) == expected(rows)


def test_bytes_decide_when_digests_collide(spark):
    rows = awkward() + [(300 + i, f"t{i % 40}") for i in range(120)]
    weak = lambda c: F.unhex(F.substring(F.hex(sha256(c)), 1, 2))
    assert plain(dedup(frame(spark, rows), digest=weak)) == expected(rows)


def test_empty_table_and_repeated_rows(spark):
    assert dedup(frame(spark, [])).count() == 0
    got = dedup(frame(spark, [(1, "a"), (2, "A"), (2, "A"), (None, "a"), (None, "z")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 1, True), (0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True)]
