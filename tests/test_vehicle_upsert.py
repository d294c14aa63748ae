"""Keyed vehicle import against a loop over its records."""

import random

import pytest
from ledger_helpers import rows

from ledgerlake.sources.vehicles import FIELDS, upsert_counts, upsert_vehicles

REGISTER = "id long, car_id string, vin_sn string, title_en string"
RECORDS = "seq long, car_id string, vin_sn string, title_en string"


def one_by_one(register, records):
    """(id, fields, action, records) after applying every record to the register left by the one before."""
    table = [dict(zip(("id", *FIELDS), r), n=0, new=False) for r in sorted(register)]
    for record in sorted(records):
        given = {f: v for f, v in zip(FIELDS, record[1:]) if v}
        if not given:
            continue
        key = next(f for f in ("vin_sn", "title_en", "car_id") if f in given)
        match = next((r for r in table if r[key] == given[key]), None)
        if match is None:
            match = dict.fromkeys(FIELDS) | {"id": None, "n": 0, "new": True}
            table.append(match)
        match.update(given, n=match["n"] + 1)
    return [(r["id"], *(r[f] for f in FIELDS), "created" if r["new"] else "updated" if r["n"] else "kept", r["n"]) for r in table]


def same(spark, register, records):
    got = upsert_vehicles(spark.createDataFrame(register, REGISTER), spark.createDataFrame(records, RECORDS), "seq")
    want = one_by_one(register, records)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    counts = dict(rows(upsert_counts(got)))
    assert counts == {"created": sum(r[4] == "created" for r in want), "updated": sum(r[5] for r in want) - sum(r[4] == "created" for r in want),
                      "kept": sum(r[4] == "kept" for r in want)}


def test_records_see_earlier_ones(spark):
    same(spark, [(1, "C1", "V1", "T1")], [(1, "C1", "V1", "T2"), (2, "C9", None, "T2"), (3, "C3", "V3", "T3"), (4, "C4", None, "T3")])


def test_a_title_that_comes_and_goes(spark):
    moves = [(n, None, "V1", f"T{n % 3}") for n in range(10, 60, 10)] + [(n + 5, f"C{n}", None, "T1") for n in range(0, 60, 10)]
    same(spark, [(7, "C", "V1", "T1"), (9, "D", "V2", "T1")], moves + [(100, "C20", None, None), (101, "nowhere", None, None), (102, "nowhere", "", " ")])


def test_empty_sides(spark):
    register = [(1, "C1", "", None), (2, None, None, "T")]
    same(spark, register, [])
    same(spark, [], [(1, "C1", None, None), (2, None, None, None), (3, "C1", "V", None), (4, "C1", None, None)])


@pytest.mark.parametrize("seed, keys, register, records", [(1, 4, 12, 150), (2, 12, 30, 300), (3, 1, 3, 60)])
def test_random_chains(spark, seed, keys, register, records):
    r = random.Random(seed)
    some = lambda kind, share: f"{kind}{r.randrange(keys)}" if r.random() < share else None
    old = [(10 + i, some("C", .9), some("V", .8), some("T", .9)) for i in range(register)]
    new = [(100 + 3 * i, some("C", .7), some("V", .4), some("T", .6)) for i in range(records)]
    same(spark, old, new)
