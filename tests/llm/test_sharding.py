import zlib
from collections import Counter

import numpy as np
import pytest
from text_data import SF, awkward, frame

from ledgerlake.llm.sharding import communication_matrix, hypergeometric, op6_sharding, shuffle_into_shards


def slots(df, shards):
    rows = df.collect()
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in by.values())
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    return rows


@pytest.mark.parametrize(("n", "shards", "parts"), [(1, 4, 3), (103, 16, 7), (1000, 3, 50), (64, 16, 1)])
def test_shards_are_even_and_gapless(spark, n, shards, parts):
    rows = slots(shuffle_into_shards(spark.range(n), "id", shards, partitions=parts), shards)
    assert sorted(r.id for r in rows) == list(range(n))


def test_repeated_null_and_clashing(spark):
    rows = awkward() + [(7, "again")] * 40 + [(None, None)] * 5
    got = slots(shuffle_into_shards(frame(spark, rows).withColumnRenamed("n", "shard").withColumnRenamed("rep", "slot"), "doc_id", 4), 4)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert shuffle_into_shards(frame(spark, []), "doc_id", 4).count() == 0


def test_places_do_not_depend_on_the_order_of_arrival(spark):
    rows = [(i, f"t{i}") for i in range(300)] + [(7, f"again {i}") for i in range(50)] + [(None, f"none {i}") for i in range(50)]
    place = lambda r, n: sorted((str(x.doc_id), x.text, x.shard, x.slot) for x in shuffle_into_shards(frame(spark, r).repartition(n), "doc_id", 4).collect())
    assert place(rows, 1) == place(rows[::-1], 5)


def test_query_against_plain_sizes(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = slots(op6_sharding(spark, SF), 16)
    assert len(got) == len(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_rows_are_spread_as_if_drawn(spark):
    """Over seeds, each row is in each shard about equally often, and neighbours are independent."""
    seen, same = np.zeros((24, 3)), 0
    for seed in range(30):
        place = {r.id: r.shard for r in shuffle_into_shards(spark.range(24), "id", 3, seed, partitions=4).collect()}
        for i, s in place.items():
            seen[i, s] += 1
        same += sum(place[i] == place[i + 1] for i in range(0, 24, 2))
    assert ((seen - 10) ** 2 / 10).sum() < 110  # 48 degrees of freedom
    assert abs(same / 360 - 7 / 23) < 0.1


def test_matrix_sums_and_law():
    m = np.array(communication_matrix([5, 0, 900, 95], [300, 301, 399], 1))
    assert m.sum(axis=1).tolist() == [5, 0, 900, 95] and m.sum(axis=0).tolist() == [300, 301, 399]
    rng = np.random.default_rng(3)
    draws = [hypergeometric(rng, 40, 100, 30) for _ in range(4000)]
    assert abs(np.mean(draws) - 12) < 0.15 and abs(np.var(draws) - 30 * .4 * .6 * 70 / 99) < 0.4
    assert abs(hypergeometric(rng, 10**11, 10**12, 10**9) - 10**8) < 10**5
