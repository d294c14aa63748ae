import math

import numpy as np
from text_data import SF, awkward, frame

from ledgerlake.llm import language_id as module
from ledgerlake.llm.language_id import Model, fit, grams, held_out, language_id, op4_language_id


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in op4_language_id(spark, sf).collect()]
    unseen = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(unseen) > 200
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) / len(unseen) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_numbers_are_no_letters(spark):
    model = fit(frame(spark, awkward(), "xx"))
    rows = [(1, "½ ² ①"), (2, "Ⅷ"), (3, "½ a"), (4, "٣_"), (5, "日"), (6, "9" * 10_000 + "é")]
    assert {r.doc_id: r.lang_pred for r in language_id(frame(spark, rows), model).collect()} == dict(zip(range(1, 7), ["und", "und", "xx", "und", "xx", "xx"]))
    assert {r.doc_id for r in language_id(frame(spark, rows), model, only_lettered=True).collect()} == {3, 5, 6}


def brute(model, text):
    """Votes over the same weights, one n-gram after the other."""
    data = np.frombuffer(text.encode(), np.uint8)
    margin = {k: bias + sum(float(w[g]) for ids in grams(data) for g in ids) / max(1, len(data)) for k, (w, bias) in model.deciders.items()}

    def winner(names):
        wins = {}
        for i, a in enumerate(names):
            for b in names[i + 1:]:
                chance = 1 / (1 + math.exp(-4 * margin[a, b]))
                wins[a] = wins.get(a, 0) + (margin[a, b] >= 0) + 1e-3 * chance
                wins[b] = wins.get(b, 0) + (margin[a, b] < 0) + 1e-3 * (1 - chance)
        return max(names, key=lambda n: wins.get(n, 0))

    family = winner(sorted(set(model.family.values())))
    return winner([x for x in model.langs if model.family[x] == family])


def test_votes_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.text and 3 <= len(r.text) < 3000 and any(c.isalpha() for c in r.text)}
    got = {r.doc_id: r.lang_pred for r in language_id(docs.select("doc_id", "text"), model).collect()}
    assert len(texts) > 50 and all(got[i] == brute(model, t) for i, t in texts.items())


def test_only_the_text_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs)
    rows = awkward()
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id(frame(spark, rows, "fr"), model).collect()}
    b = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id(frame(spark, rows, None).repartition(3), model).collect()}
    assert a == b and a[16] == a[17] == a[18]
    assert all(a[i] == ("und", 0.0) for i in (1, 2, 3, 19)) and a[10][0] != "und"
    out = language_id(frame(spark, rows), model)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns[-2:] == ["lang_pred", "score"]


def test_nothing_to_learn_from_and_empty_tables(spark):
    model = fit(frame(spark, awkward(), None))
    assert isinstance(model, Model) and {r.lang_pred for r in language_id(frame(spark, awkward()), model).collect()} == {"und"}
    assert language_id(frame(spark, []), model).count() == 0
    one = fit(frame(spark, awkward(), "xx"))
    assert {r.lang_pred for r in language_id(frame(spark, awkward()), one).collect()} == {"und", "xx"}


def test_held_out_rows_follow_the_checksum(spark):
    import zlib

    from pyspark.sql import functions as F
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_the_driver_gets_weights_and_no_sample(spark, monkeypatch):
    """Training is a task: what the driver would need for it is out of its reach here."""
    def refuse(*_):
        raise AssertionError("trained on the driver")

    monkeypatch.setattr(module, "svm", refuse)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert fit(docs, per_language=20).deciders
