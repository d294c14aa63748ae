import corpus_pipeline
import pytest
from text_data import awkward, classes, frame
from pyspark.sql import functions as F
from test_packing import check

from ledgerlake.llm.common import settle
from ledgerlake.llm.language_id import held_out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_stages_against_brute_force(spark, tmp_path):
    rows = awkward() + [(500 + i, t) for i, t in awkward()[9:14]]
    docs, columns, sf = frame(spark, rows), frame(spark, rows).columns, str(tmp_path)
    after = []
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf), "stage")
        after.append(docs)
        if len(after) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    lettered = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in after[0].collect()} == set(lettered)
    last = {}
    for i, t in lettered.items():
        last[lower(t)] = max(i, last.get(lower(t), i))
    assert {r.doc_id: r.text for r in after[1].collect()} == {i: lettered[i] for i in last.values()}
    near = classes([(i, lettered[i]) for i in sorted(last.values())])
    kept = {i for i, (_, c) in near.items() if i == c}
    assert {r.doc_id for r in after[2].collect()} == kept
    packed = after[3].collect()
    assert {r.doc_id for r in packed} == kept
    check(packed, 2048)


def test_empty_documents(spark, tmp_path):
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), "stage")
    assert docs.count() == 0


# Nothing to learn from; the label that also stands for unknown; labels in held-out rows only.
@pytest.mark.parametrize("lang", [None, "und", "held out"])
def test_lettered_texts_stay_whatever_was_learned(spark, tmp_path, lang):
    rows = awkward()
    docs = frame(spark, rows, lang)
    if lang == "held out":
        docs = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "en"))
    lettered = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    after = corpus_pipeline.stage_language_id(spark, docs, str(tmp_path))
    assert after.columns == docs.columns and {r.doc_id: r.text for r in after.collect()} == lettered


def run_stage(spark, stage, rows, tmp_path):
    docs = frame(spark, rows)
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_exact_dedup_keeps_one_row_of_each_text(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (2, "A"), (5, "z"), (5, "z"), (None, "a"), (None, "n"), (None, "n"), (6, "b")]
    assert run_stage(spark, corpus_pipeline.stage_exact_dedup, rows, tmp_path) == sorted([(2, "A"), (5, "z"), (None, "n"), (6, "b")], key=str)


def test_ngram_join_keeps_one_row_of_each_group(spark, tmp_path):
    base = awkward()[9][1]
    near, other = base + " tail", "nothing like the others at all"
    rows = [(10, base), (10, near), (10, other), (11, near + " x"), (12, other + " but for this"), (5, "alone"), (5, "alone too")]
    got = run_stage(spark, corpus_pipeline.stage_ngram_join, rows, tmp_path)
    assert sorted((i, t) for i, t in got if t not in (base, near)) == sorted([(10, other), (12, other + " but for this"), (5, "alone"), (5, "alone too")])
    assert len([t for _, t in got if t in (base, near)]) == 1


def test_predictions_fill_in_missing_languages(spark, tmp_path):
    docs = frame(spark, awkward(), "en").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    out = {r.doc_id: r.lang for r in corpus_pipeline.stage_language_id(spark, docs, str(tmp_path)).collect()}
    assert set(out.values()) == {"en"} and any(i % 2 for i in out)
