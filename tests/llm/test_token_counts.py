from collections import Counter

import public_tokenizers
from text_data import awkward, frame

from ledgerlake.llm.token_counts import RANKS, encoder, length_histogram, length_report, truncated_totals


def test_report_against_plain_counting(spark):
    rows = awkward() + [(400, "</s> <|endoftext|> \x00")]
    encode = encoder(public_tokenizers.path(RANKS), public_tokenizers.PATTERN).encode_ordinary
    lengths = [len(encode(t)) if t else 0 for _, t in rows]
    histogram = length_histogram(frame(spark, rows))
    assert {r.length: r.n_docs for r in histogram.collect()} == Counter(lengths)
    for r in length_report(histogram).collect():
        longer = [n for n in lengths if n >= r.length]
        assert (r.n_docs_from, r.n_tokens_from, r.n_cut) == (len(longer), sum(longer), sum(n > r.length for n in lengths))
        assert r.truncated_total == sum(min(n, r.length) for n in lengths)
        assert abs(r.quantile - sum(n <= r.length for n in lengths) / len(lengths)) < 1e-12
    limits = [0, 1, 7, 1000, 10**6]
    assert {r.limit_tokens: (r.total, r.n_cut) for r in truncated_totals(histogram, limits).collect()} == {
        c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in limits}


def test_empty_table(spark):
    histogram = length_histogram(frame(spark, []))
    assert length_report(histogram).count() == 0
    assert [(r.total, r.n_cut) for r in truncated_totals(histogram, [5]).collect()] == [(0, 0)]
