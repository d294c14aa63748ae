import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from text_data import awkward, frame

from ledgerlake.llm.packing import TOKENIZER, TextEncoder, WordEncoder, best_fit, encoder, load_tokenizer, pack, plan_runs

PATH = public_tokenizers.path(TOKENIZER)


def test_word_by_word_ids_are_the_tokenizers_own():
    encode, own, r = WordEncoder(PATH, most_bytes=5000), load_tokenizer(PATH), random.Random(5)
    texts = [t or "" for _, t in awkward()] + ["it's, don't. I'LL x,y .. a. b, <|endoftext|>", "H̱ Å ẞ K x y\x1cz\x00", "3.14, 2,5 a1b2", "é ́e"]
    texts += ["".join(r.choice("abAB ,.'s\n\téÉ日1!́ßàÿ÷×\xad") for _ in range(40)) for _ in range(400)]
    for t in texts:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t[:60]


def test_other_tokenizers_encode_whole_texts():
    other = public_tokenizers.path("byte_bpe_50k.json")
    encode, own = encoder(other), load_tokenizer(other)
    assert type(encode) is TextEncoder and type(encoder(PATH)) is WordEncoder
    for t in [t or "" for _, t in awkward()] + ["Two  words. AND\n more", "it's"]:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t[:60]


def check(rows, capacity):
    """Places are gapless and disjoint in every sequence, and no sequence is over-full."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def sequential(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(fit)
            gaps.append(fit - n)
    return len(gaps)


def test_packs_pieces_of_whole_documents(spark):
    rows = awkward()
    got = pack(frame(spark, rows)).collect()
    own, texts = load_tokenizer(PATH), dict(rows)
    check(got, 2048)
    for i, t in texts.items():
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // 2048))) and [r.start for r in parts] == [2048 * k for k in range(len(parts))]
        assert all(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in parts) and sum(r.length for r in parts) == len(ids)
    assert pack(frame(spark, [])).count() == 0


def test_as_few_sequences_as_one_by_one(spark):
    r = random.Random(2)
    for kind in range(4):
        lengths = [r.choice([7, 7, 7, 31]) if kind == 0 else r.randint(1, 100) if kind == 1 else 40 if kind == 2 else r.choice([100, 51, 50, 49, 1]) for _ in range(700)]
        df = spark.createDataFrame([(i // 2, i % 2, n, "x") for i, n in enumerate(lengths)], "doc_id long, piece int, length long, _block string")
        got = best_fit(df.drop("_block") if kind % 2 else df, 100).collect()
        assert sorted(x.length for x in got) == sorted(lengths)
        assert check(got, 100) == sequential(lengths, 100)


def test_plan_covers_every_rank_once():
    r = random.Random(9)
    histogram = {n: r.randint(1, 10**9) for n in range(1, 2049)}
    seen = defaultdict(list)
    for run in plan_runs(histogram, 2048):
        seen[run.length].append((run.rank, run.count))
    for length, runs in seen.items():
        at = 0
        for rank, count in sorted(runs):
            assert rank == at
            at += count
        assert at == histogram[length]
