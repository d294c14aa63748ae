import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from text_data import awkward, frame

from ledgerlake.llm.sentence_pieces import MODEL, UNIGRAM, Transducer, encode_pieces

PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_texts_are_the_librarys(library):
    model, r = Transducer(PATH), random.Random(3)
    texts = [t or "" for _, t in awkward()] + ["▁x", "</s> <s> <unk> <0x41>", "\xa0x", " " * 40 + "x" + " " * 23, "a" * 300, "é日本𝔘\x00🙂", "�", "ﬁ\r\n"]
    texts += ["".join(r.choice("abcdehinorst  .,-=\n_(){}0123éüñ日本▁🙂") for _ in range(r.randint(1, 60))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t)
        assert np.frombuffer(model.encode(t), "<u4").tolist() == ids, t[:60]
        assert model.decode(np.array(ids, "<u4")) == library.decode(ids), t[:60]
    for _ in range(300):  # any ids, broken characters among them
        ids = [r.randrange(len(model.pieces)) if r.random() < .5 else r.randrange(3, 259) for _ in range(8)]
        assert model.decode(np.array([i for i in ids if i > 2], "<u4")) == library.decode([i for i in ids if i > 2])


def test_least_cost_wins_in_unigram_models():
    model = Transducer(PATH)
    model.kind, names = UNIGRAM, ["▁", "a", "b", "ab", "▁a"]
    for name, score in zip(names, [-2.0, -3.0, -3.0, -3.5, -4.0]):
        model.scores[model.ids[name]] = score
    assert [model.pieces[i] for i in np.frombuffer(model.encode("ab"), "<u4")] == ["▁", "ab"]


def test_frame(spark, library):
    rows = awkward()
    got = {r.doc_id: r for r in encode_pieces(frame(spark, rows)).collect()}
    for i, t in rows:
        ids = np.array(library.encode(t or ""), "<u4")
        assert (got[i].ids, got[i].ids_crc32) == (ids.tolist(), zlib.crc32(ids.tobytes()))
        assert got[i].decoded == (t or "")
    assert encode_pieces(frame(spark, [])).count() == 0
