"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into a cascade: the normaliser (a blank for every space, one in front), the pieces, byte fallback for characters without a piece, and a pair acceptor on the
emitted pieces. The cascade is composed with each input on the fly, and the shortest path in the tropical
semiring (costs add along a path, the least path wins) is the encoding.

Costs: in unigram models a piece costs its negative score, and any pair is free. In merge (BPE) models a
pair of neighbours is free if merging their joint text gives back just that pair, and forbidden otherwise; exactly
one path has a finite cost, since a sequence is what merging produces if and only if each pair of neighbours is.

No arc spans two characters that stand together in no piece. Inputs fall apart there, and the parts' encodings are
remembered.
"""

import codecs
import re
import struct
import zlib
from functools import cache
from math import inf

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Remembered, hand_back, ship, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
# Kinds of pieces and of models, fields of the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PART_BYTES, CHUNK_BYTES = 32 << 20, 192 << 20  # of remembered parts and of chunks between blanks
codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
PAIRS = 700_000


def _fields(raw: bytes):
    """(number, value) of the fields of a serialised message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at:at + size]
            at += size


class Transducer:
    """A compiled model."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.kind, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                self.dummy_prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
                if rules.get(2):
                    raise ValueError("models with a character map of their own are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}
        self.fallback = 10.0 - min(self.scores, default=0.0)  # what a character without a piece costs
        # Pieces by all that they end with: -1 where that is no piece itself.
        self.suffixes = {p[i:]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        # Characters that are neighbours in some piece.
        self.together = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.pairs: dict[int, bool] = {}
        self.parts, self.chunks = Remembered(PART_BYTES), Remembered(CHUNK_BYTES)
        # Blanks start a piece in all usual models; then inputs fall apart before each run of blanks.
        self.splits = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+") if not any(p[1] == BLANK and p[0] != BLANK for p in self.together) else re.compile("(?s).+")
        self.by_words = self.dummy_prefix and self.splits.pattern != "(?s).+"
        self.out = [p.replace(BLANK, " ") if k in (NORMAL, USER, UNUSED) else "" for p, k in zip(self.pieces, self.kinds)]
        if UNKNOWN in self.kinds:
            self.out[self.unknown] = " ⁇ "
        self.byte_of = np.full(len(self.pieces), -1, np.int16)
        for b, i in self.bytes.items():
            self.byte_of[i] = b

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (BLANK if self.dummy_prefix and text else "") + text.replace(" ", BLANK)

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best scored neighbours first, from the left."""
        symbols, rank = list(text), self.rank
        gains = [rank.get(a + b, -inf) for a, b in zip(symbols, symbols[1:])]
        while gains and (best := max(gains)) > -inf:
            at = gains.index(best)
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            gains.pop(at)
            if at:
                gains[at - 1] = rank.get(symbols[at - 1] + symbols[at], -inf)
            if at < len(gains):
                gains[at] = rank.get(symbols[at] + symbols[at + 1], -inf)
        return symbols

    def neighbours(self, left: int, right: int) -> bool:
        """Whether two pieces may follow each other in a merge model."""
        if left < 0 or right < 0:  # characters without a piece are never merged
            return True
        key = left << 32 | right
        good = self.pairs.get(key)
        if good is None:
            a, b = self.pieces[left], self.pieces[right]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            good = self.pairs[key] = self.merged(a + b) == [a, b]
        return good

    def arcs_to(self, text: str, end: int) -> list[tuple[int, int]]:
        """(start, piece or -1 for byte fallback) of the arcs that arrive at a position, longest first."""
        suffixes, found, start = self.suffixes, [], end - 1
        while start >= 0:
            piece = suffixes.get(text[start:end])
            if piece is None:  # nothing that reaches further back is a piece
                break
            if piece >= 0:
                found.append((start, piece))
            start -= 1
        if not found or found[0][0] != end - 1:
            found.insert(0, (end - 1, -1))
        found.reverse()
        return found

    def shortest_path(self, text: str) -> list[tuple[int, str]]:
        """Pieces of the least costly path through the composition.

        A state is a position with its last piece. In a merge model one path only reaches a position at finite cost, so
        there is one state a position, and the first arc found for it settles it.
        """
        cost, start_of, last = [0.0] + [inf] * len(text), [0] * (len(text) + 1), [-1] * (len(text) + 1)
        merging, fallback = self.kind == BPE, self.fallback
        for end in range(1, len(text) + 1):
            for start, piece in self.arcs_to(text, end):
                if merging:
                    if start == 0 or self.neighbours(last[start], piece):
                        start_of[end], last[end] = start, piece
                        break
                else:
                    weight = cost[start] + (-self.scores[piece] if piece >= 0 else fallback)
                    if weight < cost[end]:
                        cost[end], start_of[end], last[end] = weight, start, piece
        out, end = [], len(text)
        while end:
            out.append((last[end], text[start_of[end]:end]))
            end = start_of[end]
        return out[::-1]

    def encode_part(self, text: str) -> bytes:
        ids = []
        for piece, own in self.shortest_path(text):
            ids += [piece] if piece >= 0 else [self.bytes[b] for b in own.encode()] if self.bytes else [self.unknown]
        return np.array(ids, dtype="<u4").tobytes()

    def encode_chunk(self, chunk: str) -> bytes:
        cuts = [0, *[i for i in range(1, len(chunk)) if chunk[i - 1:i + 1] not in self.together], len(chunk)]
        if len(cuts) == 2:
            return self.encode_part(chunk)
        return b"".join(self.parts.get(chunk[a:b], self.encode_part) for a, b in zip(cuts, cuts[1:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.by_words and text and "  " not in text and text[0] != " " != text[-1] and BLANK not in text:
            chunks, find = text.split(" "), self.encode_word  # each stands for itself with the blank in front
        else:
            chunks, find = self.splits.findall(self.normalise(text)), self.encode_chunk
        known = list(map(self.chunks.young.get, chunks))
        if None in known:
            for i in [i for i, ids in enumerate(known) if ids is None]:
                known[i] = self.chunks.get(chunks[i], find)
        return b"".join(known)

    def encode_word(self, word: str) -> bytes:
        return self.encode_chunk(BLANK + word)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transduction; bytes that are no character become U+FFFD each, as the library does."""
        out, own, at = self.out, self.byte_of[ids], 0
        parts: list[str] = []
        marks = np.flatnonzero(own >= 0)
        for run in np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1) if len(marks) else ():
            parts += map(out.__getitem__, ids[at:run[0]].tolist())
            parts.append(bytes(own[run].astype(np.uint8)).decode(errors="each-byte"))
            at = run[-1] + 1
        parts += map(out.__getitem__, ids[at:].tolist())
        text = "".join(parts)
        return text.removeprefix(" ") if self.dummy_prefix else text


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_pieces(docs: DataFrame, text: str = "text", model_path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int), ids_crc32 (little-endian unsigned 32-bit), decoded: the ids of each whole text and what they decode to.

    Null counts as empty and has no ids. Rows that repeat are encoded each; other columns are not read; an empty table gives
    an empty result. Control strings in a text are ordinary text. U+2581 in a text decodes to a space.
    """
    path = model_path or public_tokenizers.path(MODEL)

    def run(batches):
        model = transducer(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):  # ids take more room than texts
                part = batch.slice(start, 500)
                coded = [model.encode(v.as_py() or "") for v in part.column(1)]
                ids = [np.frombuffer(c, dtype="<u4") for c in coded]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))),
                    pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([model.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "ids_crc32", "decoded"])
        hand_back()

    ship(docs.sparkSession)
    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids array<int>, ids_crc32 long, decoded string")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    coded = encode_pieces(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
