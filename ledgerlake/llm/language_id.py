"""Hierarchical language identification: family first, then one-versus-one inside the family.

Features are frequencies of byte pairs and hashed byte triples of the whole lower-cased text. All
deciders are linear support vector machines, trained in one task from a bounded sample of labelled
rows whose features are computed in many; the driver gets the weights. A prediction is a sum of weights over the n-grams of a
text, done for a whole batch at once.
"""

import pickle
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import hand_back, ship, table

# Families of languages by code (fixed values); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["da", "de", "en", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "pl", "ru", "sk", "uk"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS = 15
SAMPLE_PER_LANGUAGE = 1000
SLICE_BYTES = 4 << 20
LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits, such as fractions
UNKNOWN = "und"

# ASCII letters to lower case, other ASCII to blank, bytes of other characters as they are.
FOLD = np.array([i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256)], dtype=np.uint32)


def grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the pair and of the triple that start at each byte."""
    b = FOLD[data]
    mix = np.uint32(2_654_435_761)
    pairs = ((b[:-1] << np.uint32(8)) | b[1:]) * mix >> np.uint32(32 - BITS)
    triples = (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) + np.uint32(97)) * mix >> np.uint32(32 - BITS)
    return pairs, triples + np.uint32(1 << BITS)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lettered(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter; null does not."""
    return np.array([any(m.group().isalpha() for m in LETTER.finditer(v.as_py() or "")) for v in column], dtype=bool)


def features(data: np.ndarray) -> np.ndarray:
    """Frequencies of the n-grams of one text."""
    out = np.zeros(2 << BITS, dtype=np.float64)
    if len(data) >= 2:
        pairs, triples = grams(data)
        out += np.bincount(pairs, minlength=2 << BITS)
        out += np.bincount(triples, minlength=2 << BITS) if len(triples) else 0
        out /= len(data)
    return out


def sparse(dense: np.ndarray) -> tuple[bytes, bytes]:
    """Places and values of the n-grams that occur."""
    at = np.flatnonzero(dense)
    return at.astype(np.int32).tobytes(), dense[at].astype(np.float32).tobytes()


def svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; rows are (indices, values). The bias is a further feature."""
    w, bias, dual = np.zeros(2 << BITS), 0.0, np.zeros(len(rows))
    norms = [float(v @ v) + 1.0 for _, v in rows]
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = signs[i] * (w[at] @ v + bias) - 1
            step = min(max(dual[i] - gradient / norms[i], 0.0), cost) - dual[i]
            if step:
                dual[i] += step
                w[at] += step * signs[i] * v
                bias += step * signs[i]
    return w, bias


class Model:
    """Deciders between families, and between the languages of each family."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, str]):
        self.langs = sorted({s[0] for s in samples})
        self.family = {lang: families.get(lang, lang) for lang in self.langs}
        total, squares = np.zeros(2 << BITS), np.zeros(2 << BITS)
        for _, at, v in samples:
            total[at] += v
            squares[at] += v * v
        n = max(1, len(samples))
        scale = 1 / (np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)) + 1e-3)
        scale /= np.sqrt(max(1.0, float(np.mean([((v * scale[at]) ** 2).sum() for _, at, v in samples] or [1.0]))))
        rows = [(at, v * scale[at]) for _, at, v in samples]
        label = [s[0] for s in samples]
        self.deciders: dict[tuple[str, str], tuple[np.ndarray, float]] = {}
        for group, pairs in ((self.family, combinations(sorted(set(self.family.values())), 2)), ({x: x for x in self.langs}, (
                (a, b) for a, b in combinations(self.langs, 2) if self.family[a] == self.family[b]))):
            for a, b in pairs:
                own = [i for i, x in enumerate(label) if group[x] in (a, b)]
                w, bias = svm([rows[i] for i in own], np.array([1.0 if group[label[i]] == a else -1.0 for i in own]))
                self.deciders[a, b] = ((w * scale).astype(np.float32), bias)

    def votes(self, names: list[str], margins: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``names`` the one with most wins (ties: larger margins) by row, and the confidence in it."""
        if len(names) == 1:
            return np.zeros(n, np.int64), np.ones(n)
        wins, worst = np.zeros((len(names), n)), np.full((len(names), n), np.inf)
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            m = margins[a, b]
            chance = 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
            wins[i] += (m >= 0) + 1e-3 * chance
            wins[j] += (m < 0) + 1e-3 * (1 - chance)
            worst[i], worst[j] = np.minimum(worst[i], chance), np.minimum(worst[j], 1 - chance)
        best = wins.argmax(axis=0)
        return best, worst[best, np.arange(n)]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = byte_view(column)
        n = len(column)
        sums = {k: np.zeros(n) for k in self.deciders}
        first = 0
        while first < n:  # slices of whole texts, so that a batch of long ones stays small in memory
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
            part, at = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            if len(part) >= 2:
                for ids, width in zip(grams(part), (1, 2)):
                    ends = np.maximum(at[1:] - width, at[:-1])
                    for k, (w, _) in self.deciders.items():
                        run = np.zeros(len(ids) + 1)
                        np.cumsum(w[ids], dtype=np.float64, out=run[1:])
                        sums[k][first:last] += run[np.minimum(ends, len(ids))] - run[np.minimum(at[:-1], len(ids))]
            first = last
        lengths = np.maximum(np.diff(offsets), 1)
        margins = {k: sums[k] / lengths + self.deciders[k][1] for k in self.deciders}
        families = sorted(set(self.family.values()))
        lang, score = np.zeros(n, np.int64), np.zeros(n)
        if self.langs:
            family, sure = self.votes(families, margins, n)
            for f, name in enumerate(families):
                own = [x for x in self.langs if self.family[x] == name]
                best, within = self.votes(own, margins, n)
                of = family == f
                lang[of] = np.array([self.langs.index(x) for x in own])[best[of]]
                score[of] = (sure * within)[of]
        known = lettered(column) & bool(self.langs)
        return [self.langs[i] if k else UNKNOWN for i, k in zip(lang, known)], np.where(known, score, 0.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, families: dict[str, str] | None = None) -> Model:
    """Learns from about ``per_language`` documents of each language, drawn by a hash among the rows not held out."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(chance)
    uniform = F.pmod(F.xxhash64(F.lit(31), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def encode(batches):
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            out = [sparse(features(data[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column(0), "at": pa.array([at for at, _ in out], pa.binary()), "v": pa.array([v for _, v in out], pa.binary())})
        hand_back()

    def learn(samples: list[tuple[str, bytes, bytes]]) -> Model:
        return Model([(lang, np.frombuffer(at, np.int32), np.frombuffer(v, np.float32).astype(np.float64)) for lang, at, v in sorted(samples)],
                     FAMILY_OF if families is None else families)

    def train(batches):
        samples = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if samples:
            yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(learn(samples))], pa.binary())})
        samples.clear()
        hand_back()

    ship(docs.sparkSession)
    sample = usable.filter(uniform < chance).select("lang", "text").mapInArrow(encode, "lang string, at binary, v binary")
    model = sample.repartition(1).mapInArrow(train, "model binary").first()
    return learn([]) if model is None else pickle.loads(model["model"])


def language_id(docs: DataFrame, model: Model, text: str = "text", only_lettered: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are replaced).

    Only the text decides, all of it. Null, empty or letterless texts are ``und`` with score 0; so is everything if
    nothing could be learned. Equal texts get equal predictions. An empty table gives an empty result. ``only_lettered``
    leaves out null and letterless texts, whatever was learned.
    """
    docs = docs.drop("lang_pred", "score")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights only: languages times features
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for batch in batches:
            if only_lettered:
                batch = batch.filter(pa.array(lettered(batch.column(place)), pa.bool_()))
            langs, scores = shared.value.predict(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])
        hand_back()

    return docs.mapInArrow(predict, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = language_id(docs.select("doc_id", "text"), fit(docs))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
