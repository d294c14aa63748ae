"""N-gram Jaccard join: exact similarity join of shingle sets by universe partitioning.

Sets x and y with Jaccard similarity t or more differ in at most H = (|x| + |y|)(1 - t)/(1 + t) shingles. The universe
of shingles is hashed into m segments, m by the band of the set's size (powers of two). If a set spends
budgets v of 0, 1 or 2 on its segments with a sum over H, then every partner agrees in some segment up to v - 1
shingles: a segment of budget 1 must be equal, one of budget 2 equal up to one shingle, which the
one-deletion neighbourhoods find. Every set is indexed in its own band; the larger set of a pair probes its own band
and the one below.

Budgets are allocated by cost. All segments of a set are looked up, and only those whose subset also occurs in another
set come back, with their number of index entries. Their dearest units are given up, as many as the
set can spare; subsets that occur nowhere else cost nothing. So a passage that many unlike
documents share is given up by nearly all of them before a pair is formed.

Empty segments agree between any two sets and are not indexed. A set that cannot reach its budget without
them is found by its negative spare count, and its band is run once more with the empty segments.

Documents with the same word sequence are one class and meet once. In a few rounds every set is paired with one hub only,
the pairs are verified, and what is linked becomes one component; keys within one component are closed. Then all pairs that
remain between different components are verified. Pairs inside a component are not needed and not formed.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import large_batches, settle, ship, table
from ledgerlake.llm.components import components
from ledgerlake.llm.shingles import SHINGLE, exact_overlap, folded, least_difference, mix, parities, sequence_digest, shingle_set

SIMILARITY = (75, 100)
# Segments of a band: this many percent of the most that a set may need, and so many at least.
SEGMENTS = (108, 64)
SLICE_SHINGLES = 1_000_000
CLASS_BITS = 60
HUB_ROUNDS = 3
BLOCK_ENTRIES = 1024
# Kinds of signature rows: entries of the own band (also probes of budget 1), one-deletion entries, probes of budget 2 in the own
# band, probes of budget 1 and 2 in the band below, and what a set can spare in either band.
ENTRY, ENTRY_DELETED, PROBE2, LOW1, LOW2, SPARE, LOW_SPARE = range(7)
SIGNATURES = "key long, who long, unit int"

U = np.uint64


def bound(sizes, similarity: tuple[int, int]):
    """Most shingles in which a pair with this sum of sizes may differ."""
    num, den = similarity
    return sizes * (den - num) // (den + num)


def segments(band: int, similarity: tuple[int, int], plenty: tuple[int, int]) -> int:
    """Number of segments of a band: some more than the largest number of differences, so that some can be spared."""
    num, den = similarity
    percent, least = plenty
    return max(least, -(-(percent * (den - num) << (band + 1)) // (100 * num)))


def deletion_segments(m: int) -> int:
    """The first of the segments are indexed with one-deletion neighbourhoods."""
    return max(4, m // 64)


def class_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - CLASS_BITS)


def signature_rows(sets: list[np.ndarray], classes: np.ndarray, similarity: tuple[int, int], opened: frozenset[int] | None,
                   plenty: tuple[int, int] = SEGMENTS) -> list[tuple]:
    """(key, who, unit) arrays for the sets of a slice.

    ``opened`` None: the usual run. Else only these bands, with budget 1 on every segment, empty ones included.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    num, den = similarity
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    own_band = np.array([int(n).bit_length() - 1 for n in sizes], dtype=np.int64)
    least = -(-sizes * num // den)

    def emit(key: np.ndarray, doc: np.ndarray, kind: int, unit) -> None:
        out.append((key.astype(np.int64) if key.dtype != np.uint64 else key.view(np.int64), (classes[doc] << 3) | kind,
                    np.broadcast_to(np.asarray(unit, dtype=np.int32), key.shape)))

    for low in (False, True):
        bands = own_band - low
        # The band below is probed by sets that may have a partner in it.
        chosen = np.flatnonzero((bands >= 0) & ((least < (1 << np.maximum(own_band, 0))) if low else True))
        for band in np.unique(bands[chosen]):
            if opened is not None and int(band) not in opened:
                continue
            docs = chosen[bands[chosen] == band]
            m = segments(int(band), similarity, plenty)
            salt = mix(np.array([int(band)], U) + U(0x5EED))[0]
            tokens = np.concatenate([sets[d] for d in docs])
            at = np.repeat(np.arange(len(docs)), sizes[docs])
            scrambled = mix(tokens ^ salt)
            seg = ((scrambled >> U(33)).astype(np.int64)) % m
            order = np.argsort(at * m + seg, kind="stable")
            place, weight = (at * m + seg)[order], scrambled[order] * U(0xD6E8FEB86659FD93)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            count = np.diff(np.append(first, len(place)))
            total = np.add.reduceat(weight, first)
            doc, segment = docs[place[first] // m], place[first] % m
            tag = lambda sums, segs, deleted: mix(sums ^ mix(segs.astype(U) * U(2) + U(deleted) + salt))
            if opened is not None:
                full = np.zeros((len(docs), m), U)
                full[place[first] // m, place[first] % m] = total
                key = tag(full.ravel(), np.tile(np.arange(m), len(docs)), 0)
                emit(key, np.repeat(docs, m), LOW1 if low else ENTRY, -1)
                need = bound(sizes[docs] + np.minimum(sizes[docs], (2 << int(band)) - 1), similarity) + 1
                emit(classes[docs], docs, LOW_SPARE if low else SPARE, m - need)
                continue
            double = (segment < deletion_segments(m)) & (count >= 2)
            emit(tag(total, segment, 0), doc, LOW1 if low else ENTRY, np.where(double, segment, -1))
            # One-deletion neighbourhoods of the segments that may get budget 2.
            token_of = np.repeat(np.arange(len(first)), count)
            part = double[token_of]
            shorter, whose = (total[token_of] - weight)[part], token_of[part]
            emit(tag(shorter, segment[whose], 0), doc[whose], LOW2 if low else PROBE2, segment[whose])
            emit(tag(total[double], segment[double], 1), doc[double], LOW2 if low else PROBE2, segment[double])
            if not low:
                longer = count[whose] >= 3
                emit(tag(shorter[longer], segment[whose][longer], 1), doc[whose][longer], ENTRY_DELETED, -1)
            units = np.bincount(place[first] // m, minlength=len(docs)) + np.bincount(place[first][double] // m, minlength=len(docs))
            need = bound(sizes[docs] + np.minimum(sizes[docs], (2 << int(band)) - 1), similarity) + 1
            emit(classes[docs], docs, LOW_SPARE if low else SPARE, units - need)
    return out


def signatures(docs: DataFrame, text: str, width: int, similarity: tuple[int, int], opened: frozenset[int] | None = None,
               plenty: tuple[int, int] = SEGMENTS) -> DataFrame:
    """Signature rows of all documents; copies within a task are told once."""
    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            sets, classes, held = [], [], 0

            def flush():
                for key, who, unit in signature_rows(sets, np.array(classes, np.int64), similarity, opened, plenty) if sets else ():
                    for i in range(0, len(key), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[i:i + 200_000])) for c in (key, who, unit)], names=["key", "who", "unit"])

            for value in batch.column(0).cast(pa.large_binary()):
                raw = value.as_py() or b""
                cls = class_of(sequence_digest(raw))
                if cls in seen or not len(own := shingle_set(raw, width)):
                    continue
                seen.add(cls)
                sets.append(own)
                classes.append(cls)
                held += len(own)
                if held > SLICE_SHINGLES:
                    yield from flush()
                    sets, classes, held = [], [], 0
            yield from flush()

    ship(docs.sparkSession)
    return docs.select(text).mapInArrow(sign, SIGNATURES)


def shared_rows(rows: DataFrame) -> DataFrame:
    """Rows whose key is an entry of one class and a row of another, each once, with ``cost``, the number of entries; and all spare counts.

    Keys arrive sorted, so a task holds one key's rows at a time besides the batch. Copies in other tasks told the same rows; they go here, where all
    rows of a key meet.
    """
    def shared(batches):
        rest = [np.zeros(0, np.int64)] * 3

        def keep(key, who, unit):
            if not len(key):
                return None
            cls, spare = who >> 3, (who & 7) >= SPARE
            entry = ((who & 7) == ENTRY) | ((who & 7) == ENTRY_DELETED)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            mixed = np.minimum.reduceat(np.where(spare, 2**62, cls), starts) < np.maximum.reduceat(np.where(spare, -1, cls), starts)
            kept = np.repeat(mixed & np.logical_or.reduceat(entry, starts), np.diff(np.append(starts, len(key)))) | spare
            key, who, unit, entry = key[kept], who[kept], unit[kept], entry[kept]
            if not len(key):
                return None
            order = np.lexsort((unit, who, key))
            key, who, unit, entry = key[order], who[order], unit[order], entry[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1]) | (unit[1:] != unit[:-1])])
            key, who, unit, entry = key[once], who[once], unit[once], entry[once]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cost = np.repeat(np.add.reduceat(entry.astype(np.int64), starts), np.diff(np.append(starts, len(key))))
            return pa.RecordBatch.from_pydict({
                "key": pa.array(key), "cls": pa.array(who >> 3), "kind": pa.array((who & 7).astype(np.int32)), "unit": pa.array(unit.astype(np.int32)),
                "cost": pa.array(cost)})

        for batch in batches:
            parts = [np.concatenate([r, c.to_numpy().astype(np.int64)]) for r, c in zip(rest, batch.columns)]
            cut = int(np.searchsorted(parts[0], parts[0][-1], side="left")) if len(parts[0]) else 0
            if out := keep(*(p[:cut] for p in parts)):
                yield out
            rest = [p[cut:] for p in parts]
        if out := keep(*rest):
            yield out

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, cls long, kind int, unit int, cost long")


def probes_of(shared: DataFrame) -> DataFrame:
    """key, cls of the probes that the cheapest allocation of budgets makes."""
    kind = F.col("kind")
    low = kind.isin(LOW1, LOW2, LOW_SPARE)
    spare = shared.filter(kind.isin(SPARE, LOW_SPARE)).groupBy("cls", low.alias("low")).agg(F.min("unit").alias("spare"))
    rows = shared.filter(kind.isin(ENTRY, PROBE2, LOW1, LOW2)).select("key", "cls", low.alias("low"), F.when(kind.isin(PROBE2, LOW2), 2).otherwise(1).alias("budget"), "unit", "cost")
    # Budget 1 on each segment that came back; budget 2 on top of it where the segment allows it, never cheaper than budget 1.
    single = rows.filter("unit < 0").select("cls", "low", "key", "unit", F.lit(1).alias("budget"), "cost")
    sums = rows.filter("unit >= 0").groupBy("cls", "low", "unit").agg(
        F.sum(F.when(F.col("budget") == 1, F.col("cost")).otherwise(0)).alias("c1"), F.sum("cost").alias("c2"))
    double = sums.select("cls", "low", F.lit(None).cast("long").alias("key"), "unit", F.explode(F.array(
        F.struct(F.lit(1).alias("budget"), F.col("c1").alias("cost")), F.struct(F.lit(2).alias("budget"), F.col("c2").alias("cost")))).alias("u")).select(
        "cls", "low", "key", "unit", "u.budget", "u.cost").filter("cost > 0")
    dearest = Window.partitionBy("cls", "low").orderBy(F.col("cost").desc(), F.col("budget").desc(), "unit", "key")
    # A set with a negative spare count spares nothing here, and its band is run again.
    kept = single.unionByName(double).join(spare, ["cls", "low"]).withColumn("_rank", F.row_number().over(dearest)).filter(F.col("_rank") > F.col("spare"))
    chosen = kept.select("cls", "low", "budget", "unit", "key")
    by_key = chosen.filter("unit < 0").select("key", "cls")
    by_unit = rows.filter("unit >= 0").join(chosen.filter("unit >= 0").drop("key"), ["cls", "low", "budget", "unit"]).select("key", "cls")
    return by_key.unionByName(by_unit)


def overlaps(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of representatives whose texts are similar: those that sketches do not rule out, decided on the words."""
    num, den = similarity

    def kept(batches, good):
        for batch in batches:
            yield batch.filter(pa.array([good(*(v.as_py() for v in r)) for r in zip(*batch.columns[2:])], pa.bool_())).select([0, 1])

    def possible(batches):
        return kept(batches, lambda n, m, x, y: least_difference(x, y) <= bound(n + m, similarity))

    def verify(batches):
        def good(x, y):
            n, m, both = exact_overlap(x.encode(), y.encode(), width)
            return den * both >= num * (n + m - both)
        return kept(batches, good)

    side = lambda table, name, *columns: table.select(F.col("rep").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    left = pairs.join(side(sketches, "a", "n", "bits"), "a").join(side(sketches, "b", "n", "bits"), "b")
    left = left.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(possible, "a long, b long")
    both = left.join(side(texts, "a", "text"), "a").join(side(texts, "b", "text"), "b")
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), "text_a", "text_b").mapInArrow(verify, "u long, v long")


def hub_pairs(probe: DataFrame, entry: DataFrame, fits, rank) -> DataFrame:
    """For each set x one set y of another component: of the leading entries of its keys the one it shares most keys with.

    An entry leads a key by ``rank``; sets of the leader's own component get the leader among the other components.
    """
    leader = F.struct(rank.alias("rank"), F.col("cy"), F.col("y"), F.col("ny"))
    first = entry.groupBy("key").agg(F.max(leader).alias("first"))
    other = entry.join(first, "key").filter(F.col("cy") != F.col("first.cy")).groupBy("key").agg(F.max(leader).alias("other"))
    met = probe.join(first, "key").join(other, "key", "left").withColumn("hub", F.when(F.col("cx") != F.col("first.cy"), F.col("first")).otherwise(F.col("other")))
    met = met.select("x", "nx", "hub.y", "hub.ny").filter(fits)
    return met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).groupBy("x").agg(F.max(F.struct("n", "y")).alias("best")).select(
        F.least("x", "best.y").alias("a"), F.greatest("x", "best.y").alias("b")).distinct()


def left_pairs(probe: DataFrame, entry: DataFrame, sketches: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """All pairs (a, b) of a probe and an entry of one key, of different components, that sizes and sketches do not rule out.

    The rows of a key meet in one task, sorted, entries first; busy keys are cut into blocks of probes, each with all the entries.
    Sketches are compared as arrays there, so that pairs which cannot be similar are never rows.
    """
    num, den = similarity
    parts = entry.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ENTRIES)).cast("int").alias("parts"))
    probe, entry = probe.join(parts, "key"), entry.join(parts, "key")
    sides = [
        entry.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(0).alias("role"), F.col("y").alias("rep"), F.col("cy").alias("c")),
        probe.select("key", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("block"), F.lit(1).alias("role"), F.col("x").alias("rep"), F.col("cx").alias("c"))]
    rows = sides[0].unionByName(sides[1]).join(sketches, "rep").select("key", "block", "role", "rep", "c", "n", "bits")

    def sketched(bits: list[bytes], width: int) -> np.ndarray:
        """Sketches of at least ``width`` bytes as rows of that width."""
        return np.stack([folded(b, width) for b in bits]).view(np.uint64 if width % 8 == 0 else np.uint8)

    def matches(entries: list[tuple], probes: list[tuple]):
        """Pairs of one block: by the width of the entries' sketches, the smaller sets."""
        for width in {len(e[3]) for e in entries}:
            own = [e for e in entries if len(e[3]) == width]
            asked = [p for p in probes if width <= len(p[3]) <= 2 * width]
            if not asked:
                continue
            y, cy, ny = (np.array([e[i] for e in own], dtype=np.int64) for i in range(3))
            held, ask = sketched([e[3] for e in own], width), sketched([p[3] for p in asked], width)
            for (x, cx, nx, _), bits in zip(asked, ask):
                near = np.flatnonzero((cy != cx) & (y != x) & (ny <= nx) & (ny * den >= nx * num))
                if len(near):
                    apart = np.bitwise_count(held[near] ^ bits).sum(axis=1, dtype=np.int64)
                    for other in y[near[apart <= bound(ny[near] + nx, similarity)]]:
                        yield min(x, int(other)), max(x, int(other))

    def run(batches):
        at, entries, probes, out = None, [], [], set()

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, block, role, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, block) != at:
                    out.update(matches(entries, probes))
                    at, entries, probes = (key, block), [], []
                (probes if role else entries).append(tuple(row))
            if len(out) > 100_000:
                yield batch_of(out)
                out = set()
        out.update(matches(entries, probes))
        yield batch_of(out)

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "role").mapInArrow(run, "a long, b long").distinct()


def similar_classes(docs: DataFrame, text: str = "text", width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY,
                    plenty: tuple[int, int] = SEGMENTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, digest (of its sequence of words) and group (the same for all documents of a component).

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a set holds the distinct runs of ``width`` words, or the whole
    sequence if there are fewer. Documents link when |x & y| / |x | y| >= similarity (above 1/2); ``component_id`` is the
    smallest ``doc_id`` reachable by links, itself included. Null, empty and blank texts have an empty set and no links. Rows that
    repeat a text are one class; rows that repeat a ``doc_id`` are counted each. A null ``doc_id`` takes part and gets the
    component of its links, else null. An empty table gives an empty result; other columns are not read. Links between
    texts are decided on their words; ``n_shingles`` counts 64-bit fingerprints of them. ``plenty``: percent of the segments that a set may
    need, 100 at least, and the least number of them; few segments mean more bands that are run again.
    """
    if 2 * similarity[0] <= similarity[1]:
        raise ValueError("similarity must be above 1/2")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))

    def describe(batches):
        for batch in batches:
            texts = [v.as_py() or b"" for v in batch.column(1).cast(pa.large_binary())]
            digests = [sequence_digest(t) for t in texts]
            sets = [shingle_set(t, width) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digests, pa.binary()),
                "cls": pa.array([class_of(d) for d in digests], pa.int64()), "bits": pa.array([parities(s) for s in sets], pa.binary())})

    def digested(batches):
        for batch in batches:
            digests = [sequence_digest(v.as_py()) for v in batch.column(0).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0)], names=["digest", "text"])

    ship(docs.sparkSession)
    described = settle(docs.mapInArrow(describe, "doc_id long, n_shingles long, digest binary, cls long, bits binary"), "described")
    # A class is known by a number of its own, fixed by being written: a doc_id may be missing, or stand in several classes.
    classes = described.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("cls").alias("cls"), F.first("n_shingles").alias("n"), F.max("bits").alias("bits"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    def looked_up(opened: frozenset[int] | None) -> DataFrame:
        with large_batches(docs.sparkSession):
            return settle(shared_rows(signatures(docs, "text", width, similarity, opened, plenty)), "shared")

    shared = looked_up(None)
    short = shared.filter(F.col("kind").isin(SPARE, LOW_SPARE) & (F.col("unit") < 0)).select("cls", (F.col("kind") == LOW_SPARE).cast("int").alias("low"))
    band = F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int") - F.col("low")
    opened = frozenset(r["band"] for r in short.join(classes, "cls").select(band.alias("band")).distinct().collect())  # a few dozen bands at most
    rows, probes = shared, probes_of(shared)
    if opened:
        again = looked_up(opened)
        rows, probes = rows.unionByName(again), probes.unionByName(probes_of(again)).distinct()
    sized = classes.select("cls", "rep", "n")
    probe = settle(probes.join(sized, "cls").select("key", F.col("rep").alias("x"), F.col("n").alias("nx")), "probes")
    entry = rows.filter(F.col("kind").isin(ENTRY, ENTRY_DELETED)).select("key", "cls", "cost")
    if opened:
        entry = entry.groupBy("key", "cls").agg(F.max("cost").alias("cost"))
    entry = entry.join(probe.select("key").distinct(), "key", "left_semi").join(sized, "cls").select("key", F.col("rep").alias("y"), F.col("n").alias("ny"), "cost")
    entry = settle(entry, "entries")
    involved = probe.select(F.col("x").alias("rep")).unionByName(entry.select(F.col("y").alias("rep"))).distinct()
    wanted = settle(classes.join(involved, "rep").select("rep", "digest", "doc_id"), "wanted")
    # One text of each: rows are narrowed by doc_id, as far as they have one, and told apart by digest.
    held, ids = docs.filter("text IS NOT NULL"), wanted.select("doc_id").distinct()
    picked = held.filter("doc_id IS NOT NULL").join(ids.hint("merge"), "doc_id", "left_semi").unionByName(held.filter("doc_id IS NULL")).select("text")
    texts = settle(picked.mapInArrow(digested, "digest binary, text string").groupBy("digest").agg(F.max("text").alias("text")).join(
        wanted.select("digest", "rep"), "digest").select("rep", "text"), "texts")
    sketches = classes.select("rep", "n", "bits")

    num, den = similarity
    fits = (F.col("ny") <= F.col("nx")) & (F.col("ny") * den >= F.col("nx") * num) & (F.col("x") != F.col("y"))
    # A set leads by how often its subsets occur: what others were copied from comes first. Later rounds draw leaders by chance.
    fame = entry.groupBy("y").agg(F.sum("cost").alias("fame"))
    p = probe.withColumn("cx", F.col("x"))
    e = entry.drop("cost").join(fame, "y").withColumn("cy", F.col("y"))
    # Different texts whose short class identifiers agree are a pair as well.
    clash = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("a")).filter("k > 1").join(classes, "cls").select(
        "a", F.col("rep").alias("b")).filter("a <> b")
    label = classes.select("rep", F.col("rep").alias("component"))
    done = None
    for turn in range(HUB_ROUNDS + 1):
        if turn < HUB_ROUNDS:
            pairs = hub_pairs(p, e, fits, F.col("fame") if turn == 0 else F.xxhash64(F.lit(turn), "y"))
            pairs = pairs.unionByName(clash) if turn == 0 else pairs
        else:  # all that are left between different components
            pairs = left_pairs(p, e, sketches, similarity)
        pairs = settle(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.unionByName(pairs)
        if turn and pairs.isEmpty():  # nothing was joined, so components and open keys are those of the round before
            continue
        links = overlaps(pairs, sketches, texts, width, similarity)
        at = lambda c: label.select(F.col("rep").alias(c), F.col("component").alias(f"c{c}"))
        links = settle(links.join(at("u"), "u").join(at("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")), "links")
        if turn and links.isEmpty():
            continue
        joined = components(links)  # of components found so far, so each round's graph is small
        label = settle(label.join(joined, F.col("component") == F.col("u"), "left").select("rep", F.coalesce("v", "component").alias("component")), "labels")
        if turn < HUB_ROUNDS:
            renamed = lambda df, c: df.join(joined, F.col(c) == F.col("u"), "left").withColumn(c, F.coalesce("v", c)).drop("u", "v")
            p, e = renamed(p, "cx"), renamed(e, "cy")
            still = p.select("key", F.col("cx").alias("c")).unionByName(e.select("key", F.col("cy").alias("c"))).groupBy("key").agg(
                F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
            still = settle(still, "open-keys")
            p, e = settle(p.join(still, "key", "left_semi"), "open-probes"), settle(e.join(still, "key", "left_semi"), "open-entries")

    least = classes.join(label, "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("digest").alias("group"))
    of_class = classes.select("rep", "digest").join(label, "rep").join(least, "component").select("digest", F.col("component_id").alias("component"), "group")
    return described.join(of_class, "digest", "left").select(
        "digest", F.coalesce("group", "digest").alias("group"), "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def with_digests(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with the digest of each text's sequence of words as a further column ``name``."""
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for batch in batches:
            digests = [sequence_digest(v.as_py() or b"") for v in batch.column(place).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, name])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)
