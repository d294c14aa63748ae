"""Exact top-k search by inner product with M-trees.

With one more component sqrt(M^2 - |v|^2), where M is the largest norm, the largest inner products of a query become the
smallest Euclidean distances, so metric trees apply: d^2 = |q|^2 + M^2 - 2 (q, v).

Vectors go to their nearest pivot (a bounded sample), and every pivot's vectors are dealt to trees of a bounded
size, so equal vectors in any number spread over trees. A tree is written as pages: a centre, a covering radius, the
distance from the centre to the tree's root, and entries with their distances to the centre. A query first
searches its home tree, then with the threshold found there every tree whose pivot's radius does not rule it out. Within a tree the
search is best-first by lower bounds; centres and entries are skipped without a distance where the stored
distances already rule them out.
"""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import settle, ship, table

TREE_SIZE = 4096
PAGE_SIZE = 512
MAX_PIVOTS = 256
QUERIES_PER_TASK = 8192
SLACK = 1e-6  # relative; far above rounding, below the step of one between integer scores at these sizes

PAGES = "tree long, centre binary, extra double, radius double, to_root double, ids binary, vectors binary, extras binary, to_centre binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column, scale: int) -> Column:
    """Neither null nor holding null or non-finite components (after scaling too)."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & F.coalesce(F.abs(x.cast("double") * scale) < F.lit(math.inf), F.lit(False)) & ~F.isnan(x))


def matrix(vectors, dim: int) -> np.ndarray:
    """Rows of equal length; what a shorter vector lacks is 0."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def extras(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (vectors * vectors).sum(axis=1), 0))


def distances(vectors: np.ndarray, extra: np.ndarray, to: np.ndarray, to_extra: float) -> np.ndarray:
    return np.sqrt(((vectors - to) ** 2).sum(axis=1) + (extra - to_extra) ** 2)


def build_pages(tree: int, ids: np.ndarray, vectors: np.ndarray, extra: np.ndarray, root: np.ndarray, root_extra: float, page_size: int) -> list[tuple]:
    """Bulk load: parts that are too large are dealt to their nearest of a few of their own objects, until all fit a page."""
    pages, parts = [], [np.arange(len(ids))]
    while parts:
        own = parts.pop()
        if len(own) > page_size:
            seeds = own[np.linspace(0, len(own) - 1, min(16, -(-len(own) // page_size) + 1)).astype(int)]
            near = np.argmin(np.stack([distances(vectors[own], extra[own], vectors[s], extra[s]) for s in seeds]), axis=0)
            split = [own[near == i] for i in range(len(seeds))]
            if max(map(len, split)) == len(own):  # objects that lie together
                split = np.array_split(own, -(-len(own) // page_size))
            parts += [s for s in split if len(s)]
            continue
        middle = own[np.argmin(distances(vectors[own], extra[own], vectors[own].mean(axis=0), float(extra[own].mean())))]
        away = distances(vectors[own], extra[own], vectors[middle], extra[middle])
        to_root = float(distances(vectors[middle:middle + 1], extra[middle:middle + 1], root, root_extra)[0])
        pages.append((tree, vectors[middle].tobytes(), float(extra[middle]), float(away.max()), to_root, ids[own].tobytes(),
                      vectors[own].tobytes(), extra[own].tobytes(), away.tobytes()))
    return pages


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while those are exact, else in whole numbers, kept within 64 bits."""
    if len(vectors) and np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query)) >= 2**53:
        whole = np.vectorize(int, otypes=[object])
        exact = whole(vectors) @ whole(query)
        return np.array([max(-2**63, min(2**63 - 1, int(x))) for x in exact], dtype=np.int64)
    return (vectors @ query).astype(np.int64)


def best_first(pages: list, root: np.ndarray, root_extra: float, most: float, query_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of up to ``k`` entries that score ``floor`` or more, by falling score and rising id."""
    square = float(query @ query)
    reach = lambda score: math.sqrt(max(0.0, square + most - 2 * score)) * (1 + SLACK) + SLACK if score > -math.inf else math.inf
    to_root = math.sqrt(float(((query - root) ** 2).sum()) + root_extra ** 2)
    ids, scores, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), reach(floor)
    # What the stored distance to the root allows, before any distance to a centre is known.
    heap = [(max(0.0, abs(to_root - p["to_root"]) - p["radius"]), i, -1.0) for i, p in enumerate(pages)]
    heapq.heapify(heap)
    while heap:
        bound, i, known = heapq.heappop(heap)
        if bound > limit:
            break
        page = pages[i]
        if known < 0:
            known = math.sqrt(float(((query - page["centre"]) ** 2).sum()) + page["extra"] ** 2)
            heapq.heappush(heap, (max(bound, known - page["radius"]), i, known))
            continue
        near = np.flatnonzero(np.abs(page["to_centre"] - known) <= limit) if limit < math.inf else slice(None)
        score, own = products(page["vectors"][near], query), page["ids"][near]
        kept = (score >= floor) & (own != query_id)
        ids, scores = np.concatenate([ids, own[kept]]), np.concatenate([scores, score[kept]])
        if len(ids) > k:
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        if len(ids) == k:
            floor = max(floor, float(scores.min()))
            limit = reach(floor)
    return ids, scores


def top_k(vectors: DataFrame, queries: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 64,
          tree_size: int = TREE_SIZE, page_size: int = PAGE_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` selects, the ``k`` largest inner products with all others.

    Components count as floor(scale * x). Ties go to the smaller id; a query never finds its own id. Null vectors, and such that hold null or
    non-finite components, take no part; neither do null ids. Rows that repeat an id count once, with the largest of their vectors. Vectors of
    unlike lengths are compared as if the shorter one went on with zeros. With fewer than ``k`` others all are returned; an empty table
    gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    raw = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("_raw"), queries.alias("_query")).filter(
        F.col("vec_id").isNotNull() & usable(F.col("_raw"), scale))
    base = settle(raw.select("vec_id", quantised(F.col("_raw"), scale).alias("v"), "_query").groupBy("vec_id").agg(
        F.max("v").alias("v"), F.max("_query").alias("is_query")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, dim, most = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    roots = matrix([r["v"] for r in base.select("v", "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MAX_PIVOTS, -(-n // tree_size))).collect()], dim)
    root_extra = extras(roots, most)

    def route(batches):
        for pdf in batches:
            v = matrix(pdf["v"], dim)
            extra = extras(v, most)
            away = np.stack([distances(v, extra, r, e) for r, e in zip(roots, root_extra)])
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": [x.tobytes() for x in v], "is_query": pdf["is_query"], "pivot": away.argmin(axis=0),
                                "away": away.min(axis=0)})

    routed = settle(base.mapInPandas(route, "vec_id long, v binary, is_query boolean, pivot int, away double"), "routed")
    per_pivot = {r["pivot"]: r for r in routed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # <= MAX_PIVOTS
    shares = [-(-per_pivot[p]["n"] // tree_size) if p in per_pivot else 0 for p in range(len(roots))]
    cover = np.array([per_pivot[p]["radius"] if p in per_pivot else 0.0 for p in range(len(roots))])
    starts = np.concatenate([[0], np.cumsum(shares)])
    pivot_of = np.repeat(np.arange(len(roots)), shares)
    of_pivot = lambda values: F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("pivot"))
    tree = (of_pivot(starts) + F.pmod(F.xxhash64("vec_id"), of_pivot(np.maximum(shares, 1)))).cast("long")

    def build(pdf):
        number = int(pdf["tree"].iloc[0])
        v = np.stack([np.frombuffer(x) for x in pdf["v"]])
        p = pivot_of[number]
        return pd.DataFrame(build_pages(number, pdf["vec_id"].to_numpy(), v, extras(v, most), roots[p], root_extra[p], page_size),
                            columns=[c.split()[0] for c in PAGES.split(", ")])

    pages = settle(routed.select("vec_id", "v", tree.alias("tree")).groupBy("tree").applyInPandas(build, PAGES), "tree-pages")
    wanted = routed.filter("is_query").select(F.col("vec_id").alias("query_id"), "v", tree.alias("home"))
    chunks = -(-wanted.count() // QUERIES_PER_TASK)
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(max(1, chunks)))
    copies = pages.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, chunks) - 1).cast("long"))))

    def search(asked, held):
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        p = pivot_of[int(held["tree"].iloc[0])]
        own = [{"centre": np.frombuffer(r.centre), "extra": r.extra, "radius": r.radius, "to_root": r.to_root, "ids": np.frombuffer(r.ids, np.int64),
                "vectors": np.frombuffer(r.vectors).reshape(-1, dim), "to_centre": np.frombuffer(r.to_centre)} for r in held.itertuples()]
        out = [(q.query_id, *best_first(own, roots[p], root_extra[p], most, q.query_id, np.frombuffer(q.v), k, q.floor)) for q in asked.itertuples()]
        return pd.DataFrame({"query_id": np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64),
                             "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    def run(asked: DataFrame) -> DataFrame:
        keyed = asked.withColumn("chunk", chunk)
        return keyed.groupBy("tree", "chunk").cogroup(copies.groupBy("tree", "chunk")).applyInPandas(search, FOUND)

    nowhere = F.lit(-math.inf)
    home = settle(run(wanted.select("query_id", "v", F.col("home").alias("tree"), nowhere.alias("floor"))), "found-home")
    floors = home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(nowhere).alias("floor"))
    rest = wanted.join(floors, "query_id", "left").select("query_id", "v", "home", F.coalesce("floor", nowhere).alias("floor"))

    def others(batches):
        """The trees that the distance to their pivot does not rule out."""
        for pdf in batches:
            parts = []
            for q in pdf.itertuples():
                v = np.frombuffer(q.v)
                limit = math.sqrt(max(0.0, float(v @ v) + most - 2 * q.floor)) * (1 + SLACK) + SLACK if q.floor > -math.inf else math.inf
                away = np.sqrt(((roots - v) ** 2).sum(axis=1) + root_extra ** 2)
                open_trees = np.flatnonzero((away - cover <= limit)[pivot_of])
                open_trees = open_trees[open_trees != q.home]
                parts.append(pd.DataFrame({"query_id": q.query_id, "v": [q.v] * len(open_trees), "tree": open_trees, "floor": q.floor}))
            if parts:
                yield pd.concat(parts)

    found = home.unionByName(run(rest.mapInPandas(others, "query_id long, v binary, tree long, floor double")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP5_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
