"""Nearest neighbours by an inverted multi-index (operator 8).

Each half of a vector is quantised by centroids of its own, so a row lies in one of K squared cells, K growing with the
number of rows. Halves get one more component, which makes all of them equally long; the sum of the squared
distances of a query's halves from a pair of centroids then falls as the inner product with it rises. A query
goes through the pairs by that sum, least first, from a heap, until the cells it has met hold a share of the
distinct vectors, so that copies of one don't use the share up, and enough rows for k neighbours. The share falls
as the table grows: ``share(n)``. The rows of these cells are then ranked by their own inner products in double
precision. All this is so for tables of any size.

The centroids are fitted on at most ``FIT_ROWS`` distinct vectors, those of least hash; every row is indexed. Of
equal vectors only the k + 1 smallest ids can be neighbours, so that a vector is one row with so many ids, however often it
is repeated. Rows lie in slabs of neighbouring first centroids, a large slab in blocks of about ``ROWS``; a
query goes to the slabs that it visits, with how far it goes in each of their cells' rows. A task holds one
block and lets the queries pass by.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakloom.llm import _shared as S

FIT_ROWS, FIT_ROUNDS = 20_000, 12
#: Most centroids of a half; cells are its square.
MOST_CENTROIDS = 1_024
#: Share of the distinct vectors that a query meets in a table of a thousand, on which vectors with hardly any structure need most.
SHARE = 0.45
#: Rows of a block, and queries that pass by one copy of it.
ROWS, QUERIES = 32_768, 65_536
#: From this part of a block's rows on, all of them are multiplied and the unvisited ones left out afterwards.
DENSE = 0.1


def share(n: int) -> float:
    """The part of n distinct vectors that a query goes through: 0.45 of a thousand, 0.27 of fifty thousand, 0.11 of a hundred millions."""
    return min(1.0, SHARE * (max(n, 1) / 1000) ** -0.125)


def n_centroids(n: int) -> int:
    """A power of two that grows with the fourth root of n: 128 for two thousand, 256 for fifty thousand, 512 for a million."""
    return int(min(MOST_CENTROIDS, 2 ** round(np.log2(max(n, 1)) / 4 + 4.3)))


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of rows with a key and a vector that is neither null, empty, zero nor holds null or non-finite parts."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).alias("vec_id"), v.cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def centroids(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most k centroids of the points, by Lloyd's rounds from distinct points."""
    distinct = np.unique(points, axis=0)
    r = np.random.default_rng(seed)
    c = distinct[r.permutation(len(distinct))[:k]].copy()
    for _ in range(FIT_ROUNDS):
        near = nearest(points, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, points)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(points: np.ndarray, c: np.ndarray) -> np.ndarray:
    square = (c * c).sum(1)
    return np.concatenate([(2 * points[at : at + 8192] @ c.T - square).argmax(1) for at in range(0, len(points), 8192)]) if len(points) else np.zeros(0, int)


class MultiIndex:
    """Two codebooks, the longest halves, and the numbers of rows and of distinct vectors in each cell."""

    def __init__(self, width: int, longest: tuple[float, float]):
        self.width, self.half, self.longest = width, (width + 1) // 2, longest

    def halves(self, v: np.ndarray, query: bool = False) -> list[np.ndarray]:
        """Each half with the component that makes it as long as the longest; a query's is zero."""
        out = []
        for part, most in zip((v[:, : self.half], v[:, self.half :]), self.longest):
            more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, most - (part * part).sum(1)))
            out.append(np.hstack([part, more[:, None]]))
        return out

    def fit(self, points: np.ndarray, k: int, seed: int = 0) -> None:
        self.first, self.second = (centroids(h, k, seed + i) for i, h in enumerate(self.halves(points)))
        self.counts, self.distinct = np.zeros((2, len(self.first), len(self.second)), np.int64)

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = self.halves(v)
        return nearest(a, self.first) * len(self.second) + nearest(b, self.second)

    def order(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances from both codebooks' centroids in ascending order, and the centroids."""
        a, b = (((c - h[0]) ** 2).sum(1) for h, c in zip(self.halves(query[None, :], True), (self.first, self.second)))
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        return a[rows], b[columns], rows, columns

    def walk(self, query: np.ndarray, wanted: int, least: int) -> np.ndarray:
        """How many of its nearest second centroids a query visits with each first centroid, by summed distances until ``wanted`` distinct vectors and ``least`` rows are met."""
        s, t, rows, columns = self.order(query)
        s, t = s.tolist(), t.tolist()
        counts, distinct = (x[rows][:, columns].tolist() for x in (self.counts, self.distinct))
        depth = [0] * len(s)  # cells taken of each row so far; a row is opened when the one above has been
        heap, found, n = [(s[0] + t[0], 0)], 0, 0
        while heap and (found < wanted or n < least):
            _, i = heapq.heappop(heap)
            j = depth[i]
            depth[i] += 1
            found += distinct[i][j]
            n += counts[i][j]
            if j + 1 < len(t):
                heapq.heappush(heap, (s[i] + t[j + 1], i))
            if j == 0 and i + 1 < len(s):
                heapq.heappush(heap, (s[i + 1] + t[0], i + 1))
        out = np.zeros(len(s), np.uint16)
        out[rows] = depth
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _best(scores: np.ndarray, at: np.ndarray, e: np.ndarray, q: np.ndarray, ids, own: int, k: int):
    """(id, score) of the k nearest rows of some distinct vectors; one of them may be the query's own."""
    if len(at) > k + 1:
        at = at[scores >= np.partition(scores, -k - 1)[-k - 1] - 1e-9 * (1 + np.abs(scores).max())]
    exact = (e[at] * q).sum(1)  # summed alike for every row, so that equal vectors tie
    found = sorted((-s, i, n) for s, x in zip(exact.tolist(), at.tolist()) for i, n in ids[x] if i != own)
    out = []
    for s, i, n in found:
        out += [(i, -s)] * min(n, k - len(out))
        if len(out) == k:
            break
    return out


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", part: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` holds.

    Nearness is the inner product; ties go to the smaller id; rows with the query's own id are no
    candidates; repeated rows are candidates each; shorter vectors count as filled up with zeros. Queries
    without any candidate have no row, and an empty table has none. Other columns are not read.
    ``part``: the share of distinct vectors to go through, by default ``share`` of their number.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    given = valid(vectors, key, vector)
    width = given.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return nothing
    given = given.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    first = Window.partitionBy("v").orderBy("vec_id")
    few = given.groupBy("v", "vec_id").agg(F.count("*").alias("n")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1)
    rows = S.checkpointed(few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "n"))).alias("ids")))
    half = (width + 1) // 2
    long = lambda a, n: F.max(F.aggregate(F.slice("v", a, n), F.lit(0.0), lambda s, x: s + x * x)) if n else F.lit(0.0)
    told = rows.agg(F.count("*").alias("n"), long(1, half).alias("a"), long(half + 1, width - half).alias("b"), F.max(F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: F.greatest(s, x["n"]))).alias("copies")).first()
    index = MultiIndex(width, (told["a"], told["b"]))
    sample = rows.orderBy(F.xxhash64("v"), "v").limit(FIT_ROWS).select("v").collect()
    index.fit(np.array([r["v"] for r in sample], float), n_centroids(told["n"]))
    columns = len(index.second)

    @F.arrow_udf("int")
    def cell(v: pa.Array) -> pa.Array:
        return pa.array(index.cells(_matrix(v, width)).astype(np.int32))

    placed = S.checkpointed(rows.withColumn("cell", cell("v")))
    met = placed.groupBy("cell").agg(F.count("*").alias("distinct"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("n"))
    for r in met.collect():
        at = divmod(r["cell"], columns)
        index.counts[at], index.distinct[at] = r["n"], r["distinct"]
    total = int(index.distinct.sum())
    wanted, least = int(np.ceil((share(total) if part is None else part) * total)), k + told["copies"]
    # Slabs of neighbouring first centroids: each ends where about ROWS vectors are reached.
    each = index.distinct.sum(1)
    slab_of = (np.cumsum(each) - each) // ROWS
    slabs, slab_of = np.unique(slab_of, return_inverse=True)
    begins = np.searchsorted(slab_of, np.arange(len(slabs)))
    ends = np.append(begins[1:], len(each))
    blocks = np.maximum(1, -(-np.add.reduceat(each, begins) // ROWS)).tolist()

    @F.arrow_udf("array<struct<slab:int,depth:binary>>")
    def walked(v: pa.Array) -> pa.Array:
        out = []
        for q in _matrix(v, width):
            depth = index.walk(q, wanted, least)
            out.append([{"slab": i, "depth": depth[a:b].tobytes()} for i, (a, b) in enumerate(zip(begins, ends)) if depth[a:b].any()])
        return pa.array(out, pa.list_(pa.struct([("slab", pa.int32()), ("depth", pa.binary())])))

    list_of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at + 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    asked = valid(vectors.filter(is_query), key, vector).withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))).distinct()
    asked = asked.select(F.col("vec_id").cast("long").alias("query_id"), "v", F.explode(walked("v")).alias("w")).select("query_id", "v", F.col("w.slab").alias("slab"), F.col("w.depth").alias("depth"))
    asked = S.checkpointed(asked)
    visits = {r["slab"]: r["count"] for r in asked.groupBy("slab").count().collect()}
    parts = [-(-visits.get(i, 0) // QUERIES) for i in range(len(slabs))]
    nobody, no_ids = F.lit(None).cast("long"), F.lit(None).cast("array<struct<vec_id:bigint,n:bigint>>")
    left = asked.withColumn("part", F.pmod(F.xxhash64("query_id", "v"), list_of(parts, F.col("slab"))).cast("int")).withColumn("block", spread(list_of(blocks, F.col("slab"))))
    left = left.select("slab", "block", "part", F.lit(1).alias("side"), "query_id", "v", "depth", F.lit(None).cast("int").alias("cell"), no_ids.alias("ids"))
    of_row = F.col("slab")
    right = placed.withColumn("slab", list_of(slab_of.tolist(), F.floor(F.col("cell") / columns).cast("int"))).withColumn("block", F.pmod(F.xxhash64("v"), list_of(blocks, of_row)).cast("int"))
    right = right.filter(list_of(parts, of_row) > 0).withColumn("part", spread(list_of(parts, of_row)))
    right = right.select("slab", "block", "part", F.lit(0).alias("side"), nobody.alias("query_id"), "v", F.lit(None).cast("binary").alias("depth"), "cell", F.transform("ids", lambda x: F.struct(x["vec_id"].cast("long").alias("vec_id"), x["n"].alias("n"))).alias("ids"))

    def rank(batches):
        """Of each block its rows come first, then the queries that visit it."""
        unit, e, cells, ids = None, [], [], []
        order = bounds = e_all = None
        for batch in batches:
            key_of = list(zip(*(batch[c].to_pylist() for c in ("slab", "block", "part"))))
            side, out = np.asarray(batch["side"]), []
            edges = [0, *(i for i in range(1, len(key_of)) if key_of[i] != key_of[i - 1] or side[i] != side[i - 1]), len(key_of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if key_of[a] != unit:
                    unit, e, cells, ids, e_all = key_of[a], [], [], [], None
                if side[a] == 0:
                    e.append(_matrix(some["v"], width))
                    cells.append(np.asarray(some["cell"]))
                    ids += [[(x["vec_id"], x["n"]) for x in xs] for xs in some["ids"].to_pylist()]
                    continue
                if not e:
                    continue
                low, high = int(begins[unit[0]]), int(ends[unit[0]])
                if e_all is None:
                    e_all, at_cell = np.concatenate(e), np.concatenate(cells) - low * columns
                    order = np.argsort(at_cell, kind="stable")
                    bounds = np.searchsorted(at_cell[order], np.arange((high - low) * columns + 1))
                    e_all, ids = e_all[order], [ids[i] for i in order.tolist()]
                q_all, own = _matrix(some["v"], width), some["query_id"].to_pylist()
                for i, depth in enumerate(some["depth"].to_pylist()):
                    depth = np.frombuffer(depth, np.uint16).astype(int)
                    nearest_second = index.order(q_all[i])[3]
                    visited = np.concatenate([r * columns + nearest_second[:d] for r, d in enumerate(depth.tolist())])
                    n = bounds[visited + 1] - bounds[visited]
                    stop = np.cumsum(n)
                    if not stop[-1]:
                        continue
                    at = np.repeat(bounds[visited] - (stop - n), n) + np.arange(stop[-1])
                    scores = (e_all @ q_all[i])[at] if len(at) > DENSE * len(e_all) else e_all[at] @ q_all[i]
                    out += [(own[i], v, s) for v, s in _best(scores, at, e_all, q_all[i], ids, own[i], k)]
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    both = left.unionByName(right).repartition("slab", "block", "part").sortWithinPartitions("slab", "block", "part", "side")
    met = both.mapInArrow(rank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest found for every twentieth vector; vectors that are null, zero or not finite take no part, equal vectors are candidates each, ties go to the smaller vec_id."""
    return search(S.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
