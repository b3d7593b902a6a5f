"""Nearest neighbours by low-dimensional stable projections and a kd-tree (SRS).

Vectors are projected to ``DIMS`` dimensions with a fixed Gaussian (2-stable)
matrix.  The squared projected distance of two vectors, over their squared
true distance, follows a chi-square law with ``DIMS`` degrees of freedom.
Neighbours of a query are taken in order of projected distance and verified
with the true one; the search stops when a true neighbour that is nearer than
the k-th found would have come up with probability ``CONFIDENCE``.

The kd-tree has two levels.  The upper one, built from a bounded sample of
projected vectors, splits the space into regions of about ``REGION_ROWS``
vectors; a region with more (many copies of one vector) is dealt into parts,
and its queries into blocks.  A part and a block are one group of a Spark job,
which builds the lower tree over the part's vectors.  A query first searches its own region; its k-th distance there then
tells, with the same chi-square test, which other regions it needs.  Vectors
and queries meet by region; nothing that grows with the data is broadcast.

* null vectors, zero vectors and those with null or non-finite components
  take no part; nor do vectors of another length than the most common one
  (ties: the longer)
* fewer than k candidates: all of them; ties go to the smaller id
* a null id takes no part; repeated rows are candidates each
* repeated query rows (same id and vector) are one query; rows of one id with
  unlike vectors are a query each, all listed under that id
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.llm.common import table, write_table

K = 10
DIMS = 8
CONFIDENCE = 0.97
SEED = 20_240_101
REGION_ROWS = 1_024
SAMPLE_ROWS = 20_000
LEAF_ROWS = 64
STEP_LEAVES = 8
QUERY_BLOCK = 4_096
MAX_REGIONS = 4_096
QUERY_STEP = 100
FOUND_SCHEMA = "query_id long, query_key long, vec_id long, score double"


def chi_square_cdf(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """For an even number of degrees of freedom: a finite Poisson sum."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.exp(-half), np.zeros_like(half)
    for j in range(dims // 2):
        total += term
        term = term * half / (j + 1)
    return 1 - total


def stop_ratio(confidence: float = CONFIDENCE, dims: int = DIMS) -> float:
    """The squared projected distance over the squared k-th true distance at which
    the chi-square test holds."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array(mid), dims) < confidence else (low, mid)
    return high


def projection(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


class Tree:
    """A kd-tree by median splits: the points of each leaf are contiguous in ``order``."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.order = np.arange(len(points))
        self.cuts, bounds, todo = [], [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            p = points[self.order[a:b]]
            low, high = p.min(axis=0), p.max(axis=0)
            axis = int((high - low).argmax())
            if b - a <= leaf_rows or high[axis] == low[axis]:
                bounds.append((a, b, low, high))
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.first, self.last = (np.array([x[i] for x in bounds]) for i in (0, 1))
        self.low, self.high = (np.stack([x[i] for x in bounds]) for i in (2, 3))

    def box_distance(self, point: np.ndarray) -> np.ndarray:
        """Squared distance to the box of each leaf."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return (gap * gap).sum(axis=1)


class Regions:
    """The upper kd-tree: splitting planes that send every point to one region."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.node: list[tuple] = []
        self.low, self.high = [], []
        dims = sample.shape[1]
        self._split(sample, regions, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.stack(self.low), np.stack(self.high)

    def _split(self, p, regions, low, high) -> int:
        me = len(self.node)
        self.node.append(())
        axis = int((p.max(axis=0) - p.min(axis=0)).argmax()) if len(p) else 0
        cut = float(np.median(p[:, axis])) if len(p) else 0.0
        right = p[:, axis] > cut if len(p) else np.zeros(0, bool)
        if regions < 2 or not right.any():
            self.node[me] = (-1, len(self.low), 0, 0)
            self.low.append(low)
            self.high.append(high)
            return me
        a, b = high.copy(), low.copy()
        a[axis], b[axis] = cut, cut
        left = self._split(p[~right], regions // 2, low, a)
        self.node[me] = (axis, cut, left, self._split(p[right], regions - regions // 2, b, high))
        return me

    def of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            n, rows = todo.pop()
            axis, cut, left, right = self.node[n]
            if axis < 0:
                out[rows] = cut
            elif len(rows):
                over = points[rows, axis] > cut
                todo += [(left, rows[~over]), (right, rows[over])]
        return out

    def near(self, point: np.ndarray, squared: float) -> np.ndarray:
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return np.flatnonzero((gap * gap).sum(axis=1) < squared)


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def search_part(data: pd.DataFrame, queries: pd.DataFrame, k: int, ratio: float) -> pd.DataFrame:
    """The k nearest of ``data`` (id, v) for each of ``queries`` (id, key, v, reach): candidates in
    order of projected distance, a few leaves at a time, until the test holds.
    ``reach``: the k-th distance that is known already."""
    found = []
    if len(data) and len(queries):
        ids, x = data["id"].to_numpy(np.int64), matrix(data["v"])
        plane = projection(x.shape[1])
        low = x @ plane
        tree = Tree(low, LEAF_ROWS)
        x, ids = x[tree.order], ids[tree.order]
        for q, key, v, reach in zip(queries["id"], queries["key"], matrix(queries["v"]), queries["reach"]):
            box = tree.box_distance(v @ plane)
            leaves = np.argsort(box, kind="stable")
            best_d, best_i, kth, at = np.zeros(0), np.zeros(0, np.int64), float(reach), 0
            while at < len(leaves) and not box[leaves[at]] > ratio * kth * kth:
                step = leaves[at:at + STEP_LEAVES]
                at += STEP_LEAVES
                rows = np.concatenate([np.arange(tree.first[i], tree.last[i]) for i in step])
                rows = rows[ids[rows] != q]
                diff = x[rows] - v
                best_d = np.r_[best_d, np.sqrt((diff * diff).sum(axis=1))]
                best_i = np.r_[best_i, ids[rows]]
                keep = np.lexsort((best_i, best_d))[:k]
                best_d, best_i = best_d[keep], best_i[keep]
                if len(best_d) == k:
                    kth = min(kth, best_d[-1])
            found.append(pd.DataFrame({"query_id": q, "query_key": key, "vec_id": best_i, "score": best_d}))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []})


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part; v in double precision."""
    d = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        & F.exists("v", lambda c: c != 0))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return d.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def build_regions(vectors: DataFrame, rows: int) -> Regions:
    """Fitted on about SAMPLE_ROWS vectors, those with the smallest hashes."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = [r["v"] for r in sample.select("v").collect()]
    low = matrix(got) @ projection(len(got[0])) if got else np.zeros((0, DIMS))
    return Regions(low, min(MAX_REGIONS, max(1, math.ceil(rows / REGION_ROWS))))


def nearest(df: DataFrame, is_query, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
            confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each distinct row for which
    the column ``is_query`` (on the column ``id``) holds, among all other rows."""
    spark, ratio = df.sparkSession, stop_ratio(confidence)
    vectors = valid(df, vec_id, vector)
    regions = build_regions(vectors, vectors.count())
    tree = spark.sparkContext.broadcast(regions)  # at most MAX_REGIONS boxes

    def place(batches):
        for b in batches:
            if len(b):
                v = matrix(b["v"])
                yield b.assign(region=tree.value.of(v @ projection(v.shape[1])))

    placed = write_table(vectors.mapInPandas(place, "id long, v array<double>, region int"), "ann-vectors")

    def per_region(rows: DataFrame, most: int):
        """How many shares of at most about ``most`` rows each region is cut into."""
        share = np.ones(len(regions.low), np.int32)
        for r in rows.groupBy("region").count().where(F.col("count") > most).collect():  # at most MAX_REGIONS rows
            share[r["region"]] = -(-r["count"] // most)
        return F.lit(share)[F.col("region")]  # one literal, whatever the number of regions

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    parts = per_region(placed, 2 * REGION_ROWS)
    # one row per query: the key tells unlike vectors of one id apart
    queries = placed.where(is_query).select("id", "v", "region").distinct().withColumn("key", F.xxhash64("v"))

    def search(asked: DataFrame) -> DataFrame:
        """Each block of a region's queries meets each part of its vectors in one group."""
        blocks, key = per_region(asked, QUERY_BLOCK), ["region", "part", "block"]
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("part", every(parts))
        dealt = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("block", every(blocks))
        return dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(
            lambda d, q: search_part(d, q, k, ratio), FOUND_SCHEMA)

    def top(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    own = write_table(top(search(queries.withColumn("reach", F.lit(float("inf"))))), "ann-own")
    reach = own.groupBy("query_id", "query_key").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("kth"))
    known = queries.join(reach, (F.col("id") == F.col("query_id")) & (F.col("key") == F.col("query_key")), "left") \
                   .select("id", "key", "v", "region", F.coalesce("kth", F.lit(float("inf"))).alias("reach"))

    def others(batches):
        for b in batches:
            rows = []
            for q, key, v, own_region, far in zip(b["id"], b["key"], b["v"], b["region"], b["reach"]):
                v = np.asarray(v, np.float64)
                for r in tree.value.near(v @ projection(len(v)), ratio * far * far):
                    if r != own_region:
                        rows.append((q, key, v, r, far))
            yield pd.DataFrame(rows, columns=["id", "key", "v", "region", "reach"])

    wider = write_table(known.mapInPandas(others, "id long, key long, v array<double>, region int, reach double"), "ann-wider")
    return top(own.select("query_id", "query_key", "vec_id", "score").unionByName(search(wider))) \
        .select("query_id", "rank", "vec_id", "score")


def op4_srs_neighbours(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, F.col("id") % QUERY_STEP == 0)
