"""Hard-negative mining with Kronecker-packed inner products.

Components become whole numbers, floor(scale * x).  To score candidates for an
anchor, the components of several candidates are shifted to be non-negative
and put side by side into fields of one wide integer; each anchor component
(shifted as well) is multiplied once with that integer, the products are
summed, and every field then holds one candidate's exact sum.  Taking the
shifts out again leaves the inner products.  A field is as wide as the
largest sum that the norms of the block allow, so fields never run over.  The
wide integers have 53 bits and are held in doubles, in which whole numbers up
to there are exact: the multiplications are one matrix product.  Where a
single field needs more, Python's integers of any width take their place.

The anchors are the stated query set.  They are dealt into blocks of bounded
size; for each block all rows are read twice: for the positives of its
anchors, then for the negatives that lie between the bounds these set.  A
task keeps only the best few of each anchor, so nothing but those is shuffled.

* rows with a null id, label or vector, with a null or non-finite component or
  with another vector length than the most common one (ties: the longer) take
  no part; zero vectors do
* repeated rows (same id, label and vector) are one row; rows of one id that
  differ are a row each, never partners of each other
* equal scores: the smaller id first; fewer rows than asked for: all of them
* an anchor without positives, or a positive without negatives, has no rows
* a score that does not fit into 64 bits is an error
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.llm.common import scratch_dir, table, write_table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
ANCHOR_STEP = 50
BLOCK_VALUES = 1 << 18  # components of the anchors of a block: 2 MB
CHUNK_ROWS = 2_048
ANCHOR_ROWS = 256  # anchors that meet a chunk at once
EXACT_BITS = 53
DOUBLES_BELOW = 2.0 ** 24  # larger components go to Python's integers
WIDE_FIELDS = 8  # fields of a Python integer
FOUND = "slot long, score long, id long, key long"


def field_bits(a: np.ndarray, c: np.ndarray) -> int:
    """Bits that hold any inner product of the non-negative rows of ``a`` and ``c``."""
    squares = [max(1, int((m * m).sum(axis=1).max(initial=1))) for m in (a, c)]
    return (squares[0] * squares[1]).bit_length() // 2 + 2


def inner_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (int64) of two matrices of whole numbers held in doubles."""
    dims = rows.shape[1]
    shift_a, shift_c = (max(0, -int(m.min(initial=0))) for m in (anchors, rows))
    bits = field_bits(anchors + float(shift_a), rows + float(shift_c))
    wide = bits > EXACT_BITS or max(np.abs(anchors).max(initial=0), np.abs(rows).max(initial=0)) >= DOUBLES_BELOW
    if wide:
        whole = np.frompyfunc(int, 1, 1)
        anchors, rows = whole(anchors), whole(rows)
    a, c = anchors + shift_a, rows + shift_c
    if wide:
        bits = field_bits(a, c)
    fields = WIDE_FIELDS if wide else EXACT_BITS // bits
    words = -(-len(c) // fields)
    packed = np.zeros((words, dims), c.dtype)
    for f in range(fields):
        part = c[f * words:(f + 1) * words]
        packed[:len(part)] += part * (1 << bits * f if wide else float(1 << bits * f))
    total = a @ packed.T  # one multiplication for each anchor component and word
    if not wide:
        total = total.astype(np.int64)
    mask = (1 << bits) - 1
    sums = np.concatenate([(total >> bits * f) & mask for f in range(fields)], axis=1)[:, :len(c)]
    kind = object if wide else np.int64
    extra = shift_c * anchors.sum(axis=1).astype(kind)[:, None] + shift_a * rows.sum(axis=1).astype(kind) + shift_a * shift_c * dims
    return (sums - extra).astype(np.int64)


class Best:
    """The first ``k`` distinct rows (score descending, id, key) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot, self.score, self.id, self.key = (np.zeros(0, np.int64) for _ in range(4))
        self.floor = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot, score, ids, key) -> None:
        if not len(slot):
            return
        slot, score, ids, key = (np.concatenate(p) for p in (
            (self.slot, slot), (self.score, score), (self.id, ids), (self.key, key)))
        order = np.lexsort((key, ids, -score, slot))
        slot, score, ids, key = (x[order] for x in (slot, score, ids, key))
        new = np.r_[True, (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])]
        slot, score, ids, key = (x[new] for x in (slot, score, ids, key))
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.r_[first, len(slot)]))
        keep = rank < self.k
        self.slot, self.score, self.id, self.key = (x[keep] for x in (slot, score, ids, key))
        full = keep & (rank == self.k - 1)
        self.floor[slot[full]] = score[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.slot, self.score, self.id, self.key)],
                                          ["slot", "score", "id", "key"])


def usable(df: DataFrame, vec_id: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, v, key): the rows that take part, v in whole numbers."""
    d = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                  F.col(vector).cast("array<double>").alias("v"))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
                & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    sizes = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    d = d.where(F.size("v") == (sizes[0]["n"] if sizes else 0))
    # rint of the quotient: floor() itself gives a long, which very large components exceed
    d = d.withColumn("v", F.transform("v", lambda c: F.rint(c * scale) - (F.rint(c * scale) > c * scale).cast("double")))
    return d.withColumn("key", F.xxhash64("label", "v"))


def _rows(batch: pa.RecordBatch):
    """(ids, labels, matrix, keys) of a batch, in chunks."""
    ids, labels, key = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "label", "key"))
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    for k in range(0, len(ids), CHUNK_ROWS):
        part = slice(k, k + CHUNK_ROWS)
        yield ids[part], labels[part], flat[part], key[part]


def _search(rows: DataFrame, block, k: int, wanted) -> DataFrame:
    """(slot, score, id, key): the first ``k`` rows of each slot.  ``wanted`` (block, anchors as
    a slice, scores, same label, other id) yields (slots, mask) for matrices of scores."""
    def search(batches):
        b = block.value
        best = Best(b["slots"], k)
        for batch in batches:
            for ids, labels, v, key in _rows(batch):
                for m in range(0, len(b["id"]), ANCHOR_ROWS):
                    part = slice(m, m + ANCHOR_ROWS)
                    s = inner_products(b["v"][part], v)
                    same, other = b["label"][part, None] == labels, b["id"][part, None] != ids
                    for slots, ok in wanted(b, part, s, same, other):
                        at, col = np.nonzero(ok & (s >= best.floor[slots][:, None]))
                        best.add(slots[at], s[at, col], ids[col], key[col])
        yield best.batch()

    return rows.mapInArrow(search, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "id", "key")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _positives(b, part, scores, same, other):
    yield np.arange(len(b["id"]))[part], same & other


def _negatives(b, part, scores, same, other):
    for n in range(b["low"].shape[1]):  # the n-th positive of each anchor
        yield b["slot"][part, n], (scores >= b["low"][part, n, None]) & (scores <= b["high"][part, n, None]) & ~same & other


def mine(df: DataFrame, is_anchor, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each row
    for which the column ``is_anchor`` (on the column ``id``) holds, the ``positives``
    best other rows of its label, and for each of these the first ``negatives`` rows of
    other labels with low * positive_score <= 100 * score <= high * positive_score."""
    spark = df.sparkSession
    rows = write_table(usable(df, vec_id, label, vector, scale), "negatives-rows")
    anchors = rows.where(is_anchor).distinct()
    head = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    blocks = -(-head["n"] * (head["dims"] or 1) // BLOCK_VALUES)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    paths = []
    for k in range(blocks):
        got = anchors.where(F.pmod(F.xxhash64("id", "key"), F.lit(blocks)) == k).collect()  # about BLOCK_VALUES components
        if not got:
            continue
        block = {"id": np.array([r["id"] for r in got]), "label": np.array([r["label"] for r in got]),
                 "v": np.array([r["v"] for r in got], np.float64), "slots": len(got)}
        shared = spark.sparkContext.broadcast(block)
        near = _first(_search(rows, shared, positives, _positives), positives).collect()  # a few for each anchor
        shared.unpersist()
        # of each anchor and place: the bounds of the negatives, empty where there is no positive
        shape = (len(got), positives)
        most = np.iinfo(np.int64).max
        block |= {"low": np.full(shape, most), "high": np.full(shape, -most), "slots": len(got) * positives,
                  "slot": np.arange(len(got) * positives).reshape(shape)}
        pairs = []
        for r in near:
            at = (r["slot"], r["rank"] - 1)
            block["low"][at], block["high"][at] = -(-low * r["score"] // 100), high * r["score"] // 100
            pairs.append((int(block["slot"][at]), int(block["id"][r["slot"]]), r["id"], r["score"]))
        shared = spark.sparkContext.broadcast(block)
        named = spark.createDataFrame(pairs, "slot long, anchor_id long, positive_id long, positive_score long")
        out = _first(_search(rows, shared, negatives, _negatives), negatives).join(named, "slot").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        paths.append(scratch_dir(spark, "negatives"))
        out.write.parquet(paths[-1])
        shared.unpersist()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def op13_kronecker_negatives(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", noisy), F.col("id") % ANCHOR_STEP == 0)


ORACLE = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_STEP} = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
 AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
