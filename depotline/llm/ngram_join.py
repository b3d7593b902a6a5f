"""N-gram Jaccard join by grouped prefixes: all links of 0.8 or more, exactly.

A document's set holds the hashes of its distinct 5-word shingles (64 bits).
With t = 4/5, two sets of n <= m shingles can only be linked if n >= t m and
their overlap is at least t / (1 + t) (n + m).

1. Documents with equal sets form a class; a class goes through once.
2. Sift.  In any fixed order of the shingles, the first n - ceil(t n) + l of
   each of two linked sets share at least l.  With the order by hash and l of
   a tenth, only classes are kept of which enough of these few shingles occur
   in another class.
3. All shingles of the kept classes are counted and each set is ordered by
   (count, hash), rarest first.  Classes with fewer than ceil(t n) shingles
   that any other has can't be linked and go.
4. Grouped prefixes.  Classes with the same size and the same first
   n - ceil(t n) + 1 shingles form a group; only groups are listed by shingle.
5. Hubs.  Of the groups of a shingle, the most central (by the mean count of
   its shingles) is the hub.  Each class is verified against the hub most of
   its shingles name; the links give a first set of components.
6. Group pairs that share a shingle, that differ in component, and that pass
   the filters by size, by shared shingles and by the shingle's position, are
   expanded to members of different components and verified by overlap.

Steps 5 and 6 leave out only pairs inside a component that is already linked,
so components are exact, and a group of thousands of copies costs one check
each and not all their pairs.

* null or empty text: the empty set, linked with nothing
* a null id is linked with nothing (``component_id`` null); other columns pass
* repeated rows: the same class; the component is that of the id
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.llm.common import WHITE, drop_table, fit_batches, table, write_table
from depotline.llm.components import components
from depotline.llm.shingles import mixed, shingle_sets

SIZE = 5
NEED = "cast((4 * n + 4) div 5 as int)"  # ceil(4 n / 5)
SIFT = 10  # l is a tenth of the set
MOST_BITS = 1 << 26  # 8 MB
LIST = pa.list_(pa.int64())


def _sets(df: DataFrame, size: int, sift: bool) -> DataFrame:
    """(id, h, n, s): class hash, set size and, sorted by hash, the set or its sift prefix;
    columns of ``df`` after id and text follow."""
    more = df.columns[2:]

    def make(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for first, sets in shingle_sets(texts, size):
                n = np.array([len(s) for s in sets], np.int64)
                h = [int((mixed(s).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mixed(~s))).astype(np.int64))
                     if len(s) else None for s in sets]
                keep = np.minimum(n, n - (4 * n + 4) // 5 + -(-n // SIFT)) if sift else n
                values = np.concatenate([s[:k] for s, k in zip(sets, keep)] or [np.zeros(0, np.uint64)])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(keep)], pa.int32()),
                                                 pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)), pa.array(h, pa.int64()), pa.array(n), lists,
                     *[b.column(c).slice(first, len(sets)) for c in more]], ["id", "h", "n", "s", *more])

    return df.mapInArrow(make, ", ".join(["id long, h long, n long, s array<long>", *[
        f"`{c}` {df.schema[c].dataType.simpleString()}" for c in more]]))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of class hashes that are linked, by the overlap of their sets."""
    one, two = (sets.select(F.col("h").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b")
    o = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * o >= 80 * (F.col("na") + F.col("nb") - o)).select("a", "b")


def _possible(x: str, y: str) -> str:
    """By size, and by how many shingles of each occur elsewhere at all."""
    return (f"5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n)"
            f" and 9 * least({x}.k, {y}.k) >= 4 * ({x}.n + {y}.n)")


def sift(classes: DataFrame) -> DataFrame:
    """(id, h, n) of the classes that may have a link (step 2)."""
    shared = write_table(classes.select(F.explode("s").alias("t")).groupBy("t").count()
                         .where("count > 1").select("t"), "sift-shared")
    hits = classes.select("h", F.explode("s").alias("t")).join(shared, "t").groupBy("h").agg(F.count(F.lit(1)).alias("hits"))
    kept = write_table(classes.select("id", "h", "n").join(hits, "h").where(f"hits >= ceil({NEED} / {SIFT})")
                       .select("id", "h", "n"), "sifted")
    drop_table(shared)
    return kept


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def probably_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of ``docs`` whose id is in ``ids`` (id), and a few others: texts
    that can't be wanted need not be shuffled.  The ids are hashed into a bit
    map of 16 bits each and of at most ``MOST_BITS``, which is broadcast."""
    bits = min(MOST_BITS, 1 << max(16, (16 * ids.count()).bit_length()))

    def mark(batches):
        on = np.zeros(bits, bool)
        for b in batches:
            on[_bit(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        for part in np.flatnonzero(on.reshape(-1, 1 << 16).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(
                [np.packbits(on[part << 16:(part + 1) << 16]).tobytes()])], ["part", "raw"])

    def either(d):
        whole = np.bitwise_or.reduce(np.stack([np.frombuffer(r, np.uint8) for r in d["raw"]]))
        return d.head(1).assign(raw=[whole.tobytes()])

    found = np.zeros(bits // 8, np.uint8)
    marked = ids.select("id").mapInArrow(mark, "part int, raw binary").groupBy("part").applyInPandas(either, "part int, raw binary")
    for r in marked.collect():
        found[r["part"] << 13:(r["part"] + 1) << 13] = np.frombuffer(r["raw"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def pick(batches):
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            at = _bit(b.column(0).to_numpy(zero_copy_only=False), bits)
            hit = (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield b.filter(pa.array(hit.astype(bool)))

    return docs.mapInArrow(pick, docs.schema)


def wanted_sets(docs: DataFrame, kept: DataFrame, size: int) -> DataFrame:
    """The whole sets of the documents whose id is in ``kept``.  The texts are shuffled even if the ids
    could be broadcast: picking and hashing in one task would take two Python workers a core, which stay."""
    ids = kept.select(F.col("id").alias("_id")).distinct().hint("merge")
    texts = probably_in(docs, kept).join(ids, F.col("id") == F.col("_id")).select("id", "text")
    return _sets(texts, size, sift=False)


def ordered_sets(docs: DataFrame, kept: DataFrame, size: int) -> DataFrame:
    """(h, n, k, centre, s): the ``k`` shingles of a class that others have, rarest
    first, and the mean count of all ``n`` (step 3)."""
    own = kept.select(F.col("id").alias("_id"), F.col("h").alias("_h"))
    # an id that several rows have brings all their texts; only the class it stands for is meant
    sets = write_table(wanted_sets(docs, kept, size), "kept-sets")
    if sets.count() != kept.count():
        again = write_table(sets.join(own, (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
                            .dropDuplicates(["h"]), "kept-sets")
        drop_table(sets)
        sets = again
    counts = write_table(sets.select(F.explode("s").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
                         .where("c > 1"), "shingle-counts")
    listed = sets.select("h", "n", F.explode("s").alias("t")).join(counts, "t") \
                 .groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ct"))
    out = write_table(
        listed.withColumn("k", F.size("ct").cast("long")).where(f"k >= {NEED}")
              .select("h", "n", "k", F.expr("(aggregate(ct, 0L, (x, y) -> x + y.c) + n - k) / n").alias("centre"),
                      F.col("ct.t").alias("s")), "ordered-sets")
    drop_table(sets)
    drop_table(counts)
    return out


def link_classes(sets: DataFrame) -> DataFrame:
    """(node, comp) of the linked classes (steps 4 to 6)."""
    prefix = F.expr(f"slice(s, 1, cast(k as int) - {NEED} + 1)")
    member = write_table(sets.select("h", "n", "k", "centre", prefix.alias("p"))
                         .withColumn("g", F.xxhash64("n", "k", "p")), "members")
    group = member.groupBy("g").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("p").alias("p"),
                                    F.max(F.struct("centre", "h")).alias("best"))
    posting = write_table(group.select("g", "n", "k", "best", F.posexplode("p").alias("i", "t"))
                          .withColumn("i", F.col("i") + F.col("n") - F.col("k")), "postings")

    # hubs
    hub = write_table(posting.groupBy("t").agg(F.max("best").alias("hub"), F.count(F.lit(1)).alias("c"))
                      .where("c > 1").select("t", F.col("hub.h").alias("b")), "hubs")
    votes = posting.select("g", "t").join(hub, "t").groupBy("g", "b").agg(F.count(F.lit(1)).alias("v")) \
                   .groupBy("g").agg(F.max_by("b", F.struct("v", "b")).alias("b"))
    # a group of one shared prefix and several members is checked against its own best member if no other is named
    own = group.select("g", F.col("best.h").alias("own"))
    asked = member.join(votes, "g", "left").join(own, "g").select(F.col("h").alias("a"), F.coalesce("b", "own").alias("b"))
    pairs = write_table(asked.where("a <> b"), "hub-pairs")
    links = write_table(_linked(pairs, sets), "hub-links")
    first = components(links)

    # pairs of groups across components
    placed = write_table(member.select("h", "g").join(first.withColumnRenamed("node", "h"), "h", "left")
                         .withColumn("comp", F.coalesce("comp", "h")), "placed")
    span = placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")) \
                 .select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("comp"), "m")
    listed = write_table(posting.select("t", "g", "n", "k", "i").join(span, "g"), "listed")
    sizes = listed.groupBy("t", "comp").agg(F.sum("m").alias("m"))
    block = sizes.groupBy("t").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"),
                                   F.max(F.col("comp").isNull()).alias("mixed")).where("parts > 1 or mixed")
    block = write_table(block.select("t", "main"), "blocks")
    many = listed.join(block, "t")
    x = many.where("comp is null or main is null or comp <> main").select("t", "g", "n", "k", "i", "comp").alias("x")
    y = many.select("t", "g", "n", "k", "i", "comp").alias("y")
    met = write_table(x, "minor").alias("x").join(write_table(y, "all").alias("y"), F.expr(
        "x.t = y.t and (x.comp is null or y.comp is null or x.comp <> y.comp)"
        f" and {_possible('x', 'y')} and 9 * least(x.n - x.i, y.n - y.i) >= 4 * (x.n + y.n)"))
    groups = write_table(met.select(F.least("x.g", "y.g").alias("g1"), F.greatest("x.g", "y.g").alias("g2")).distinct(),
                         "group-pairs")
    m1, m2 = (placed.select(F.col("g").alias(f"g{i}"), F.col("h").alias(k), F.col("comp").alias(f"c{i}"))
              for i, k in ((1, "a"), (2, "b")))
    across = groups.join(m1, "g1").join(m2, "g2").where("c1 <> c2 and (g1 <> g2 or a < b)").select("a", "b")
    more = write_table(_linked(write_table(across, "cross-pairs"), sets), "cross-links")
    return components(links.unionByName(more))


def narrow(rows: DataFrame, *cols: str) -> DataFrame:
    """A copy of a written table with fewer columns, in its place."""
    out = write_table(rows.select(*cols), "narrow")
    drop_table(rows)
    return out


def linked_rows(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, n, h, ...) of ``docs`` (id, text, ...), and for each class (h) of documents
    with shingles its smallest id and its component (a class; null: without links)."""
    more = docs.columns[2:]
    fit_batches(docs.sparkSession)
    rows = write_table(_sets(docs, size, sift=True), "sift-sets")
    classes = write_table(rows.where("n > 0 and id is not null").groupBy("h")
                          .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("s").alias("s")), "classes")
    kept = sift(classes)
    # the lists of shingles are the bulk of both tables and not needed any more
    rows, classes = narrow(rows, "id", "n", "h", *more), narrow(classes, "h", "id")
    linked = link_classes(ordered_sets(docs.select("id", "text"), kept, size)).select(F.col("node").alias("h"), "comp")
    return rows, write_table(classes.join(linked, "h", "left"), "linked-classes")


def near_duplicates(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id."""
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows, classes = linked_rows(docs, size)
    root = classes.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = write_table(classes.join(root, "comp", "left")
                           .select("h", F.coalesce("component_id", "id").alias("component_id")), "class-components")
    return rows.select("id", "n", "h").join(of_class, "h", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``df`` with one row of each group of linked or equal documents: that of the smallest id
    (rows of one id: of the smallest hash of the text).  Rows without an id or
    without words stay, and so do rows that share an id and aren't linked."""
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    wordless = F.coalesce(F.translate(t, WHITE, ""), F.lit("")) == ""
    alone = F.col(doc_id).isNull() | wordless
    docs = df.where(~alone).select(i.alias("id"), t.alias("text"), F.xxhash64(t).alias("x"))
    rows, classes = linked_rows(docs, size)
    group = rows.join(classes.select("h", "comp"), "h").groupBy(F.coalesce("comp", "h"))
    first = group.agg(F.min(F.struct("id", "x")).alias("f")).select(F.col("f.id").alias("_ll_id"), F.col("f.x").alias("_ll_x"))
    kept = df.where(~alone).join(first, (i == F.col("_ll_id")) & (F.xxhash64(t) == F.col("_ll_x")))
    one = Window.partitionBy("_ll_id", "_ll_x").orderBy("_ll_id")  # exact repeats
    kept = kept.withColumn("_ll_n", F.row_number().over(one)).where("_ll_n = 1").drop("_ll_n", "_ll_id", "_ll_x")
    return kept.unionByName(df.where(alone))


def op7_grouped_prefix_join(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
