"""Mixing sources to target weights by Pfair scheduling (native).

A source's documents are cut into blocks of ``block_docs``.  A weight a / F
(a blocks in a frame of F slots) gives the j-th block of a source the release
time floor(j F / a) and the deadline ceil((j + 1) F / a).  Each slot of a
frame takes, of the blocks that are released, the one with the earliest
deadline (ties: first source).  As the weights add up to one, every deadline
is met: after any number of slots each source is less than one block away
from its share.

The schedule repeats with period F, so only one frame is scheduled (a fold
over F slots in one row; F depends on the weights, not on the data) and each
document finds its slot from its number within its source.  That number is a
two-level prefix count, so a source with a third of all rows is spread over
many tasks.

When a source ends, its later slots stay empty and the others move up: their
ratios stay as the weights say.  No document is dropped or repeated.

* null source: a source of its own; a source without a given weight gets
  the smallest one
* null ids, repeated rows: kept, ordered by id and text within their source
* empty table: empty result
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.functions.sequencing import dense_number
from depotline.llm.common import table, write_table

FRAME_SLOTS = 256
BLOCK_DOCS = 8


def root_weights(df: DataFrame, source: str = "source", slots: int = FRAME_SLOTS) -> DataFrame:
    """(_ll_src, _ll_quota): blocks in a frame of about ``slots``, in proportion to the
    square root of each source's documents and at least one."""
    n = df.groupBy(_source_key(source).alias("_ll_src")).agg(F.count(F.lit(1)).alias("_ll_n"))
    total = n.agg(F.sum(F.sqrt("_ll_n")).alias("_ll_total"))
    quota = F.floor(F.sqrt("_ll_n") * slots / F.col("_ll_total") + 0.5)
    return n.join(F.broadcast(total)).select(  # the total is one row
        "_ll_src", F.greatest(F.lit(1), quota).cast("int").alias("_ll_quota"))


def given_weights(df: DataFrame, weights: dict[str, float], source: str = "source",
                  slots: int = FRAME_SLOTS) -> DataFrame:
    """(_ll_src, _ll_quota) from weights by source name; others get one block."""
    total = sum(weights.values()) or 1.0
    given = [("s" + name, max(1, int(w * slots / total + 0.5))) for name, w in weights.items()]
    given = df.sparkSession.createDataFrame(given, "_ll_src string, _ll_quota int")
    return df.select(_source_key(source).alias("_ll_src")).distinct().join(given, "_ll_src", "left") \
             .select("_ll_src", F.coalesce("_ll_quota", F.lit(1)).alias("_ll_quota"))


def _source_key(source: str):
    """Never null, so that a null source joins; the null source sorts first."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def schedule_frame(quotas: DataFrame) -> DataFrame:
    """(_ll_src, _ll_quota, _ll_frame, _ll_slots): the slots of one frame, by
    source, from earliest-deadline-first.  One row per source.

    Only sources of several blocks (fewer than the frame was asked to have
    slots) are scheduled slot by slot, in one row.  The block of any other source
    is due at the frame's end, so these are due one after the other by name; the
    fold knows how many come before each of the scheduled names, and they take
    the slots that it leaves free."""
    quotas = write_table(quotas, "mix-quotas")
    many, ones = quotas.where("_ll_quota > 1"), quotas.where("_ll_quota <= 1").select("_ll_src")
    # a few figures that come to the driver: the frame's size and, for each scheduled source, its name and the others before it
    frame = quotas.agg(F.coalesce(F.sum("_ll_quota"), F.lit(0)).cast("int")).first()[0]
    names = sorted(r["_ll_src"] for r in many.select("_ll_src").collect())
    names = F.lit(names) if names else F.array().cast("array<string>")
    behind = ones.groupBy(F.size(F.filter(names, lambda m: m < F.col("_ll_src"))).alias("k")).count().collect()
    counts = {r["k"]: r["count"] for r in behind}  # at most one row more than there are scheduled sources
    before = F.lit(list(accumulate(counts.get(k, 0) for k in range(max(counts, default=0) + 1))))
    before = before[F.least(F.col("_ll_s._ll_i"), F.size(before) - 1)]
    numbered = many.withColumn("_ll_i", F.size(F.filter(names, lambda m: m < F.col("_ll_src"))))
    one = numbered.select(F.struct("_ll_src", "_ll_quota", "_ll_i").alias("_ll_s")) \
        .select(F.struct("_ll_s._ll_src", "_ll_s._ll_quota", before.alias("before")).alias("_ll_s")) \
        .agg(F.array_sort(F.collect_list("_ll_s")).alias("_ll_s"))
    one = one.select("_ll_s", F.lit(frame).alias("_ll_frame"), F.lit(sum(counts.values())).alias("_ll_n"))
    # done[i]: blocks of source i so far; ones: others so far; taken: (slot, source) of the scheduled blocks
    pick = """
      aggregate(sequence(0, _ll_frame - 1),
        named_struct('done', array_repeat(0, size(_ll_s)), 'ones', 0, 'taken', cast(array() as array<struct<t:int,i:int>>)),
        (st, t) -> aggregate(array(array_min(filter(transform(_ll_s, (s, i) -> named_struct(
              'due', if(st.done[i] < s._ll_quota and floor(st.done[i] * _ll_frame / s._ll_quota) <= t,
                        ceil((st.done[i] + 1) * _ll_frame / s._ll_quota), null), 'i', i)), x -> x.due is not null))),
            st, (w, best) -> if(
              w.ones < _ll_n and (best is null or (best.due = _ll_frame and w.ones < _ll_s[best.i].before)),
              named_struct('done', w.done, 'ones', w.ones + 1, 'taken', w.taken),
              named_struct('done', transform(w.done, (d, i) -> if(i = best.i, d + 1, d)), 'ones', w.ones,
                           'taken', concat(w.taken, array(named_struct('t', t, 'i', best.i)))))),
        st -> st.taken)"""
    taken = one.where("_ll_frame > 0").select("_ll_s", F.expr(pick).alias("_ll_taken"))
    src = taken.select("_ll_taken", F.posexplode("_ll_s").alias("_ll_i", "_ll_s"))
    slots = F.expr("transform(filter(_ll_taken, x -> x.i = _ll_i), x -> x.t)")
    scheduled = write_table(src.select("_ll_s._ll_src", "_ll_s._ll_quota", F.lit(frame).alias("_ll_frame"), slots.alias("_ll_slots")), "mix-scheduled")
    # the p-th free slot is p and the number of taken ones before it; one row per source here
    full = sorted(t for r in scheduled.select("_ll_slots").collect() for t in r["_ll_slots"])
    full = F.lit([t - j for j, t in enumerate(full)]) if full else F.array().cast("array<int>")
    place = ones.withColumn("_ll_p", F.row_number().over(Window.orderBy("_ll_src")) - 1)
    at = F.col("_ll_p") + F.size(F.filter(full, lambda y: y <= F.col("_ll_p")))
    return scheduled.unionByName(place.select("_ll_src", F.lit(1).alias("_ll_quota"), F.lit(frame).alias("_ll_frame"), F.array(at).alias("_ll_slots")))


def mix(df: DataFrame, quotas: DataFrame | None = None, *, source: str = "source",
        doc_id: str = "doc_id", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``df`` with ``block`` (number in its source), ``slot`` (of its block in the
    mix; each block has its own) and ``place`` (within the block), all long."""
    frame = write_table(schedule_frame(root_weights(df, source) if quotas is None else quotas), "mix-frame")
    # a spread-out order of 2^32 values: equal-sized buckets whatever the ids are
    key = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    num = dense_number(df.withColumn("_ll_src", _source_key(source)).withColumn("_ll_key", key.cast("long")),
                       ["_ll_src"], "_ll_key", "_ll_k", tiebreak=[doc_id])
    d = num.join(frame, "_ll_src").withColumn("block", F.expr(f"(_ll_k - 1) div {int(block_docs)}"))
    return d.withColumn("slot", F.expr("(block div _ll_quota) * _ll_frame + _ll_slots[int(block % _ll_quota)]")) \
            .withColumn("place", (F.col("_ll_k") - 1) % block_docs) \
            .drop("_ll_src", "_ll_key", "_ll_k", "_ll_quota", "_ll_frame", "_ll_slots")


def op5_pfair_mix(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
q AS (SELECT source, greatest(1, floor(sqrt(n) * {FRAME_SLOTS} / (SELECT sum(sqrt(n)) FROM n) + 0.5))::BIGINT AS a FROM n),
f AS (SELECT sum(a)::BIGINT AS f FROM q),
blocks AS (SELECT source, a, f, j, (j * f) // a AS release, ((j + 1) * f + a - 1) // a AS due
           FROM q, f, LATERAL (SELECT unnest(range(a)) AS j)),
names AS (SELECT list(source ORDER BY source) AS names FROM q),
step(t, done, src) AS (
  SELECT -1::BIGINT, list_transform(names, lambda x: 0::BIGINT), NULL::VARCHAR FROM names
  UNION ALL
  SELECT t + 1, list_transform(names, lambda x, i: done[i] + (x = src2)::BIGINT), src2
  FROM (SELECT s.t, s.done, names.names,
          (SELECT arg_min(b.source, (b.due, b.source)) FROM blocks b
           WHERE b.j = s.done[list_position(names.names, b.source)] AND b.release <= s.t + 1) AS src2
        FROM step s, names, f WHERE s.t + 1 < f.f)),
slots AS (SELECT src AS source, t, row_number() OVER (PARTITION BY src ORDER BY t) - 1 AS j FROM step WHERE t >= 0),
k AS (SELECT doc_id, source, row_number() OVER (
        PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT, doc_id) - 1 AS k FROM documents)
SELECT k.doc_id, k.source, k.k // {BLOCK_DOCS} AS block,
       ((k.k // {BLOCK_DOCS}) // q.a) * f.f + slots.t AS slot, k.k % {BLOCK_DOCS} AS place
FROM k JOIN q ON q.source IS NOT DISTINCT FROM k.source, f
JOIN slots ON slots.source = q.source AND slots.j = (k.k // {BLOCK_DOCS}) % q.a
"""
