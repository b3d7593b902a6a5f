"""Line dedup (native): drop the lines that many documents share.

Lines are exploded as (document, position, 128-bit hash of the normalised
line); distinct documents are counted per hash; the positions of frequent
hashes go back to their documents, which are put together again by position.
Only hashes and positions are exploded and grouped; each text is shuffled
once, to meet its dropped positions.

* null or empty text: one empty line; an empty key is never dropped
* a document is a (doc_id, text) pair, so exact repeats of a row count once
* a null id is an id like any other
* all lines dropped: the empty text
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import WHITE, ascii_lower, sha256_hex, table, text_or_empty, write_table

MIN_DOCS = 10
MIN_KEY_CHARS = 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def lines_of(text: str) -> Column:
    return F.split(text_or_empty(text), "\n")


def dropped_positions(df: DataFrame, *, text: str, doc_id: str, min_docs: int,
                      min_key_chars: int) -> DataFrame:
    """(_ll_id, _ll_h, _ll_drop): the 0-based positions that each document loses."""
    hashes = F.transform(lines_of(text), lambda x: F.when(
        F.char_length(line_key(x)) >= min_key_chars, F.unhex(F.md5(line_key(x).cast("binary")))))
    lines = write_table(
        df.select(F.col(doc_id).alias("_ll_id"), F.xxhash64(text_or_empty(text)).alias("_ll_h"),
                  F.posexplode(hashes).alias("_ll_pos", "_ll_key"))
          .where(F.col("_ll_key").isNotNull()), "lines")
    hot = write_table(
        lines.groupBy("_ll_key", "_ll_id", "_ll_h").agg(F.lit(1).alias("_ll_one"))
             .groupBy("_ll_key").agg(F.count(F.lit(1)).alias("_ll_docs"))
             .where(F.col("_ll_docs") >= min_docs).select("_ll_key"), "hot-lines")
    return lines.join(hot, "_ll_key").groupBy("_ll_id", "_ll_h") \
                .agg(F.collect_set("_ll_pos").alias("_ll_drop"))


def drop_common_lines(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                      min_docs: int = MIN_DOCS, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``df`` with ``text`` less its common lines, and ``n_lines``, ``n_dropped`` (long)."""
    drops = dropped_positions(df, text=text, doc_id=doc_id, min_docs=min_docs, min_key_chars=min_key_chars)
    left = df.withColumn("_ll_h0", F.xxhash64(text_or_empty(text)))
    both = left.join(drops, left[doc_id].eqNullSafe(drops["_ll_id"])
                     & (left["_ll_h0"] == drops["_ll_h"]), "left")
    n = F.size("_ll_lines")
    # 1-based places that stay, in order; array_except is hashed, so long documents stay linear
    keep = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_ll_drop"))
    kept = F.array_join(F.transform(keep, lambda i: F.get(F.col("_ll_lines"), i)), "\n")
    return (both.withColumn("_ll_lines", lines_of(text))
            .withColumn("n_lines", n.cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("_ll_drop"), F.lit(0)).cast("long"))
            .withColumn(text, F.when(F.col("_ll_drop").isNull(), text_or_empty(text)).otherwise(kept))
            .drop("_ll_lines", "_ll_h0", "_ll_id", "_ll_h", "_ll_drop"))


def op2_line_dedup(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                          sha256_hex(F.col("text")).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE key IN (FROM hot)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE key NOT IN (FROM hot)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
