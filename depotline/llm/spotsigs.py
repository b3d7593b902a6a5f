"""SpotSigs document fingerprints (native).

A spot signature is a common word (an anchor) with the first ``CHAIN`` content
words that follow it within ``SPAN`` words; anchors are passed over.  A text's
fingerprint is the set of its signatures, each as 8 hex digits of its MD5, in
order and separated by blanks.  The likeness of two fingerprints is the
Jaccard coefficient of the sets.

``similar_pairs`` compares all documents: equal fingerprints form one class;
classes are dealt by set length into partitions whose bounds grow by the
threshold, so that only neighbouring partitions can hold similar sets; within
them only classes that share one of their rarest signatures meet, and only if
set lengths and the signature's position still allow the threshold.

* null text: the empty text; its fingerprint is the empty string
* a text without a signature: one signature of all its words (or of the text
  itself, without words), so that only such equal texts are alike
* two empty fingerprints: likeness 1; one: 0
* equal texts have equal fingerprints; repeated rows are fingerprinted each
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotline.llm.common import sha256_hex, shuffle_partitions, table, text_or_empty, write_table
from depotline.llm.pii import let

CHAIN = 2
SPAN = 12
SIMILAR = 0.8
# Frequent function words of four languages, in alphabetical order.
ANCHORS = ("a", "al", "als", "an", "and", "are", "as", "at", "au", "auf", "be", "by", "con", "dans", "das", "de", "del",
           "dem", "den", "der", "des", "die", "du", "ein", "eine", "el", "en", "er", "es", "est", "et", "for", "from",
           "für", "have", "he", "ich", "il", "im", "in", "is", "ist", "it", "la", "las", "le", "les", "los", "mit",
           "nicht", "not", "of", "on", "or", "ou", "para", "pas", "por", "pour", "que", "qui", "se", "sich", "sie",
           "sind", "sur", "that", "the", "this", "to", "un", "una", "und", "une", "von", "was", "with", "y", "zu")


def is_anchor(w: Column) -> Column:
    return w.isin(*ANCHORS)


def signatures(text: Column) -> Column:
    """Sorted array of the distinct signatures of a text (not null), as 8 hex digits."""
    def short(s: Column) -> Column:
        return F.substring(F.md5(s.cast("binary")), 1, 8)

    def spots(words: Column) -> Column:
        def spot(w, i):
            chain = F.slice(F.filter(F.slice(words, i + 2, SPAN), lambda x: ~is_anchor(x)), 1, CHAIN)
            return F.when(is_anchor(w), let(chain, lambda c: F.when(
                F.size(c) == CHAIN, short(F.concat_ws(":", w, c)))))
        return F.filter(F.transform(words, spot), lambda s: s.isNotNull())

    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    whole = F.array(short(F.when(plain != "", plain).otherwise(text)))
    found = let(F.split(plain, " "), spots)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        let(found, lambda s: F.when(F.size(s) > 0, F.array_sort(F.array_distinct(s))).otherwise(whole)))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs, " ")


def signatures_of(fp: Column) -> Column:
    return F.when(fp == "", F.array().cast("array<string>")).otherwise(F.split(fp, " "))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature arrays."""
    return let(F.size(F.array_intersect(a, b)), lambda o: F.when(
        F.size(a) + F.size(b) == 0, 1.0).otherwise(o / (F.size(a) + F.size(b) - o)))


def similar_pairs(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
                  threshold: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of class ids with a < b and a likeness of at
    least ``threshold``; members (doc_id, class).  Rows without signatures are in no class."""
    sigs = df.select(F.col(doc_id).alias("doc_id"), signatures(text_or_empty(text)).alias("s")) \
             .where(F.size("s") > 0).withColumn("class", F.xxhash64(fingerprint(F.col("s"))))
    sigs = write_table(sigs, "spot-signatures")
    classes = write_table(sigs.groupBy("class").agg(F.first("s").alias("s")), "spot-classes")
    counts = write_table(classes.select(F.explode("s").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")),
                         "spot-counts")
    ranked = classes.select("class", F.explode("s").alias("t")).join(counts, "t").groupBy("class") \
                    .agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ct"))
    n = F.size("ct")
    least = F.ceil(n * threshold - 1e-9).cast("int")
    # partition p holds the set lengths from threshold^-p up to threshold^-(p+1)
    part = F.floor(F.log(n.cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold)) + 1e-9).cast("int")
    posting = ranked.select("class", n.alias("n"), part.alias("p"), F.posexplode(F.slice("ct.t", 1, n - least + 1)).alias("i", "t"))
    posting = write_table(posting.join(counts.where("c > 1"), "t"), "spot-postings")
    # the longer set looks into its own partition and the one below
    x = posting.withColumn("q", F.explode(F.array("p", F.col("p") - 1))).alias("x")
    y = posting.withColumn("q", F.col("p")).alias("y")
    most = f"(x.n + y.n) * {threshold / (1 + threshold)} - 1e-9"
    met = x.join(y, F.expr(
        f"x.t = y.t and x.q = y.q and (x.n > y.n or (x.n = y.n and x.class > y.class)) and y.n >= x.n * {threshold} - 1e-9"
        f" and least(x.n - x.i, y.n - y.i) >= {most}"))
    met = met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
    one, two = (classes.select(F.col("class").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    pairs = met.join(one, "a").join(two, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-12), sigs.select("doc_id", "class")


def next_by_id(ids: DataFrame) -> DataFrame:
    """(doc_id, take, to_id): for each id, the id that comes just before it in descending
    order (after the last one comes the first) and that id's ``take``.

    Ids are dealt by range into many small written buckets; a window sees one
    bucket, and one more window a row per bucket."""
    spark = ids.sparkSession
    dealt = write_table(ids.repartitionByRange(4 * shuffle_partitions(spark), F.desc("doc_id"))
                        .withColumn("bucket", F.spark_partition_id()), "id-ranges")
    w = Window.partitionBy("bucket").orderBy(F.desc("doc_id"))
    rows = dealt.select("bucket", "doc_id", F.lag(F.struct("doc_id", "take")).over(w).alias("before"))
    ends = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "take")).alias("last"))
    over = Window.orderBy("bucket")
    wide = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("bucket", F.coalesce(F.lag("last").over(over), F.last("last").over(wide)).alias("end"))
    return rows.join(ends, "bucket").select("doc_id", F.coalesce("before", "end").alias("b")) \
               .select("doc_id", F.col("b.doc_id").alias("to_id"), F.col("b.take").alias("take"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness; and
    that to the next document (by descending id).

    A document's beginning and its signatures travel to the document before it;
    whole texts are shuffled once.  Of rows that share an id the first by text
    is the next document; a row without an id has none (nothing is appended,
    ``near_next`` is 0)."""
    texts = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    ids = texts.groupBy("doc_id").agg(F.max(F.expr("char_length(text) div 3")).alias("take"))
    links = write_table(next_by_id(ids), "next-by-id")
    first = Window.partitionBy("doc_id").orderBy("text")
    # both joins read the same shuffle of the texts
    sent = texts.join(links, "doc_id").withColumn("r", F.row_number().over(first)).where("r = 1")
    sent = sent.select(F.col("to_id").alias("doc_id"), F.expr("left(text, int(take))").alias("head"),
                       F.unhex(F.array_join(signatures(F.col("text")), "")).alias("next_sigs"))
    both = texts.join(sent, "doc_id", "left").unionByName(
        docs.where("doc_id is null").select("doc_id", text_or_empty().alias("text")), allowMissingColumns=True)
    cut = "char_length(text) div 3"
    d = both.select("doc_id", "text", F.expr("char_length(text)").cast("long").alias("n_chars"), "next_sigs",
                    F.expr(f"concat(left(text, int(char_length(text) - {cut})), "
                           f"left(coalesce(head, ''), int({cut})))").alias("edited"))
    d = d.withColumns({"sigs": signatures(F.col("text")), "edited_sigs": signatures(F.col("edited"))})
    hexed = F.lower(F.hex("next_sigs"))
    next_sigs = F.when(F.col("next_sigs").isNotNull(), F.regexp_extract_all(hexed, F.lit("[0-9a-f]{8}"), 0))
    return d.select("doc_id", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"),
                    fingerprint(F.col("sigs")).alias("fingerprint"),
                    fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                    likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                    F.coalesce(likeness(F.col("sigs"), next_sigs), F.lit(0.0)).alias("near_next"))


def op1_spotsigs(spark, sf_dir) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents", "doc_id", "text"))


_LIST = "[" + ", ".join(f"'{w}'" for w in ANCHORS) + "]"


def _sql_signatures(text: str) -> str:
    plain = rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    chain = (f"list_filter(words[i + 1:i + {SPAN}], lambda x: NOT list_contains({_LIST}, x))[1:{CHAIN}]")
    return f"""(SELECT CASE WHEN {text} = '' THEN []
        WHEN len(s) > 0 THEN list_sort(list_distinct(s))
        ELSE [substr(md5(CASE WHEN plain <> '' THEN plain ELSE {text} END), 1, 8)] END
      FROM (SELECT plain, list_filter(list_transform(words, lambda w, i: CASE WHEN list_contains({_LIST}, w)
                AND len({chain}) = {CHAIN} THEN substr(md5(w || ':' || array_to_string({chain}, ':')), 1, 8) END),
                lambda x: x IS NOT NULL) AS s
            FROM (SELECT {plain} AS plain, string_split({plain}, ' ') AS words)))"""


def _sql_likeness(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, length(text) // 3 AS cut,
             coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next
      FROM d),
e AS (SELECT *, substr(text, 1, n - cut) || substr(next, 1, cut) AS edited FROM n),
s AS (SELECT doc_id, n, edited, {_sql_signatures('text')} AS a, {_sql_signatures('edited')} AS b,
             {_sql_signatures('next')} AS c FROM e)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, ' ') AS fingerprint,
       array_to_string(b, ' ') AS edited_fingerprint, {_sql_likeness('a', 'b')} AS near_edited,
       {_sql_likeness('a', 'c')} AS near_next
FROM s
"""
