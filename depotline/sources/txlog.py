"""Transaction-log ingest: ordered text records, one multi-line type.

Record formats (one letter dispatches):

    N,c_id,w_id,d_id,m      followed by m lines  i_id,supply_w_id,qty
    P,w_id,d_id,c_id,amount
    D,w_id,carrier_id
    O,w_id,d_id,c_id
    S,w_id,d_id,threshold,last_l
    I,w_id,d_id,last_l
    T
    R,w_id,d_id,c_id

A blank line ends its file (later lines are dropped).  Malformed records
(unknown letter, wrong arity, empty or non-numeric field, wrong number of N
lines, lines before the first header) go to the error frame; they never
abort the job.

The line order of a file is rebuilt from (file_block_start, row id); the number of
a line, of its record and of the record's header line are running aggregates in
that order, bucketed, so one huge file is still processed by many tasks.  A
record's lines stay rows (``parse_rows``): its header knows how many there are and
how many are bad from sums, so no record is gathered, however long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.functions.sequencing import running_aggs

# Number of fields of the header of each record type.
ARITY = {"N": 5, "P": 5, "D": 3, "O": 4, "S": 5, "I": 4, "T": 1, "R": 4}
# Field names after the letter, per type.
FIELDS = {
    "N": ["c_id", "w_id", "d_id", "n_lines"],
    "P": ["w_id", "d_id", "c_id", "amount"],
    "D": ["w_id", "carrier_id"],
    "O": ["w_id", "d_id", "c_id"],
    "S": ["w_id", "d_id", "threshold", "last_l"],
    "I": ["w_id", "d_id", "last_l"],
    "T": [],
    "R": ["w_id", "d_id", "c_id"],
}

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> (file, block, pos, value) with a total order per file."""
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
    return df


TYPES = {"amount": "decimal(12,2)", "c_id": "long"}  # all other fields are int
VALUES = ["c_id", "w_id", "d_id", "n_lines", "carrier_id", "threshold", "last_l", "amount"]


def number_lines(lines: DataFrame, order_col: str = "block", tiebreak: Iterable[str] = ("pos",)) -> DataFrame:
    """(file, line_no, record_no, hdr_no, is_hdr, value): the lines up to their file's first
    blank line, with their own number, their record's and that of its header line."""
    v = F.col("value")
    l = lines.withColumn("is_hdr", v.rlike("^[A-Za-z]").cast("long")) \
             .withColumn("is_blank", (F.trim(v) == "").cast("long")).withColumn("_one", F.lit(1).cast("long"))
    l = running_aggs(l, ["file"], order_col, [("is_hdr", "record_no", "sum", True), ("is_blank", "_blanks", "sum", True),
                                             ("_one", "line_no", "sum", True)], tiebreak=list(tiebreak))
    l = l.where(F.col("_blanks") == 0)
    return l.select("file", "line_no", "record_no", F.col("is_hdr") == 1, "value").toDF(
        "file", "line_no", "record_no", "is_hdr", "value")


def parse_rows(lines: DataFrame, order_col: str = "block", tiebreak: Iterable[str] = ("pos",), skip: Iterable[str] = (),
               store: Callable[[str, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(file, <order>, value) lines -> (records, order lines, orphans).

    records: file, record_no, txn_type, the typed fields of FIELDS, reason (null: valid)
    and text; order lines (file, record_no, ol_number, i_id, supply_w_id, qty) of the
    valid N records; orphans: lines before the first header of their file, as errors.
    ``skip`` drops whole record types (A9).  ``store`` writes the numbered lines
    under a name and reads them back: the text is then scanned once."""
    l = number_lines(lines, order_col, tiebreak)
    l = (store("log_lines", l) if store else l).withColumn("f", F.split("value", ",", -1))
    orphan = l.where(F.col("record_no") == 0).select(
        "file", "record_no", F.lit("line before first header").alias("reason"), F.col("value").alias("text"))

    field = lambda n, kind: F.trim(F.get("f", n)).try_cast(kind)
    body = l.where(~F.col("is_hdr") & (F.col("record_no") > 0)).select(
        "file", "record_no", "line_no", field(0, "long").alias("i_id"), field(1, "int").alias("supply_w_id"),
        field(2, "int").alias("qty"), F.size("f").alias("_nf"))
    bad_line = (F.col("_nf") != 3) | F.col("i_id").isNull() | F.col("supply_w_id").isNull() | F.col("qty").isNull()
    per_record = body.groupBy("file", "record_no").agg(F.count(F.lit(1)).alias("_lines"), F.count_if(bad_line).alias("_bad"))

    letter, nf = F.element_at("f", 1), F.size("f")
    arity = F.create_map(*[x for k, a in ARITY.items() for x in (F.lit(k), F.lit(a))])
    values, raws = [], []
    for name in VALUES:
        at = F.create_map(*[x for k, fs in FIELDS.items() if name in fs for x in (F.lit(k), F.lit(fs.index(name) + 1))])
        raw = F.when(nf > at[letter], F.get("f", at[letter]))
        values.append(F.trim(raw).try_cast(TYPES.get(name, "int")).alias(name))
        raws.append(raw.alias(f"_raw_{name}"))
    h = l.where("is_hdr").select("file", "record_no", F.col("line_no").alias("_hdr"), letter.alias("txn_type"), nf.alias("_nf"),
                                 F.col("value").alias("text"), *values, *raws)
    h = h.join(per_record, ["file", "record_no"], "left") \
         .withColumn("_lines", F.coalesce("_lines", F.lit(0))).withColumn("_bad", F.coalesce("_bad", F.lit(0)))
    bad_field = F.lit(False)
    for name in VALUES:
        bad_field = bad_field | (F.col(f"_raw_{name}").isNotNull() & F.col(name).isNull())
    kind = F.col("txn_type")
    reason = (F.when(arity[kind].isNull(), F.lit("unknown record type"))
               .when(F.col("_nf") != arity[kind], F.lit("wrong number of fields"))
               .when(bad_field, F.lit("empty or non-numeric field"))
               .when((kind == "N") & (F.col("_lines") != F.col("n_lines")), F.lit("wrong number of order lines"))
               .when((kind != "N") & (F.col("_lines") > 0), F.lit("unexpected lines"))
               .when(F.col("_bad") > 0, F.lit("bad order line")))
    records = h.select("file", "record_no", "txn_type", *VALUES, reason.alias("reason"), "text", "_hdr")
    if skip:
        records = records.where(~kind.isin(list(skip)))
    own = records.where((kind == "N") & F.col("reason").isNull()).select("file", "record_no", "_hdr")
    order_lines = body.join(own, ["file", "record_no"]).select(
        "file", "record_no", (F.col("line_no") - F.col("_hdr")).cast("int").alias("ol_number"), "i_id", "supply_w_id", "qty")
    return records.drop("_hdr"), order_lines, orphan


def valid_and_errors(records: DataFrame, orphan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid records, and (file, record_no, reason, text) of the others and the orphans."""
    errors = records.where(F.col("reason").isNotNull()).select("file", "record_no", "reason", "text").unionByName(orphan)
    return records.where(F.col("reason").isNull()).drop("reason", "text"), errors


def parse_txlog(lines: DataFrame, order_col: str = "block", tiebreak: Iterable[str] = ("pos",),
                skip: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(file, <order>, value) lines -> (records, errors), each N record with its lines as
    an array ``lines`` in file order.  For logs whose orders are of usual size; jobs
    over whole logs use ``parse_rows``."""
    typed, order_lines, orphan = parse_rows(lines, order_col, tiebreak, skip)
    records, errors = valid_and_errors(typed, orphan)
    item = F.struct("i_id", "supply_w_id", "qty")
    arrays = order_lines.groupBy("file", "record_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ol_number", item.alias("l")))), lambda x: x["l"]).alias("lines"))
    records = records.join(arrays, ["file", "record_no"], "left")
    return records.withColumn("lines", F.coalesce("lines", F.array().cast(arrays.schema["lines"].dataType))), errors


def write_log(lines: DataFrame, path: str) -> None:
    """Rendered lines (pos, line_no, value) -> text files below ``path``, whose order by
    name is the order of ``pos``; a record's lines are in one file."""
    lines.repartitionByRange("pos").sortWithinPartitions("pos", "line_no").select("value") \
         .write.mode("overwrite").text(path)


def read_txlog(spark: SparkSession, path: str, skip: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A6 + A9: read text logs under ``path`` and parse them."""
    return parse_txlog(read_lines(spark, path), "block", ("pos",), skip)


def client_interleave(records: DataFrame) -> DataFrame:
    """ord = (record number in file, client index): round-robin over client
    files, deterministic.  The client index is the file's rank by name."""
    files = records.select("file").distinct()
    from pyspark.sql import Window
    # one row per client file (a handful of files per run)
    files = files.withColumn("client", F.row_number().over(Window.orderBy("file")) - 1)
    n = files.select(F.count(F.lit(1))).scalar()
    r = records.join(files, "file", "inner")
    return r.withColumn("ord", F.col("record_no") * n + F.col("client"))


def render_log(n_hdr: DataFrame, n_lines: DataFrame, pay: DataFrame, dlv: DataFrame,
               status: DataFrame, reads: DataFrame | None = None, file: str = "log") -> DataFrame:
    """Log frames -> text lines (file, pos, line_no, value) in order of (pos, line_no):
    pos is the record's ord, line_no 0 for its header."""
    cnt = n_lines.groupBy("ord").agg(F.count(F.lit(1)).alias("m"))
    h = n_hdr.join(cnt, "ord", "left").select(
        F.col("ord").alias("pos"), F.lit(0).alias("line_no"),
        F.concat_ws(",", F.lit("N"), "c_id", "w_id", "d_id",
                    F.coalesce(F.col("m"), F.lit(0)).cast("string")).alias("value"))
    nl = n_lines.select(F.col("ord").alias("pos"), F.col("ol_number").cast("int").alias("line_no"),
                        F.concat_ws(",", "i_id", "supply_w_id", "qty").alias("value"))
    p = pay.select(F.col("ord").alias("pos"), F.lit(0).alias("line_no"),
                   F.concat_ws(",", F.lit("P"), "w_id", "d_id", "c_id",
                               F.col("amount").cast("string")).alias("value"))
    d = dlv.select(F.col("ord").alias("pos"), F.lit(0).alias("line_no"),
                   F.concat_ws(",", F.lit("D"), "w_id", "carrier_id").alias("value"))
    o = status.select(F.col("ord").alias("pos"), F.lit(0).alias("line_no"),
                      F.concat_ws(",", F.lit("O"), "w_id", "d_id", "c_id").alias("value"))
    out = h.unionByName(nl).unionByName(p).unionByName(d).unionByName(o)
    if reads is not None:  # one text form per letter, fields in the order of FIELDS
        text = F.lit(None).cast("string")
        for kind in ("S", "I", "T", "R"):
            text = F.when(F.col("txn_type") == kind, F.concat_ws(",", F.lit(kind), *FIELDS[kind])).otherwise(text)
        out = out.unionByName(reads.select(F.col("ord").alias("pos"), F.lit(0).alias("line_no"), text.alias("value")))
    return out.withColumn("file", F.lit(file))
