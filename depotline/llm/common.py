"""Helpers shared by the text operators: tables, scratch folders, small columns."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.session import _size, ensure_checkpoint_dir

# The ASCII white space of the contracts and the ASCII letters.
WHITE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FOLDS = 4
HELD_OUT_FOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Later jobs restart from the files, so a lost executor costs only its
    running tasks, and the planner knows the table's size.
    """
    path, conf = scratch_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN_SHUFFLES, "false")
    conf.set(CLEAN_SHUFFLES, "true")  # once the table is there, its job's shuffle files are not needed
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_SHUFFLES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


# Bytes of the rows that go to a Python worker at once: a batch is held several times over, by
# the executor, by Arrow and as Python strings.
BATCH_BYTES = 2 << 20


def fit_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most ``BATCH_BYTES`` (a longer row is one of its
    own).  Batches only ever get smaller; for functions that work row by row."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _size(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a :func:`write_table` result that no plan reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; text without other letters takes the faster ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)) \
            .otherwise(F.translate(c, UPPER, LOWER))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id is in fold 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def with_text_columns(df: DataFrame, text: str, schema: str, f) -> DataFrame:
    """``df`` with the columns of ``schema``, which ``f`` makes from the list of a
    batch's texts.  Other columns pass through as they are; columns of the
    same names are replaced."""
    new = T.StructType.fromDDL(schema)
    old = [x for x in df.columns if x not in new.names]

    def add(batches):
        for b in batches:
            made = f(b.column(b.schema.get_field_index("_ll_text")).to_pylist())
            cols = [b.column(i) for i in range(len(old))]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(m) for m in made]], [*old, *new.names])

    out = T.StructType([*[df.schema[x] for x in old], *new.fields])
    return df.select(*old, F.col(text).cast("string").alias("_ll_text")).mapInArrow(add, out)
