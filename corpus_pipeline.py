"""The text pipeline: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's rows to the shared folder and hands the table to the next one.
All stages but the last return the columns of ``documents``.

* language: documents in no language (null, empty or without letters) go
* lines: lines that many documents share go; ``n_chars`` follows the text
* near_duplicates: of each group of near copies the smallest id stays
* mix: nothing goes; rows come out in the order of the mix, in files by range
* pack: one row per piece of each document, with its sequence and offset; sequences
  and the pieces in them follow the order of the mix
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotline.llm import langid, line_dedup, mixing, ngram_join, packing
from depotline.llm.common import DOCUMENT_COLUMNS, shuffle_partitions, write_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    if not model.langs:  # no labels to learn from
        return langid.with_letters(docs.select(DOCUMENT_COLUMNS)).select(DOCUMENT_COLUMNS)
    found = langid.identify(docs.select(DOCUMENT_COLUMNS), model)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(DOCUMENT_COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(docs.select(DOCUMENT_COLUMNS))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", length).select(DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs.select(DOCUMENT_COLUMNS)).select(DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(DOCUMENT_COLUMNS))
    return mixed.repartitionByRange(shuffle_partitions(spark), "slot", "place") \
                .sortWithinPartitions("slot", "place").select(DOCUMENT_COLUMNS)


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``: the place of each row in the order it was written in, by file and
    row.  Rows that come from no files have no such order and are left as they are."""
    if not docs.inputFiles():
        return docs
    rows = docs.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = docs.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    # one row for each file
    before = sizes.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").withColumn("position", F.col("before") + F.col("row")).drop("file", "row", "before")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = in_file_order(docs)
    return packing.pack_documents(docs, packing.default_tokenizer(), position="position" if "position" in docs.columns else None)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

# The language model and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
