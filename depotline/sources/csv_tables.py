"""Typed load of headerless CSV base tables (A1) and fixed-point decoding (A2).

Files follow the wholesale layouts of ``depotline.schema.CSV_SCHEMAS``; the
null literal is the text ``null``; malformed rows are kept apart (never
dropped silently).  Money may arrive scaled x100 and rates x10000 as integers;
``from_scaled`` turns them into exact decimals (integer arithmetic, no float).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.functions.money import MONEY, RATE
from depotline.schema import CSV_SCHEMAS

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"

# Fixed scaling of the integer-encoded columns.
MONEY_COLS = {
    "warehouse": ["w_ytd"], "district": ["d_ytd"],
    "customer": ["c_credit_lim", "c_balance", "c_ytd_payment"],
    "item": ["i_price"], "stock": ["s_ytd"], "orderline": ["ol_amount"],
}
RATE_COLS = {"warehouse": ["w_tax"], "district": ["d_tax"], "customer": ["c_discount"]}


# A quote inside quotes is doubled.
OPTIONS = {"nullValue": "null", "timestampFormat": TS_FORMAT, "escape": '"',
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def parse_lines(lines: DataFrame, name: str) -> DataFrame:
    """Lines (value) -> the columns of table ``name`` and ``bad_text``: the line itself where it
    does not fit the declared schema, else null.  Empty lines are no rows.  Good and bad rows come
    out of one pass over the text."""
    schema = T.StructType(CSV_SCHEMAS[name].fields + [T.StructField("bad_text", T.StringType())])
    row = F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                     {**OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_text"})
    return lines.where(F.length(F.trim("value")) > 0).select(row.alias("_r")).select("_r.*")


def read_rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a folder of headerless files, good and bad, see ``parse_lines``."""
    return parse_lines(spark.read.text(path), name)


def load_table(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """-> (rows, bad_rows).  bad_rows keeps the raw text of rows that do not
    fit the declared schema."""
    df = read_rows(spark, path, name)
    bad = df.where(F.col("bad_text").isNotNull()).select(F.col("bad_text").alias("text"))
    return df.where(F.col("bad_text").isNull()).drop("bad_text"), bad


def csv_lines(df: DataFrame, name: str) -> DataFrame:
    """Rows of table ``name`` (decimal form) as lines (value) of its file layout; columns that
    ``df`` lacks are written as null."""
    scaled = to_scaled(df, name)
    cols = [F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CSV_SCHEMAS[name].fields]
    return scaled.select(F.to_csv(F.struct(*cols), OPTIONS).alias("value"))


def from_scaled(df: DataFrame, name: str) -> DataFrame:
    """Integer-encoded money (x100) and rates (x10000) -> DECIMAL(12,2) / DECIMAL(4,4)."""
    for c in MONEY_COLS.get(name, []):
        if c in df.columns:
            df = df.withColumn(c, (F.col(c).cast("decimal(20,0)") / F.lit(100)).cast(MONEY))
    for c in RATE_COLS.get(name, []):
        if c in df.columns:
            df = df.withColumn(c, (F.col(c).cast("decimal(20,0)") / F.lit(10000)).cast(RATE))
    return df


def to_scaled(df: DataFrame, name: str) -> DataFrame:
    """Inverse of ``from_scaled`` (for writing integer-encoded files)."""
    for c in MONEY_COLS.get(name, []):
        if c in df.columns:
            df = df.withColumn(c, (F.col(c) * 100).cast("long"))
    for c in RATE_COLS.get(name, []):
        if c in df.columns:
            df = df.withColumn(c, (F.col(c) * 10000).cast("long"))
    return df


def state_from_tables(spark: SparkSession, t: dict[str, DataFrame]):
    """Wholesale tables (decimal form) -> State with an explicit stock table."""
    from depotline.sources.adapter import State

    dist = t["district"]
    stock = t["stock"].select("s_w_id", "s_i_id", "s_quantity", "s_ytd", "s_order_cnt", "s_remote_cnt",
                              F.array(*[F.col(f"s_dist_{k:02d}") for k in range(1, 11)]).alias("s_dist"),
                              "s_data")
    return State(warehouse=t["warehouse"], district_base=dist.drop("d_next_o_id"),
                 district=dist.withColumn("d_next_o_id", F.col("d_next_o_id").cast("long")),
                 customer=t["customer"], orders=t["orders"], orderline=t["orderline"], item=t["item"],
                 sources={}, stock_table=stock)
