"""Request frames: one row per transaction request.

Operators take these frames and answer every request in one job; a single
request is a one-row frame.  The generators below derive requests from the
state so that the registered queries grow with the data (every customer,
every district).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.sources.adapter import State

# Fixed request parameters of the registered queries.
STOCK_THRESHOLD = 60
LAST_ORDERS = 20
TOP_K = 10
SEARCH_STEP = 50


def customer_requests(state: State) -> DataFrame:
    """One request per customer; req_id = c_id (customer keys are unique)."""
    return state.customer.select(F.col("c_id").alias("req_id"), F.col("c_w_id").alias("w_id"),
                                 F.col("c_d_id").alias("d_id"), "c_id")


def searched_customers(state: State) -> DataFrame:
    """The query set of the related-customer searches: every customer whose id is
    divisible by SEARCH_STEP, searched against all customers."""
    return customer_requests(state).where(F.col("c_id") % SEARCH_STEP == 0)


def district_requests(state: State, threshold: int = STOCK_THRESHOLD,
                      last: int = LAST_ORDERS) -> DataFrame:
    """One request per district; req_id = the nation key of the district."""
    return state.district_base.select(
        F.col("d_nationkey").cast("long").alias("req_id"), F.col("d_w_id").alias("w_id"),
        F.col("d_id").alias("d_id"), F.lit(threshold).alias("threshold"),
        F.lit(last).alias("last_l"))


def requests_from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Explicit requests, e.g. a single transaction typed by a user."""
    return spark.createDataFrame(rows, schema)
