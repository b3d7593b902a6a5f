"""Derived (materialisable) helper tables: order summary and wide joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.functions.money import cents
from depotline.operators.reads import fmt_ts
from depotline.sources.adapter import State


def order_summary_of(lines: DataFrame, keys: list[str], qty: str = "ol_quantity",
                     item: str = "ol_i_id", amount: str = "ol_amount") -> DataFrame:
    """Per order: max quantity, the item ids of the lines at that quantity
    (descending), and the order total.  One hash aggregation; the collected
    list is bounded by the line count of one order."""
    g = lines.groupBy(*keys).agg(
        F.max(qty).alias("max_quantity"),
        F.collect_list(F.struct(F.col(qty).alias("q"), F.col(item).alias("i"))).alias("_l"),
        F.sum(amount).alias("total_amount"))
    tied = F.filter("_l", lambda x: x["q"] == F.col("max_quantity"))
    ids = F.sort_array(F.transform(tied, lambda x: x["i"]), asc=False)
    return g.select(*keys, "max_quantity", ids.alias("item_ids"), "total_amount")


def order_summary(state: State) -> DataFrame:
    s = order_summary_of(state.orderline, ["ol_w_id", "ol_d_id", "ol_o_id"])
    return s.select(F.col("ol_w_id").alias("o_w_id"), F.col("ol_d_id").alias("o_d_id"),
                    F.col("ol_o_id").alias("o_id"), "max_quantity",
                    F.concat_ws(",", F.transform("item_ids", lambda x: x.cast("string"))).alias("item_ids"),
                    cents(F.col("total_amount")).alias("total_amount_cents"))


def customer_district(state: State) -> DataFrame:
    """customer joined with its district on the full key (w, d)."""
    c = state.customer
    d = state.district.select("d_w_id", "d_id", "d_name", "d_tax", "d_next_o_id")
    j = c.join(d, (c.c_w_id == d.d_w_id) & (c.c_d_id == d.d_id), "inner")
    return j.select("c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last",
                    cents(F.col("c_balance")).alias("c_balance_cents"),
                    (F.col("c_discount") * 10000).cast("int").alias("c_discount_bp"),
                    "d_name", (F.col("d_tax") * 10000).cast("int").alias("d_tax_bp"), "d_next_o_id")


def orders_orderline(state: State) -> DataFrame:
    o = state.orders
    ol = state.orderline
    j = o.join(ol, (o.o_w_id == ol.ol_w_id) & (o.o_d_id == ol.ol_d_id) & (o.o_id == ol.ol_o_id), "inner")
    return j.select("o_w_id", "o_d_id", "o_id", "o_c_id", "o_carrier_id",
                    fmt_ts("o_entry_d").alias("o_entry_d"), "ol_number", "ol_i_id", "ol_quantity",
                    cents(F.col("ol_amount")).alias("ol_amount_cents"),
                    fmt_ts("ol_delivery_d").alias("ol_delivery_d"))


def stock_item(state: State) -> DataFrame:
    s = state.stock
    it = state.item.select("i_id", "i_name", "i_price")
    j = s.join(it, s.s_i_id == it.i_id, "inner")
    return j.select("s_w_id", "s_i_id", "s_quantity", "s_data",
                    F.element_at("s_dist", 1).alias("s_dist_01"),
                    F.element_at("s_dist", 10).alias("s_dist_10"),
                    "i_name", cents(F.col("i_price")).alias("i_price_cents"))
