"""Wholesale schema: column lists and Spark types of the state tables."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
RATE = T.DecimalType(4, 4)

# The primary key of every state table.
KEYS = {
    "warehouse": ["w_id"],
    "district": ["d_w_id", "d_id"],
    "customer": ["c_w_id", "c_d_id", "c_id"],
    "orders": ["o_w_id", "o_d_id", "o_id"],
    "item": ["i_id"],
    "orderline": ["ol_w_id", "ol_d_id", "ol_o_id", "ol_number"],
    "stock": ["s_w_id", "s_i_id"],
    "order_summary": ["o_w_id", "o_d_id", "o_id"],
    "pending_orders": ["o_w_id", "o_d_id", "o_id"],
}

# Headerless CSV layouts of the base tables, in file column order.
CSV_SCHEMAS = {
    "warehouse": T.StructType([
        T.StructField("w_id", T.IntegerType()), T.StructField("w_name", T.StringType()),
        T.StructField("w_street_1", T.StringType()), T.StructField("w_street_2", T.StringType()),
        T.StructField("w_city", T.StringType()), T.StructField("w_state", T.StringType()),
        T.StructField("w_zip", T.StringType()), T.StructField("w_tax", T.DecimalType(8, 4)),
        T.StructField("w_ytd", T.DecimalType(14, 2))]),
    "district": T.StructType([
        T.StructField("d_w_id", T.IntegerType()), T.StructField("d_id", T.IntegerType()),
        T.StructField("d_name", T.StringType()), T.StructField("d_street_1", T.StringType()),
        T.StructField("d_street_2", T.StringType()), T.StructField("d_city", T.StringType()),
        T.StructField("d_state", T.StringType()), T.StructField("d_zip", T.StringType()),
        T.StructField("d_tax", T.DecimalType(8, 4)), T.StructField("d_ytd", T.DecimalType(14, 2)),
        T.StructField("d_next_o_id", T.IntegerType())]),
    "customer": T.StructType([
        T.StructField("c_w_id", T.IntegerType()), T.StructField("c_d_id", T.IntegerType()),
        T.StructField("c_id", T.LongType()), T.StructField("c_first", T.StringType()),
        T.StructField("c_middle", T.StringType()), T.StructField("c_last", T.StringType()),
        T.StructField("c_street_1", T.StringType()), T.StructField("c_street_2", T.StringType()),
        T.StructField("c_city", T.StringType()), T.StructField("c_state", T.StringType()),
        T.StructField("c_zip", T.StringType()), T.StructField("c_phone", T.StringType()),
        T.StructField("c_since", T.TimestampType()), T.StructField("c_credit", T.StringType()),
        T.StructField("c_credit_lim", T.DecimalType(14, 2)),
        T.StructField("c_discount", T.DecimalType(8, 4)),
        T.StructField("c_balance", T.DecimalType(14, 2)),
        T.StructField("c_ytd_payment", T.DecimalType(14, 2)),
        T.StructField("c_payment_cnt", T.IntegerType()),
        T.StructField("c_delivery_cnt", T.IntegerType()), T.StructField("c_data", T.StringType())]),
    "item": T.StructType([
        T.StructField("i_id", T.LongType()), T.StructField("i_name", T.StringType()),
        T.StructField("i_price", T.DecimalType(14, 2)), T.StructField("i_im_id", T.IntegerType()),
        T.StructField("i_data", T.StringType())]),
    "stock": T.StructType(
        [T.StructField("s_w_id", T.IntegerType()), T.StructField("s_i_id", T.LongType()),
         T.StructField("s_quantity", T.IntegerType()), T.StructField("s_ytd", T.DecimalType(14, 2)),
         T.StructField("s_order_cnt", T.IntegerType()), T.StructField("s_remote_cnt", T.IntegerType())]
        + [T.StructField(f"s_dist_{k:02d}", T.StringType()) for k in range(1, 11)]
        + [T.StructField("s_data", T.StringType())]),
    "orders": T.StructType([
        T.StructField("o_w_id", T.IntegerType()), T.StructField("o_d_id", T.IntegerType()),
        T.StructField("o_id", T.LongType()), T.StructField("o_c_id", T.LongType()),
        T.StructField("o_carrier_id", T.IntegerType()), T.StructField("o_ol_cnt", T.IntegerType()),
        T.StructField("o_all_local", T.IntegerType()), T.StructField("o_entry_d", T.TimestampType())]),
    "orderline": T.StructType([
        T.StructField("ol_w_id", T.IntegerType()), T.StructField("ol_d_id", T.IntegerType()),
        T.StructField("ol_o_id", T.LongType()), T.StructField("ol_number", T.IntegerType()),
        T.StructField("ol_i_id", T.LongType()), T.StructField("ol_delivery_d", T.TimestampType()),
        T.StructField("ol_amount", T.DecimalType(14, 2)), T.StructField("ol_supply_w_id", T.IntegerType()),
        T.StructField("ol_quantity", T.IntegerType()), T.StructField("ol_dist_info", T.StringType())]),
}
