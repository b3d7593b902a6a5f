"""Text rendering of typed results, only at the edge (A8).

Results stay typed DataFrames.  A report is (ord, line_no, text): line 0 repeats the
record, the others start with a tab.  Every kind is built by built-in string functions
from an array of lines for each result row.  Money is written from whole cents, halves
rounded away from 0; missing values are written ``null``; identifiers and quantities
are whole numbers.  Lists are sorted: order lines by number, examined orders by id and
their items by item id, shares by item name, related customers by (id, warehouse, district).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.functions.sequencing import dense_number

# The labels of the printed results.
TEXT = {
    "customer": "Customer identifier (W_ID: %d, D_ID: %d, C_ID: %d), C_LAST: %s, C_CREDIT: %s, C_DISCOUNT: ",
    "order": "O_ID: %d, O_ENTRY_D: %s",
    "items": "NUM_ITEMS: %d, TOTAL_AMOUNT: ",
    "item": "ITEM_NUMBER: %d, I_NAME: %s, SUPPLIER_WAREHOUSE: %d, QUANTITY: %d, OL_AMOUNT: ",
    "payer": "(a) Customer information:",
    "payer_id": "\tIdentifier: (C_W_ID,C_D_ID,C_ID)=(%d, %d, %d)",
    "payer_name": "\tName: (C_FIRST,C_MIDDLE,C_LAST)=(%s, %s, %s)",
    "payer_address": "\tAddress: (C_STREET_1,C_STREET_2,C_CITY,C_STATE,C_ZIP)=(%s, %s, %s, %s, %s)",
    "payer_other": "\tOther info: C_PHONE=%s, C_SINCE=%s, C_CREDIT=%s, C_CREDIT_LIM=%s, C_DISCOUNT=%s, C_BALANCE=%s",
    "warehouse": "(b) Warehouse information:",
    "warehouse_address": "\tW_STREET_1=%s, W_STREET_2=%s, W_CITY=%s, W_STATE=%s, W_ZIP=%s",
    "district": "(c) District information:",
    "district_address": "\tD_STREET_1=%s, D_STREET_2=%s, D_CITY=%s, D_STATE=%s, D_ZIP=%s",
    "payment": "(d) Payment: ",
    "status": "(a) Customer name & balance: (C_FIRST,C_MIDDLE,C_LAST)=(%s, %s, %s), C_BALANCE: %s",
    "last_order": "(b) O_ID: %s, O_ENTRY_D: %s, O_CARRIER_ID: %s",
    "order_lines": "(c) For each item in the order %s",
    "order_line": "\tOL_I_ID: %s, OL_SUPPLY_W_ID: %s, OL_QUANTITY: %s, OL_AMOUNT: %s, OL_DELIVER_D: %s",
    "stock": "Total number of items in S where its stock quantity at W_ID is below the threshold: %d",
    "recent": "District identifier: (%d, %d)",
    "recent_n": "Number of last orders to be examined: %d",
    "recent_order": "(a) Order number:(%d) & entry date and time (%s)",
    "recent_customer": "(b) Name of customer who placed this order (%s, %s, %s)",
    "recent_items": "(c) For each popular item in order %d:",
    "recent_item": "\tItem name: %s, Quantity ordered: %d",
    "shares": "(d) For each distinct popular item:",
    "share": "\tItem name: %s, Occurring percentage: %s%%",
    "rich": "(a) Name of Customer: (%s, %s, %s)",
    "rich_balance": "(b) Customer's Balance: %s0000",
    "rich_warehouse": "(c) Customer's Warehouse: %s",
    "rich_district": "(d) Customer's District: %s",
    "asker": "(a) Customer identifier (%d, %d, %d)",
    "related": "(b) Related customer identifiers:",
    "unrelated": "(b) No related customer found",
}


def hundredths(c: F.Column) -> F.Column:
    """Whole hundredths -> '-12.34' (exact; no float formatting)."""
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    a = F.abs(c)
    return F.when(c.isNotNull(), F.format_string("%s%d.%02d", sign, (a / 100).cast("long"), F.pmod(a, F.lit(100))))


def money_text(cents_col: str) -> F.Column:
    return hundredths(F.col(cents_col))


def rate_text(bp_col: str) -> F.Column:
    """Basis points (rate x 10000, below 1) -> '0.0400'."""
    return F.format_string("0.%04d", F.col(bp_col))


def shown(c) -> F.Column:
    """A value as text, ``null`` where there is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("null"))


def second_text(c: str) -> F.Column:
    """Timestamp text cut to whole seconds."""
    return shown(F.substring(c, 1, 19))


def line(label: str, *args) -> F.Column:
    return F.format_string(TEXT[label], *args) if args else F.lit(TEXT[label])


def tabbed(*lines: F.Column) -> F.Column:
    return F.array(*[F.concat(F.lit("\t"), x) for x in lines])


def spread(df: DataFrame, lines: F.Column, start: F.Column, ord_col: str = "ord") -> DataFrame:
    """The rows' lines, numbered from ``start``."""
    return df.select(F.col(ord_col).alias("ord"), start.alias("_start"), F.posexplode(lines).alias("_pos", "text")) \
             .select("ord", (F.col("_start") + F.col("_pos")).cast("int").alias("line_no"), "text")


# --- writes ----------------------------------------------------------------------

def render_payment_receipts(receipts: DataFrame) -> DataFrame:
    """``writes.payment_receipts`` as text."""
    record = F.concat(F.format_string("P %d %d %d ", "w_id", "d_id", "c_id"), money_text("amount_cents"))
    name = [shown(c) for c in ("c_first", "c_middle", "c_last")]

    def address(p):
        return [shown(f"{p}_{c}") for c in ("street_1", "street_2", "city", "state", "zip")]

    discount = hundredths(F.expr("(c_discount_bp + 50) div 100"))
    lines = tabbed(
        line("payer"), line("payer_id", "w_id", "d_id", "c_id"), line("payer_name", *name), line("payer_address", *address("c")),
        line("payer_other", shown("c_phone"), second_text("c_since"), shown("c_credit"), shown(money_text("c_credit_lim_cents")),
             shown(discount), money_text("balance_after_cents")),
        line("warehouse"), line("warehouse_address", *address("w")),
        line("district"), line("district_address", *address("d")),
        F.concat(line("payment"), money_text("amount_cents")))
    return spread(receipts, F.concat(F.array(record), lines), F.lit(0))


def render_new_orders(totals: DataFrame, lines: DataFrame, entry_ts: str = "2000-01-01 00:00:00") -> DataFrame:
    """``writes.new_order_totals`` and ``new_order_lines`` (with ``amount_cents``) as text: the record
    and its order lines as they were given, four lines on the order, then a line for each item."""
    n = F.col("n_items").cast("int")
    record = spread(totals, F.array(F.format_string("N %d %d %d", "w_id", "d_id", "c_id")), F.lit(0))
    head = spread(totals, tabbed(
        F.concat(line("customer", "w_id", "d_id", "c_id", shown("c_last"), shown("c_credit")), rate_text("c_discount_bp")),
        F.concat(F.lit("W_TAX: "), rate_text("w_tax_bp"), F.lit(", D_TAX: "), rate_text("d_tax_bp")),
        line("order", "o_id", F.lit(entry_ts)),
        F.concat(line("items", "n_items"), money_text("total_cents"))), n + 1)
    items = lines.withColumn("_k", F.row_number().over(Window.partitionBy("ord").orderBy("ol_number"))) \
                 .join(totals.select("ord", n.alias("_n")), "ord")
    given = spread(items, F.array(F.format_string("%d,%d,%d", "i_id", "supply_w_id", "qty")), F.col("_k"))
    body = spread(items, tabbed(F.concat(line("item", "i_id", shown("i_name"), "supply_w_id", "qty"), money_text("amount_cents"),
                                         F.format_string(", S_QUANTITY: %d", "s_quantity_after"))), F.col("_n") + 4 + F.col("_k"))
    return record.unionByName(given).unionByName(head).unionByName(body)


def render_deliveries(dlv: DataFrame) -> DataFrame:
    """A delivery prints its record only."""
    return spread(dlv, F.array(F.format_string("D %d %d", "w_id", "carrier_id")), F.lit(0))


# --- reads -----------------------------------------------------------------------

def render_order_status(rows: DataFrame) -> DataFrame:
    """``order_status`` rows (one a line of the order) as text.  A customer without orders
    has the record and line (a) only."""
    k = F.row_number().over(Window.partitionBy("req_id").orderBy("ol_number"))  # the lines of one order
    r = rows.withColumn("_k", k)
    top = tabbed(line("status", shown("c_first"), shown("c_middle"), shown("c_last"), shown(money_text("c_balance_cents"))))
    order = tabbed(line("last_order", shown("o_id"), second_text("o_entry_d"), shown("o_carrier_id")), line("order_lines", shown("o_id")))
    item = tabbed(line("order_line", shown("ol_i_id"), shown("ol_supply_w_id"), shown("ol_quantity"),
                       shown(money_text("ol_amount_cents")), second_text("ol_delivery_d")))
    none = F.array().cast("array<string>")
    record = F.array(F.format_string("O %d %d %d", "c_w_id", "c_d_id", "c_id"))
    head = F.concat(record, top, F.when(F.col("o_id").isNotNull(), order).otherwise(none))
    lines = F.concat(F.when(F.col("_k") == 1, head).otherwise(none), F.when(F.col("ol_number").isNotNull(), item).otherwise(none))
    return spread(r, lines, F.when(F.col("_k") == 1, 0).otherwise(F.col("_k") + 3), "req_id")


def render_stock_level(rows: DataFrame) -> DataFrame:
    """``stock_level`` rows as text."""
    record = F.format_string("S %d %d %d %d", "w_id", "d_id", "last_l", "threshold")
    return spread(rows, F.concat(F.array(record), tabbed(line("stock", "items_below"))), F.lit(0), "req_id")


def render_popular_items(req: DataFrame, popular: DataFrame, shares: DataFrame) -> DataFrame:
    """``popular_items`` and ``popular_item_pct_by_name`` of the requests ``req`` as text.

    The sections of a report are put in order by a window over its rows, which are bounded by
    the orders that the request asks for."""
    first = F.row_number().over(Window.partitionBy("req_id", "o_id").orderBy("i_id")) == 1
    none = F.array().cast("array<string>")
    head = F.concat(F.array(F.format_string("I %d %d %d", "w_id", "d_id", "last_l")),
                    tabbed(line("recent", "w_id", "d_id"), line("recent_n", "last_l")))
    order = tabbed(line("recent_order", "o_id", second_text("o_entry_d")),
                   line("recent_customer", shown("c_first"), shown("c_middle"), shown("c_last")), line("recent_items", "o_id"))
    item = F.when(F.col("i_id").isNotNull(), tabbed(line("recent_item", shown("i_name"), "max_qty"))).otherwise(none)
    per_10000 = F.expr("(n_lines * 20000 + n_examined) div (2 * n_examined)")
    share = tabbed(line("share", shown("i_name"), hundredths(per_10000)))

    def part(df, section, lines, o_id=F.lit(None), i_id=F.lit(None), name=F.lit(None)):
        return df.select("req_id", F.lit(section).alias("_s"), o_id.cast("long").alias("_o"), i_id.cast("long").alias("_i"),
                         name.cast("string").alias("_name"), lines.alias("_lines"))

    rows = part(req, 0, head) \
        .unionByName(part(popular.withColumn("_first", first), 1, F.concat(F.when(F.col("_first"), order).otherwise(none), item),
                          F.col("o_id"), F.col("i_id"))) \
        .unionByName(part(req, 2, tabbed(line("shares")))) \
        .unionByName(part(shares, 3, share, name=F.col("i_name")))
    w = Window.partitionBy("req_id").orderBy("_s", "_o", "_i", "_name").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.size("_lines")).over(w), F.lit(0))
    return spread(rows.withColumn("_at", at), F.col("_lines"), F.col("_at"), "req_id")


def render_top_balance(req: DataFrame, rows: DataFrame) -> DataFrame:
    """``top_balance`` rows (with req_id) as text: the record, then four lines a customer."""
    lines = tabbed(line("rich", shown("c_first"), shown("c_middle"), shown("c_last")),
                   line("rich_balance", money_text("c_balance_cents")),
                   line("rich_warehouse", shown("w_name")), line("rich_district", shown("d_name")))
    return spread(req, F.array(F.lit("T")), F.lit(0), "req_id") \
        .unionByName(spread(rows, lines, (F.col("rank") - 1) * 4 + 1, "req_id"))


def render_related(req: DataFrame, rows: DataFrame) -> DataFrame:
    """``related_customers`` rows of the requests ``req`` (req_id, w_id, d_id, c_id) as text.
    A customer may have any number of related ones: they are numbered skew-safe."""
    found = rows.select("req_id").distinct().withColumn("_any", F.lit(True))
    asked = req.join(found, "req_id", "left")
    head = F.concat(F.array(F.format_string("R %d %d %d", "w_id", "d_id", "c_id")),
                    tabbed(line("asker", "w_id", "d_id", "c_id"), F.when(F.col("_any"), line("related")).otherwise(line("unrelated"))))
    k = dense_number(rows, ["req_id"], "c_id", "_k", tiebreak=["w_id", "d_id"])
    return spread(asked, head, F.lit(0), "req_id") \
        .unionByName(spread(k, tabbed(F.format_string("(%d, %d, %d)", "w_id", "d_id", "c_id")), F.col("_k") + 2, "req_id"))
