"""The five analytical transactions and their helpers, set-oriented.

Every operator takes the state and a request frame and keeps ``req_id`` in its
result.  One plan serves one request and millions: which side of a join is
broadcast is left to the planner and AQE, which know the measured sizes.
Reads of the last orders expand each request to its order ids and join on the
full order key, so no join carries a range and no district is a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.functions.money import cents
from depotline.sources.adapter import State

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def fmt_ts(c: F.Column | str) -> F.Column:
    return F.date_format(c, TS_FORMAT)


def recent_keys(state: State, req: DataFrame) -> DataFrame:
    """(req_id, w_id, d_id, o_id): the order ids of the district's last ``last_l`` orders.

    Ids are dense, so a request becomes its own key list, and orders and lines
    are found by equi-joins on the full order key, however many requests share a
    district.  Requests with a ``next_o_id`` of their own are read as of that
    point; those without orders before them, or of unknown districts, have no keys."""
    if "next_o_id" in req.columns:
        r = req.withColumn("_next", F.col("next_o_id"))
    else:
        d = state.district.select(F.col("d_w_id").alias("_dw"), F.col("d_id").alias("_dd"), F.col("d_next_o_id").alias("_next"))
        r = req.join(d, (F.col("w_id") == F.col("_dw")) & (F.col("d_id") == F.col("_dd")), "inner")
    first = F.greatest(F.col("_next") - F.col("last_l"), F.lit(1))
    return r.where((F.col("last_l") > 0) & (F.col("_next") > 1)).select(
        "req_id", "w_id", "d_id", F.explode(F.sequence(first.cast("long"), F.col("_next").cast("long") - 1)).alias("o_id"))


def recent_orders(state: State, keys: DataFrame) -> DataFrame:
    """(req_id, w, d, o_id, o_c_id, o_entry_d) of the orders of ``keys``."""
    o = state.orders.select(F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id", "o_c_id", "o_entry_d")
    return o.join(keys, ["w_id", "d_id", "o_id"]).select("req_id", "w_id", "d_id", "o_id", "o_c_id", "o_entry_d")


def recent_lines(state: State, keys: DataFrame) -> DataFrame:
    """(req_id, w, d, o_id, ol_number, i_id, qty) of the lines of the orders of ``keys``."""
    ol = state.orderline.select(F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id"), F.col("ol_o_id").alias("o_id"),
                                "ol_number", F.col("ol_i_id").alias("i_id"), F.col("ol_quantity").alias("qty"))
    return ol.join(keys, ["w_id", "d_id", "o_id"]).select("req_id", "w_id", "d_id", "o_id", "ol_number", "i_id", "qty")


# --- R1 order status -------------------------------------------------------

def last_order(state: State, req: DataFrame) -> DataFrame:
    """Latest order (max o_id) of each requested customer: header only."""
    keys = req.select(F.col("w_id").alias("_w"), F.col("d_id").alias("_d"), F.col("c_id").alias("_c"))
    o = state.orders.join(keys, (F.col("o_w_id") == F.col("_w")) & (F.col("o_d_id") == F.col("_d"))
                          & (F.col("o_c_id") == F.col("_c")), "left_semi")
    return (o.groupBy("o_w_id", "o_d_id", "o_c_id")
             .agg(F.max_by(F.struct("o_id", "o_entry_d", "o_carrier_id"), "o_id").alias("o"))
             .select("o_w_id", "o_d_id", "o_c_id", "o.o_id", "o.o_entry_d", "o.o_carrier_id"))


def order_status(state: State, req: DataFrame) -> DataFrame:
    """Customer name and balance, the customer's last order and all its lines."""
    c = state.customer.select("c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last", "c_balance")
    rc = req.select("req_id", "w_id", "d_id", F.col("c_id").alias("r_c_id")).join(
        c, (F.col("w_id") == c.c_w_id) & (F.col("d_id") == c.c_d_id) & (F.col("r_c_id") == c.c_id),
        "inner")
    lo = last_order(state, req)
    j = rc.join(lo, (rc.c_w_id == lo.o_w_id) & (rc.c_d_id == lo.o_d_id) & (rc.c_id == lo.o_c_id), "left")
    ol = state.lines_with_supply.select("ol_w_id", "ol_d_id", "ol_o_id", "ol_number", "ol_i_id",
                                        "ol_supply_w_id", "ol_quantity", "ol_amount", "ol_delivery_d")
    j = j.join(ol, (j.o_w_id == ol.ol_w_id) & (j.o_d_id == ol.ol_d_id) & (j.o_id == ol.ol_o_id), "left")
    return j.select(
        "req_id", "c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last",
        cents(F.col("c_balance")).alias("c_balance_cents"),
        "o_id", fmt_ts("o_entry_d").alias("o_entry_d"), "o_carrier_id",
        "ol_number", "ol_i_id", "ol_supply_w_id", "ol_quantity",
        cents(F.col("ol_amount")).alias("ol_amount_cents"),
        fmt_ts("ol_delivery_d").alias("ol_delivery_d"))


# --- R2 stock level ----------------------------------------------------------

def recent_items(state: State, req: DataFrame) -> DataFrame:
    """Distinct (req_id, w_id, i_id) of the lines of the last orders."""
    return recent_lines(state, recent_keys(state, req)).select("req_id", "w_id", "i_id").distinct()


def stock_level(state: State, req: DataFrame, quantity: DataFrame | None = None) -> DataFrame:
    """Distinct items of the district's last L orders whose stock in the
    request's warehouse is below the threshold.  ``quantity`` (req_id, i_id,
    s_quantity) replaces the state's stock for reads as of a point of a log."""
    if quantity is None:
        ri = recent_items(state, req)
        keys = ri.select(F.col("w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id")).distinct()
        st = state.stock_for(keys).select("s_w_id", "s_i_id", "s_quantity")
        quantity = ri.join(st, (ri.w_id == st.s_w_id) & (ri.i_id == st.s_i_id), "inner")
    th = req.select(F.col("req_id").alias("t_req"), "threshold")
    j = quantity.join(th, F.col("req_id") == F.col("t_req"), "inner")
    cnt = j.groupBy("req_id").agg(
        F.count_if(F.col("s_quantity") < F.col("threshold")).alias("items_below"))
    out = req.join(cnt, "req_id", "left")
    return out.select("req_id", "w_id", "d_id", "threshold", "last_l",
                      F.coalesce(F.col("items_below"), F.lit(0)).cast("long").alias("items_below"))


# --- R3 / R4 popular items -----------------------------------------------------

def tied_lines(state: State, keys: DataFrame) -> DataFrame:
    """Lines (w, d, o_id, ol_number, i_id, max_qty) of the orders of ``keys`` at their order's max
    quantity.  That does not depend on the request, so each order is looked at once however
    many requests share it; the window groups are single orders (bounded)."""
    order = ["w_id", "d_id", "o_id"]
    ol = state.orderline.select(F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id"), F.col("ol_o_id").alias("o_id"),
                                "ol_number", F.col("ol_i_id").alias("i_id"), F.col("ol_quantity").alias("qty"))
    lines = ol.join(keys.select(*order).distinct(), order, "left_semi")
    m = lines.withColumn("max_qty", F.max("qty").over(Window.partitionBy(*order)))
    return m.where(F.col("qty") == F.col("max_qty")).select(*order, "ol_number", "i_id", "max_qty")


def popular_lines(state: State, keys: DataFrame) -> DataFrame:
    """Distinct (req_id, w, d, o_id, i_id, max_qty) tied at the order's max quantity."""
    tied = tied_lines(state, keys).drop("ol_number").distinct()
    return tied.join(keys.distinct(), ["w_id", "d_id", "o_id"]).select("req_id", "w_id", "d_id", "o_id", "i_id", "max_qty")


def popular_items(state: State, req: DataFrame) -> DataFrame:
    """Per examined order: header, customer, and the items tied at max quantity
    (an examined order without lines keeps one row with NULL item)."""
    keys = recent_keys(state, req)
    ords = recent_orders(state, keys)
    pop = popular_lines(state, keys)
    j = ords.join(pop, ["req_id", "w_id", "d_id", "o_id"], "left")
    c = state.customer.select("c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last")
    j = j.join(c, (j.w_id == c.c_w_id) & (j.d_id == c.c_d_id) & (j.o_c_id == c.c_id), "left")
    it = state.item.select(F.col("i_id").alias("it_id"), "i_name")
    j = j.join(it, j.i_id == it.it_id, "left")
    return j.select("req_id", "w_id", "d_id", "o_id", fmt_ts("o_entry_d").alias("o_entry_d"),
                    "c_first", "c_middle", "c_last", "i_id", "i_name", "max_qty")


def examined(state: State, keys: DataFrame) -> DataFrame:
    """(req_id, n_examined): how many orders each request looks at."""
    o = state.orders.select(F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id")
    return keys.join(o, ["w_id", "d_id", "o_id"]).groupBy("req_id").agg(F.count(F.lit(1)).alias("n_examined"))


def popular_item_pct(state: State, req: DataFrame) -> DataFrame:
    """Per request and popular item: share of the examined orders in which it is popular."""
    keys = recent_keys(state, req)
    pop = popular_lines(state, keys)
    per_item = pop.groupBy("req_id", "i_id").agg(F.count_distinct("o_id").alias("n_orders"))
    it = state.item.select(F.col("i_id").alias("it_id"), "i_name")
    j = per_item.join(examined(state, keys), "req_id", "inner").join(it, F.col("i_id") == F.col("it_id"), "left")
    return j.select("req_id", "i_id", "i_name", "n_orders", "n_examined",
                    (F.col("n_orders") / F.col("n_examined")).cast("double").alias("pct"))


def popular_item_pct_by_name(state: State, req: DataFrame) -> DataFrame:
    """Parity form of the share: tied *lines* counted per item *name* over the
    examined orders (several items share a name, so the share can exceed 1)."""
    keys = recent_keys(state, req)
    it = state.item.select(F.col("i_id").alias("it_id"), "i_name")
    t = tied_lines(state, keys).join(keys, ["w_id", "d_id", "o_id"]).join(it, F.col("i_id") == F.col("it_id"), "inner")
    g = t.groupBy("req_id", "i_name").agg(F.count(F.lit(1)).alias("n_lines"))
    j = g.join(examined(state, keys), "req_id", "inner")
    return j.select("req_id", "i_name", "n_lines", "n_examined",
                    (F.col("n_lines") / F.col("n_examined")).cast("double").alias("pct"))


# --- R5 top balance -----------------------------------------------------------

def with_place_names(df: DataFrame, state: State, w_col: str, d_col: str) -> DataFrame:
    wh = state.warehouse.select("w_id", "w_name")
    di = state.district.select("d_w_id", "d_id", "d_name")
    df = df.join(wh, F.col(w_col) == wh.w_id, "left")
    return df.join(di, (F.col(w_col) == di.d_w_id) & (F.col(d_col) == di.d_id), "left")


def top_balance(state: State, k: int = 10) -> DataFrame:
    """The k customers with the highest balance (ties by key), with names.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject: each task keeps its
    own top k and only k rows per task reach the final merge.
    """
    c = state.customer.select("c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last", "c_balance")
    top = c.orderBy(F.col("c_balance").desc_nulls_last(), "c_w_id", "c_d_id", "c_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("c_balance").desc_nulls_last(),
                                              "c_w_id", "c_d_id", "c_id"))
    top = top.withColumn("rank", rank.cast("int"))  # window over k rows only
    out = with_place_names(top, state, "c_w_id", "c_d_id")
    return out.select("rank", "c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last",
                      cents(F.col("c_balance")).alias("c_balance_cents"), "w_name", "d_name")


def top_balance_by_district(state: State, k: int = 10) -> DataFrame:
    """Top k customers of every district.

    ``row_number() <= k`` is planned with a partial WindowGroupLimit before the
    shuffle, so a district holding a third of the customers still ships only
    k rows per map task.
    """
    c = state.customer.select("c_w_id", "c_d_id", "c_id", "c_first", "c_middle", "c_last", "c_balance")
    w = Window.partitionBy("c_w_id", "c_d_id").orderBy(F.col("c_balance").desc_nulls_last(), "c_id")
    top = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = with_place_names(top, state, "c_w_id", "c_d_id")
    return out.select("c_w_id", "c_d_id", F.col("rank").cast("int").alias("rank"), "c_id",
                      "c_first", "c_middle", "c_last",
                      cents(F.col("c_balance")).alias("c_balance_cents"), "w_name", "d_name")


# --- R6 related customers -------------------------------------------------------

def order_item_pairs(state: State) -> DataFrame:
    """(w, d, o_id, i1, i2) for every pair i1 < i2 of distinct items of an order.

    Pairs are formed inside one order (bounded by the order's line count), so
    the expansion is linear in the number of orders; a hot item does not
    create a hot group here.
    """
    ol = state.orderline.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(
        F.array_sort(F.collect_set("ol_i_id")).alias("items"))
    ol = ol.withColumnsRenamed({"ol_w_id": "w_id", "ol_d_id": "d_id", "ol_o_id": "o_id"})
    return item_pairs(ol, "w_id", "d_id", "o_id")


def item_pairs(orders: DataFrame, *key: str) -> DataFrame:
    """(key, i1, i2) for every pair i1 < i2 of the sorted distinct ``items`` of each row."""
    pairs = F.flatten(F.transform(
        "items",
        lambda x, i: F.transform(F.slice("items", i + 2, F.size("items")),
                                 lambda y: F.struct(x.alias("i1"), y.alias("i2")))))
    return orders.where(F.size("items") >= 2).select(*key, F.explode(pairs).alias("p")).select(*key, "p.i1", "p.i2")


def ordered_item_pairs(state: State) -> DataFrame:
    """(w, d, c_id, i1, i2) for every order and item pair of it; orders and lines are laid out by
    the order's key, so no row moves."""
    p = order_item_pairs(state)
    o = state.orders.select("o_w_id", "o_d_id", "o_id", "o_c_id")
    j = p.join(o, (p.w_id == o.o_w_id) & (p.d_id == o.o_d_id) & (p.o_id == o.o_id), "inner")
    return j.select("w_id", "d_id", F.col("o_c_id").alias("c_id"), "i1", "i2")


def customer_item_pairs(state: State) -> DataFrame:
    """Distinct (w, d, c_id, i1, i2): a customer has an order containing both items.

    For a snapshot state this index is written once (a work table keyed by
    the snapshot) and shared by the queries that need all customers' pairs by customer."""
    def build() -> DataFrame:
        return ordered_item_pairs(state).distinct()
    if state.key is None:
        return build()
    from depotline.sources.sinks import work_table
    return work_table(state.orders.sparkSession, state.key + "-idx", "customer_item_pairs", build)


def requested_lines(state: State, req: DataFrame) -> DataFrame:
    """(req_id, r_w, w, d, o, i): the lines of all orders of each requested customer.  The orders
    are found first, so that lines are looked up by the key that they are laid out by."""
    o = state.orders.select("o_w_id", "o_d_id", "o_id", "o_c_id")
    mine = req.select("req_id", F.col("w_id").alias("r_w"), F.col("d_id").alias("r_d"), F.col("c_id").alias("r_c"))
    mine = o.join(mine, (o.o_w_id == mine.r_w) & (o.o_d_id == mine.r_d) & (o.o_c_id == mine.r_c), "inner")
    ol = state.orderline.select("ol_w_id", "ol_d_id", "ol_o_id", "ol_i_id")
    return ol.join(mine, (ol.ol_w_id == mine.o_w_id) & (ol.ol_d_id == mine.o_d_id) & (ol.ol_o_id == mine.o_id), "inner") \
             .select("req_id", "r_w", F.col("ol_w_id").alias("w"), F.col("ol_d_id").alias("d"), F.col("ol_o_id").alias("o"),
                     F.col("ol_i_id").alias("i"))


def related_customers(state: State, req: DataFrame) -> DataFrame:
    """Customers of other warehouses with an order sharing at least two distinct
    items with one order of the requested customer.

    Two orders share >= 2 distinct items exactly when they share an item pair,
    so the self-join is on (i1, i2) instead of on single items: the join groups
    are the orders holding both items, much smaller than the orders holding
    one (AQE splits a group that is still skewed).  The requested customers' pairs come
    from their own lines; all other pairs move once, for this join, and are never written.
    """
    items = requested_lines(state, req).groupBy("req_id", "r_w", "w", "d", "o").agg(F.array_sort(F.collect_set("i")).alias("items"))
    rq = item_pairs(items, "req_id", "r_w").distinct()
    other = ordered_item_pairs(state).select(F.col("w_id").alias("o_w"), F.col("d_id").alias("o_d"),
                                             F.col("c_id").alias("o_c"), F.col("i1").alias("j1"), F.col("i2").alias("j2"))
    j = rq.join(other, (rq.i1 == other.j1) & (rq.i2 == other.j2) & (rq.r_w != other.o_w), "inner")
    return j.select("req_id", F.col("o_w").alias("w_id"), F.col("o_d").alias("d_id"),
                    F.col("o_c").alias("c_id")).distinct()


def related_customers_by_lines(state: State, req: DataFrame) -> DataFrame:
    """Parity form: the other order holds at least two *lines* whose item is in
    the requested order.  Equal to the distinct-item form plus the other orders
    that hold one of the requested items twice; only those duplicated items
    (mult >= 2) leave their order's bucket and enter the second join."""
    base = related_customers(state, req)
    ol = state.orderline.groupBy("ol_w_id", "ol_d_id", "ol_o_id", "ol_i_id").agg(
        F.count(F.lit(1)).alias("mult")).where(F.col("mult") >= 2)
    o = state.orders.select("o_w_id", "o_d_id", "o_id", "o_c_id")
    other = ol.join(o, (ol.ol_w_id == o.o_w_id) & (ol.ol_d_id == o.o_d_id) & (ol.ol_o_id == o.o_id), "inner") \
        .select(F.col("o_w_id").alias("w"), F.col("o_d_id").alias("d"), F.col("o_c_id").alias("c"),
                F.col("ol_i_id").alias("i")).distinct()
    rq = requested_lines(state, req).select("req_id", "r_w", F.col("i").alias("ri")).distinct()
    j = rq.join(other, (rq.ri == other.i) & (rq.r_w != other.w), "inner")
    dup = j.select("req_id", F.col("w").alias("w_id"), F.col("d").alias("d_id"), F.col("c").alias("c_id"))
    return base.unionByName(dup).distinct()


def related_pairs(state: State) -> DataFrame:
    """All unordered pairs of related customers (first warehouse < second)."""
    cip = customer_item_pairs(state)
    a = cip.select(F.col("w_id").alias("w1"), F.col("d_id").alias("d1"), F.col("c_id").alias("c1"),
                   "i1", "i2")
    b = cip.select(F.col("w_id").alias("w2"), F.col("d_id").alias("d2"), F.col("c_id").alias("c2"),
                   F.col("i1").alias("j1"), F.col("i2").alias("j2"))
    j = a.join(b, (a.i1 == b.j1) & (a.i2 == b.j2) & (a.w1 < b.w2), "inner")
    return j.select("w1", "d1", "c1", "w2", "d2", "c2").distinct()


# --- R7 / R8 ------------------------------------------------------------------------

def pending_orders(state: State) -> DataFrame:
    return state.orders.where(F.col("o_carrier_id").isNull()) \
                       .select("o_w_id", "o_d_id", "o_id", "o_c_id")


def oldest_pending(state: State) -> DataFrame:
    """Oldest undelivered order of every district (plain hash aggregate: partial
    aggregation keeps a hot district cheap)."""
    p = pending_orders(state)
    return p.groupBy("o_w_id", "o_d_id").agg(
        F.min("o_id").alias("o_id"), F.min_by("o_c_id", "o_id").alias("o_c_id"))


def order_amount(state: State) -> DataFrame:
    """Payment amount of every order (sum of its lines, 0 without lines)."""
    s = state.orderline.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(F.sum("ol_amount").alias("amt"))
    o = state.orders.select("o_w_id", "o_d_id", "o_id")
    j = o.join(s, (o.o_w_id == s.ol_w_id) & (o.o_d_id == s.ol_d_id) & (o.o_id == s.ol_o_id), "left")
    return j.select("o_w_id", "o_d_id", "o_id",
                    cents(F.coalesce(F.col("amt"), F.lit(0))).alias("amount_cents"))
