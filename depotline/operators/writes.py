"""State-changing jobs: new order, payment, delivery, ledger postings, audit.

All are set-oriented over an ordered batch of records (``ord`` is the total
order of the batch).  The sequential effects are re-expressed as closed forms
over running aggregates (``depotline.functions.sequencing``), so no record is
processed in a loop and no key's records have to meet in one task:

* order ids:   o_id = next_o_id(w, d) + (number of earlier N records of (w, d));
* stock rule:  q' = q - x, plus 100 when below 10, after draws with cumulative
  sum C equals ``q0 - C`` if that is >= 10, else ``10 + pmod(q0 - C - 10, 100)``
  (exact for q0 >= 10 and draws 1..100; the test-suite checks it
  against the step rule);
* delivery:    the k-th successful attempt of a district delivers the k-th
  pending order; successes follow from a reflected running count
  (``S = D - max(0, max(D - A))``, A = arrivals, D = attempts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.functions.money import MONEY, WIDE_MONEY, cents
from depotline.functions.sequencing import dense_number, running_agg, running_aggs
from depotline.sources.adapter import State
from depotline.sources.sinks import scratch_table

STOCK_FLOOR = 10
STOCK_REFILL = 100


def stock_closed_form(q0: F.Column, cum: F.Column) -> F.Column:
    """Quantity after draws totalling ``cum`` starting from ``q0``."""
    v = q0 - cum
    return F.when(v >= STOCK_FLOOR, v).otherwise(
        F.lit(STOCK_FLOOR) + F.pmod(v - STOCK_FLOOR, F.lit(STOCK_REFILL))).cast("int")


# --- W1 / P1 new orders ----------------------------------------------------------

def allocate_order_ids(state: State, n_hdr: DataFrame) -> DataFrame:
    """P1: o_id of every N record = district next_o_id + earlier N records of (w, d)."""
    d = state.district.select(F.col("d_w_id").alias("w_id"), F.col("d_id").alias("d_id"), "d_next_o_id")
    n = dense_number(n_hdr, ["w_id", "d_id"], "ord", "_rank")
    n = n.join(d, ["w_id", "d_id"], "inner")
    return n.withColumn("o_id", (F.col("d_next_o_id") + F.col("_rank") - 1).cast("long")) \
            .drop("_rank", "d_next_o_id")


def in_stock_domain(q0: F.Column, max_draw: F.Column, min_draw: F.Column) -> F.Column:
    """Where the closed form is exact: start of 10 or more with draws 1..100, or
    start 0..9 with draws 1..10."""
    return (min_draw >= 1) & (((q0 >= STOCK_FLOOR) & (max_draw <= STOCK_REFILL))
                              | ((q0 >= 0) & (q0 < STOCK_FLOOR) & (max_draw <= STOCK_FLOOR)))


# Draws in a block of the general stock rule.
STOCK_BLOCK = 256


def stock_fallback(draws: DataFrame) -> DataFrame:
    """Exact stock sequence for keys outside the closed form's domain, whatever the draws.
    draws: (supply_w_id, i_id, ord, ol_number, qty, s_quantity) -> (supply_w_id, i_id, ord,
    ol_number, _before, _after).

    With C the sum of the draws up to one, the quantity after it is q0 - C + 100 k, where k
    counts the refills so far.  A draw refills where q0 - C + 100 k < 10, that is where
    k < need = ceil((10 - q0 + C) / 100); so k only ever grows by one where it is below ``need``.
    Needs come from a running sum.  A key's draws are cut into blocks of STOCK_BLOCK by their
    number.  A block is reduced to its limits: from a start k it counts as many refills as it
    has limits above k.  k at a block's start lies between two running bounds, so limits at or
    under the lower one never count, those above the upper one always do, and only those
    between are kept.  Blocks are chained by the key (a small row each), and each block then
    steps through its own draws from its start.  No task holds a key's draws."""
    key = ["supply_w_id", "i_id"]
    d = running_aggs(draws, key, "ord", [("qty", "_c", "sum", True), (F.lit(1).cast("long"), "_n", "sum", True)],
                     tiebreak=["ol_number"])
    # k <= max(0, needs so far), k <= n; and k >= min(need_j + (n - j), n) for every draw j so far
    d = d.withColumn("_base", (F.col("s_quantity") - F.col("_c")).cast("long")) \
         .withColumn("_need", F.expr(f"-((_base - pmod(_base - {STOCK_FLOOR}, {STOCK_REFILL}) - {STOCK_FLOOR}) div {STOCK_REFILL})"))
    d = running_aggs(d, key, "_n", [("_need", "_most", "max", False), (F.col("_n") - F.col("_need"), "_lag", "max", False)])
    before = F.col("_n") - 1
    d = d.withColumn("_block", F.expr(f"(_n - 1) div {STOCK_BLOCK}")) \
         .withColumn("_hi", F.least(before, F.greatest(F.lit(0), F.coalesce("_most", F.lit(0))))) \
         .withColumn("_lo", F.greatest(F.lit(0), F.least(before, before - F.coalesce("_lag", F.lit(0)))))
    block = d.groupBy(*key, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_n", "_need", "_base", "ord", "ol_number", "qty"))).alias("_d"),
        F.min_by("_lo", "_n").alias("_lo"), F.min_by("_hi", "_n").alias("_hi"))
    # A draw's limit: the smallest start from which it does not refill, given the limits before it.
    # A start s has refilled as often as limits exceed it, so the limit is the least s with
    # s + (limits above s) >= need; limits stay in order, so this is found among need - 0 .. need - j.
    limits = F.aggregate("_d", F.array().cast("array<bigint>"), lambda got, x: F.sort_array(F.concat(got, F.array(
        F.aggregate(F.sort_array(got, asc=False), F.struct(x["_need"].alias("s"), F.lit(0).cast("bigint").alias("j")),
                    lambda acc, lim: F.struct(
                        F.when(lim > x["_need"] - acc["j"] - 1, x["_need"] - acc["j"] - 1).otherwise(acc["s"]).alias("s"),
                        F.when(lim > x["_need"] - acc["j"] - 1, acc["j"] + 1).otherwise(acc["j"]).alias("j")),
                    lambda acc: acc["s"])))))
    block = block.withColumn("_limits", limits)
    small = block.select(*key, F.struct(
        "_block", F.size(F.filter("_limits", lambda b: b > F.col("_hi"))).cast("bigint").alias("all"),
        F.filter("_limits", lambda b: (b > F.col("_lo")) & (b <= F.col("_hi"))).alias("some")).alias("_b"))
    chain = small.groupBy(*key).agg(F.sort_array(F.collect_list("_b")).alias("_bs"))
    starts = F.aggregate(
        "_bs", F.struct(F.lit(0).cast("bigint").alias("k"), F.array().cast("array<struct<_block:bigint,k:bigint>>").alias("out")),
        lambda acc, b: F.struct(
            (acc["k"] + b["all"] + F.size(F.filter(b["some"], lambda x: x > acc["k"])).cast("bigint")).alias("k"),
            F.concat(acc["out"], F.array(F.struct(b["_block"].cast("bigint").alias("_block"), acc["k"].alias("k")))).alias("out")),
        lambda acc: acc["out"])
    start = chain.select(*key, F.explode(starts).alias("_s")).select(*key, "_s._block", F.col("_s.k").alias("_k"))
    steps = F.aggregate(
        "_d", F.struct(F.col("_k").alias("k"), F.array().cast("array<bigint>").alias("ks")),
        lambda acc, x: F.struct(
            (acc["k"] + (acc["k"] < x["_need"]).cast("bigint")).alias("k"),
            F.concat(acc["ks"], F.array(acc["k"] + (acc["k"] < x["_need"]).cast("bigint"))).alias("ks")),
        lambda acc: acc["ks"])
    out = block.join(start, [*key, "_block"]).withColumn("_ks", F.concat(F.array("_k"), steps))
    out = out.select(*key, "_ks", F.posexplode("_d").alias("_i", "_x"))
    refilled = STOCK_REFILL * F.col("_ks")[F.col("_i")]
    after = F.col("_x._base") + STOCK_REFILL * F.col("_ks")[F.col("_i") + 1]
    return out.select(*key, "_x.ord", "_x.ol_number", (F.col("_x._base") + F.col("_x.qty") + refilled).cast("int").alias("_before"),
                      after.cast("int").alias("_after"))


def outside_domain(state: State, draws: DataFrame) -> DataFrame | None:
    """(supply_w_id, i_id, s_quantity) of the keys that the closed form does not cover, from the
    totals of their draws; written once, None if there are none."""
    k = draws.groupBy("supply_w_id", "i_id").agg(F.max("qty").alias("_mx"), F.min("qty").alias("_mn"))
    st = state.stock_for(k.select(F.col("supply_w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id"))).select("s_w_id", "s_i_id", "s_quantity")
    bad = k.join(st, (k.supply_w_id == st.s_w_id) & (k.i_id == st.s_i_id), "inner") \
        .where(~in_stock_domain(F.col("s_quantity"), F.col("_mx"), F.col("_mn"))).select("supply_w_id", "i_id", "s_quantity")
    bad = scratch_table(draws.sparkSession, "stock_outside", bad)
    return None if bad.isEmpty() else bad


def new_order_lines(state: State, n_hdr: DataFrame, n_lines: DataFrame,
                    hdr: DataFrame | None = None) -> DataFrame:
    """Per N line: order id, amount, stock before/after the draw, dist info.

    Stock is drawn at the supply warehouse; the running sum of quantities per
    stock key (in record order, then line order) feeds the closed form.  Keys
    whose start quantity or draws leave the closed form's domain take
    ``stock_fallback`` instead."""
    hdr = (hdr if hdr is not None else allocate_order_ids(state, n_hdr)).select("ord", "w_id", "d_id", "o_id")
    raw = n_lines.join(hdr, "ord", "inner")
    bad = outside_domain(state, raw)
    ln = running_aggs(raw, ["supply_w_id", "i_id"], "ord", [("qty", "_cum", "sum", True)],
                      tiebreak=["ol_number"])
    keys = raw.select(F.col("supply_w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id")).distinct()
    it = state.item.select(F.col("i_id").alias("_i"), "i_name", "i_price")
    st = state.stock_for(keys).select("s_w_id", "s_i_id", "s_quantity", "s_dist")
    st = st.join(it, st.s_i_id == it._i, "inner")  # by stock key, so that the lines are not moved again by item
    ln = ln.join(st, (ln.supply_w_id == st.s_w_id) & (ln.i_id == st.s_i_id), "inner")
    none = F.lit(None).cast("int")
    if bad is None:
        ln = ln.withColumns({"_before": none, "_after": none})
    else:
        fb = stock_fallback(raw.join(bad, ["supply_w_id", "i_id"], "inner"))
        ln = ln.join(fb, ["supply_w_id", "i_id", "ord", "ol_number"], "left")
    after = F.coalesce(F.col("_after"), stock_closed_form(F.col("s_quantity"), F.col("_cum")))
    before = F.coalesce(F.col("_before"), stock_closed_form(F.col("s_quantity"), F.col("_cum") - F.col("qty")))
    return ln.select(
        "ord", "w_id", "d_id", "o_id", "ol_number", "i_id", "i_name", "supply_w_id", "qty",
        (F.col("i_price") * F.col("qty")).cast(MONEY).alias("amount"),
        before.alias("s_quantity_before"), after.alias("s_quantity_after"),
        F.element_at("s_dist", F.col("d_id")).alias("ol_dist_info"))


def new_order_totals(state: State, n_hdr: DataFrame, lines: DataFrame,
                     hdr: DataFrame | None = None) -> DataFrame:
    """Per N record: customer data, taxes, item count and the total
    sum(amount) * (1 + d_tax + w_tax) * (1 - c_discount), HALF_UP to cents once."""
    hdr = hdr if hdr is not None else allocate_order_ids(state, n_hdr)
    agg = lines.groupBy("ord").agg(
        F.sum("amount").cast(WIDE_MONEY).alias("_sum"), F.count(F.lit(1)).alias("n_items"),
        F.min((F.col("supply_w_id") == F.col("w_id")).cast("int")).alias("_local"))
    h = hdr.join(agg, "ord", "left")
    c = state.customer.select("c_w_id", "c_d_id", "c_id", "c_last", "c_credit", "c_discount")
    h = h.join(c, (h.w_id == c.c_w_id) & (h.d_id == c.c_d_id) & (h.c_id == c.c_id), "inner").drop(c.c_id)
    wt = state.warehouse.select(F.col("w_id").alias("_w"), "w_tax")
    dt = state.district.select(F.col("d_w_id").alias("_dw"), F.col("d_id").alias("_dd"), "d_tax")
    h = h.join(wt, h.w_id == wt._w, "inner").join(dt, (h.w_id == dt._dw) & (h.d_id == dt._dd), "inner")
    s = F.coalesce(F.col("_sum"), F.lit(0).cast(WIDE_MONEY))
    total = F.round(s * (F.lit(1) + F.col("d_tax") + F.col("w_tax")) * (F.lit(1) - F.col("c_discount")), 2)
    return h.select(
        "ord", "w_id", "d_id", "o_id", "c_id", "c_last", "c_credit",
        (F.col("c_discount") * 10000).cast("int").alias("c_discount_bp"),
        (F.col("w_tax") * 10000).cast("int").alias("w_tax_bp"),
        (F.col("d_tax") * 10000).cast("int").alias("d_tax_bp"),
        F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col("_local"), F.lit(1)).cast("int").alias("all_local"),
        cents(total).alias("total_cents"))


def stock_after(state: State, n_hdr: DataFrame, n_lines: DataFrame) -> DataFrame:
    """W1s: final stock rows of every drawn key.  Needs only the totals per key
    (a map-side combined aggregation), not the order of the draws; keys
    outside the closed form's domain take the exact fallback."""
    hdr = n_hdr.select("ord", "w_id")
    ln = n_lines.join(hdr, "ord", "inner")
    g = ln.groupBy("supply_w_id", "i_id").agg(
        F.sum("qty").alias("_c"), F.count(F.lit(1)).alias("_n"),
        F.sum((F.col("supply_w_id") != F.col("w_id")).cast("int")).alias("_r"))
    keys = g.select(F.col("supply_w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id"))
    st = state.stock_for(keys).select("s_w_id", "s_i_id", "s_quantity", "s_ytd", "s_order_cnt",
                                      "s_remote_cnt")
    j = g.join(st, (g.supply_w_id == st.s_w_id) & (g.i_id == st.s_i_id), "inner")
    bad = outside_domain(state, ln)
    if bad is None:
        j = j.withColumn("_fa", F.lit(None).cast("int"))
    else:
        fb = stock_fallback(ln.join(bad, ["supply_w_id", "i_id"], "inner"))
        last = fb.groupBy("supply_w_id", "i_id").agg(F.max_by("_after", F.struct("ord", "ol_number")).alias("_fa"))
        j = j.join(last, ["supply_w_id", "i_id"], "left")
    return j.select("s_w_id", "s_i_id",
                    F.coalesce(F.col("_fa"), stock_closed_form(F.col("s_quantity"), F.col("_c")))
                     .alias("s_quantity"),
                    (F.col("s_ytd") + F.col("_c")).cast("long").alias("s_ytd"),
                    (F.col("s_order_cnt") + F.col("_n")).cast("long").alias("s_order_cnt"),
                    (F.col("s_remote_cnt") + F.col("_r")).cast("long").alias("s_remote_cnt"))


# --- W2 payment ------------------------------------------------------------------

def payment_effects(state: State, pay: DataFrame) -> DataFrame:
    """Final customer rows after the payments (aggregation only)."""
    g = pay.groupBy("w_id", "d_id", "c_id").agg(F.sum("amount").cast(WIDE_MONEY).alias("_s"),
                                                F.count(F.lit(1)).alias("_n"))
    c = state.customer.select("c_w_id", "c_d_id", F.col("c_id").alias("_c"), "c_balance",
                              "c_ytd_payment", "c_payment_cnt")
    j = g.join(c, (g.w_id == c.c_w_id) & (g.d_id == c.c_d_id) & (g.c_id == c._c), "inner")
    return j.select("c_w_id", "c_d_id", "c_id",
                    cents(F.col("c_balance") - F.col("_s")).alias("c_balance_cents"),
                    cents(F.col("c_ytd_payment") + F.col("_s")).alias("c_ytd_payment_cents"),
                    (F.col("c_payment_cnt") + F.col("_n")).cast("long").alias("c_payment_cnt"))


ADDRESS = ("street_1", "street_2", "city", "state", "zip")


def payment_receipts(state: State, pay: DataFrame) -> DataFrame:
    """Per payment: the customer with address and terms, both addresses, the amount and the
    balance right after it (skew-safe running sum per customer in record order)."""
    r = running_agg(pay, ["w_id", "d_id", "c_id"], "ord", "amount", "_paid")
    own = ["c_first", "c_middle", "c_last", *[f"c_{a}" for a in ADDRESS], "c_phone", "c_since", "c_credit"]
    c = state.customer.select("c_w_id", "c_d_id", F.col("c_id").alias("_c"), *own, "c_credit_lim", "c_discount", "c_balance")
    r = r.join(c, (r.w_id == c.c_w_id) & (r.d_id == c.c_d_id) & (r.c_id == c._c), "inner")
    w_own, d_own = [f"w_{a}" for a in ADDRESS], [f"d_{a}" for a in ADDRESS]
    wh = state.warehouse.select(F.col("w_id").alias("_w"), *w_own)
    di = state.district.select(F.col("d_w_id").alias("_dw"), F.col("d_id").alias("_dd"), *d_own)
    r = r.join(wh, r.w_id == wh._w, "inner").join(di, (r.w_id == di._dw) & (r.d_id == di._dd), "inner")
    r = r.withColumn("c_since", F.date_format("c_since", "yyyy-MM-dd HH:mm:ss.SSS"))
    return r.select("ord", "w_id", "d_id", "c_id", *own, cents(F.col("c_credit_lim")).alias("c_credit_lim_cents"),
                    (F.col("c_discount") * 10000).cast("int").alias("c_discount_bp"),
                    cents(F.col("amount")).alias("amount_cents"),
                    cents(F.col("c_balance") - F.col("_paid")).alias("balance_after_cents"), *w_own, *d_own)


def district_ytd(state: State, pay: DataFrame) -> DataFrame:
    """P5: d_ytd and w_ytd after the payments (partial + final aggregation)."""
    g = pay.groupBy("w_id", "d_id").agg(F.sum("amount").cast(WIDE_MONEY).alias("_s"))
    d = state.district.select(F.col("d_w_id").alias("w_id"), "d_id", "d_ytd")
    j = d.join(g, ["w_id", "d_id"], "left").withColumn("_s", F.coalesce(F.col("_s"), F.lit(0)))
    j = j.withColumn("d_ytd2", F.col("d_ytd") + F.col("_s"))
    wy = j.groupBy("w_id").agg(F.sum("_s").alias("_ws"))
    wh = state.warehouse.select("w_id", "w_ytd")
    wy = wy.join(wh, "w_id", "inner").select("w_id", (F.col("w_ytd") + F.col("_ws")).alias("w_ytd2"))
    return j.join(wy, "w_id", "inner").select(
        "w_id", "d_id", cents(F.col("d_ytd2")).alias("d_ytd_cents"),
        cents(F.col("w_ytd2")).alias("w_ytd_cents"))


# --- W3 / P3 delivery -------------------------------------------------------------

def order_amounts(state: State) -> DataFrame:
    s = state.orderline.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(
        F.sum("ol_amount").cast(WIDE_MONEY).alias("amount"))
    return s.select(F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id"),
                    F.col("ol_o_id").alias("o_id"), "amount")


def delivery_queue(state: State, new_orders: DataFrame | None = None) -> DataFrame:
    """Pending orders of every district in delivery order: (w, d, k, o_id, c_id,
    amount).  Initial pending orders come first (by o_id), then new orders in
    record order; ``new_orders`` carries (ord, w_id, d_id, o_id, c_id, amount)."""
    p = state.orders.where(F.col("o_carrier_id").isNull()).select(
        F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id",
        F.col("o_c_id").alias("c_id"))
    p = dense_number(p, ["w_id", "d_id"], "o_id", "k")
    p = p.join(order_amounts(state), ["w_id", "d_id", "o_id"], "left")
    p = p.select("w_id", "d_id", "k", "o_id", "c_id",
                 F.coalesce(F.col("amount"), F.lit(0).cast(WIDE_MONEY)).alias("amount"))
    if new_orders is None:
        return p
    p0 = p.groupBy("w_id", "d_id").agg(F.count(F.lit(1)).alias("_p0"))
    n = dense_number(new_orders, ["w_id", "d_id"], "ord", "_r")
    n = n.join(p0, ["w_id", "d_id"], "left")
    n = n.select("w_id", "d_id", (F.coalesce(F.col("_p0"), F.lit(0)) + F.col("_r")).alias("k"),
                 "o_id", "c_id", F.coalesce(F.col("amount"), F.lit(0).cast(WIDE_MONEY)).alias("amount"))
    return p.unionByName(n)


def delivery_attempts(state: State, dlv: DataFrame) -> DataFrame:
    """Every D record (ord, w_id, carrier_id) becomes one attempt per district of w."""
    d = state.district_base.select(F.col("d_w_id").alias("w_id"), "d_id")
    return dlv.join(d, "w_id", "inner").select("ord", "w_id", "d_id", "carrier_id")


def deliver(state: State, dlv: DataFrame, new_orders: DataFrame | None = None) -> DataFrame:
    """Outcome of every delivery attempt: the delivered order (NULL when the
    district had nothing pending at that point), its customer and amount.

    ``new_orders`` (ord, w_id, d_id, o_id, c_id, amount) interleaves arrivals
    with the attempts; without it the batch only drains the initial backlog.
    """
    att = delivery_attempts(state, dlv)
    queue = delivery_queue(state, new_orders)
    p0 = state.orders.where(F.col("o_carrier_id").isNull()).groupBy(
        F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id")).agg(F.count(F.lit(1)).alias("p0"))
    if new_orders is None:
        # no arrivals: the k-th attempt of a district succeeds iff k <= backlog
        ev = dense_number(att, ["w_id", "d_id"], "ord", "k").join(p0, ["w_id", "d_id"], "left")
        ev = ev.withColumn("ok", F.col("k") <= F.coalesce(F.col("p0"), F.lit(0)))
        j = ev.join(queue, ["w_id", "d_id", "k"], "left")
        return j.select("ord", "w_id", "d_id", "carrier_id", "o_id", "c_id",
                        F.when(F.col("ok"), cents(F.col("amount"))).alias("amount_cents"))
    ev = att.select("ord", "w_id", "d_id", "carrier_id", F.lit(1).alias("is_att"))
    if new_orders is not None:
        ev = ev.unionByName(new_orders.select("ord", "w_id", "d_id", F.lit(None).cast("int").alias("carrier_id"),
                                              F.lit(0).alias("is_att")))
    ev = running_aggs(ev, ["w_id", "d_id"], "ord", [
        (F.col("is_att").cast("long"), "D", "sum", True),
        ((1 - F.col("is_att")).cast("long"), "A", "sum", True)])
    ev = ev.where(F.col("is_att") == 1).join(p0, ["w_id", "d_id"], "left")
    ev = ev.withColumn("x", F.col("D") - F.coalesce(F.col("p0"), F.lit(0)) - F.col("A"))
    ev = running_agg(ev, ["w_id", "d_id"], "ord", "x", "m_prev", agg="max", inclusive=False)
    m_prev = F.greatest(F.lit(0), F.coalesce(F.col("m_prev"), F.lit(0)))
    ev = ev.withColumn("ok", F.col("x") <= m_prev)
    # on success max(0, max_{u<=s} x) equals m_prev, so k = D - m_prev
    ev = ev.withColumn("k", F.when(F.col("ok"), F.col("D") - m_prev))
    j = ev.join(queue, ["w_id", "d_id", "k"], "left")
    return j.select("ord", "w_id", "d_id", "carrier_id", "o_id", "c_id",
                    F.when(F.col("ok"), cents(F.col("amount"))).alias("amount_cents"))


def delivery_customer_effects(state: State, delivered: DataFrame) -> DataFrame:
    """Customer rows after deliveries: balance += order amount, delivery_cnt += 1."""
    d = delivered.where(F.col("o_id").isNotNull())
    g = d.groupBy("w_id", "d_id", "c_id").agg(F.sum("amount_cents").alias("_s"),
                                              F.count(F.lit(1)).alias("_n"))
    c = state.customer.select("c_w_id", "c_d_id", F.col("c_id").alias("_c"), "c_balance", "c_delivery_cnt")
    j = g.join(c, (g.w_id == c.c_w_id) & (g.d_id == c.c_d_id) & (g.c_id == c._c), "inner")
    return j.select("c_w_id", "c_d_id", "c_id",
                    (cents(F.col("c_balance")) + F.col("_s")).alias("c_balance_cents"),
                    (F.col("c_delivery_cnt") + F.col("_n")).cast("long").alias("c_delivery_cnt"))


def missing_customers(state: State, delivered: DataFrame) -> DataFrame:
    """Delivered orders whose customer row does not exist (reported, the order
    is still delivered)."""
    d = delivered.where(F.col("o_id").isNotNull())
    c = state.customer.select(F.col("c_w_id").alias("w_id"), F.col("c_d_id").alias("d_id"), "c_id")
    return d.join(c, ["w_id", "d_id", "c_id"], "left_anti")


# --- W4 ledger postings ----------------------------------------------------------------

def ledger_post(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """Apply transfers (from_acct, to_acct, amount) to accounts (acct, balance):
    each transfer is two postings (-amount, +amount), summed per account and
    left-joined onto the balances.  Sum of all postings is zero by construction."""
    post = transfers.select(F.col("from_acct").alias("acct"), (-F.col("amount")).alias("delta")) \
        .unionByName(transfers.select(F.col("to_acct").alias("acct"), F.col("amount").alias("delta")))
    g = post.groupBy("acct").agg(F.sum("delta").alias("_d"), F.count(F.lit(1)).alias("n_postings"))
    j = accounts.join(g, "acct", "left")
    return j.select("acct", (F.col("balance") + F.coalesce(F.col("_d"), F.lit(0))).alias("balance"),
                    F.coalesce(F.col("n_postings"), F.lit(0)).alias("n_postings"))
