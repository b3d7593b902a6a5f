"""Integrity checks: key uniqueness, referential integrity, replay invariants.

Spark enforces no keys; these jobs report violations as rows (an empty result
means the check holds).  All are aggregations or anti-joins: no violation
row is ever collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.sources.sinks import BUCKETED, same_key


def _key_text(cols: Sequence[str]) -> F.Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def pk_violations(df: DataFrame, keys: Sequence[str], table: str) -> DataFrame:
    """A3: keys that occur more than once -> (tbl, key, n)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.select(F.lit(table).alias("tbl"), _key_text(keys).alias("key"), "n")


def fk_violations(child: DataFrame, child_cols: Sequence[str], parent: DataFrame,
                  parent_cols: Sequence[str], name: str) -> DataFrame:
    """A4: child keys without a parent row -> (fk, key, n_rows), one row per key."""
    p = parent.select(*[F.col(a).alias(f"_p{n}") for n, a in enumerate(parent_cols)]).distinct()
    cond = None
    for n, c in enumerate(child_cols):
        e = F.col(c) == F.col(f"_p{n}")
        cond = e if cond is None else cond & e
    orphans = child.select(*child_cols).join(p, cond, "left_anti")
    g = orphans.groupBy(*child_cols).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select(F.lit(name).alias("fk"), _key_text(child_cols).alias("key"), "n_rows")


# Keys and foreign keys of the given tables (fixed schema facts).
SOURCE_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"],
}

SOURCE_FKS = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
]


def check_pk(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for t, keys in SOURCE_KEYS.items():
        v = pk_violations(tables[t], keys, t)
        out = v if out is None else out.unionByName(v)
    return out


def check_fk(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for child, cc, parent, pc in SOURCE_FKS:
        v = fk_violations(tables[child], cc, tables[parent], pc, f"{child}->{parent}")
        out = v if out is None else out.unionByName(v)
    return out


def check_invariants(district: DataFrame, order_ids: DataFrame, delivery: DataFrame,
                     lines: DataFrame, ytd: DataFrame, warehouse: DataFrame | None = None) -> DataFrame:
    """W5 audit of a replay -> (check, w_id, d_id, detail); empty when all hold.

    * new o_ids of a district are dense and start at the old d_next_o_id;
    * an order is delivered at most once;
    * every stock draw leaves 10 <= s_quantity <= 109;
    * the change of a warehouse's YTD equals the sum of the changes of its
      districts' YTD (``ytd`` holds the values after the batch; the values
      before come from ``district`` and ``warehouse``).
    """
    d = district.select(F.col("d_w_id").alias("w_id"), "d_id", "d_next_o_id")
    g = order_ids.groupBy("w_id", "d_id").agg(F.min("o_id").alias("lo"), F.max("o_id").alias("hi"),
                                              F.count(F.lit(1)).alias("n"))
    dense = g.join(d, ["w_id", "d_id"], "inner").where(
        (F.col("lo") != F.col("d_next_o_id")) | (F.col("hi") - F.col("lo") + 1 != F.col("n")))
    dense = dense.select(F.lit("o_id_dense").alias("check"), "w_id", "d_id",
                         F.concat_ws(",", "lo", "hi", "n").alias("detail"))
    dl = delivery.where(F.col("o_id").isNotNull()).groupBy("w_id", "d_id", "o_id") \
                 .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    dl = dl.select(F.lit("delivered_once").alias("check"), "w_id", "d_id",
                   F.concat_ws(",", "o_id", "n").alias("detail"))
    st = lines.where((F.col("s_quantity_after") < 10) | (F.col("s_quantity_after") > 109))
    st = st.select(F.lit("stock_range").alias("check"), "w_id", "d_id",
                   F.concat_ws(",", "supply_w_id", "i_id", "s_quantity_after").alias("detail"))
    before_d = district.select(F.col("d_w_id").alias("w_id"), "d_id",
                               (F.col("d_ytd") * 100).cast("long").alias("_d0"))
    dy = ytd.join(before_d, ["w_id", "d_id"], "left").withColumn(
        "_dd", F.col("d_ytd_cents") - F.coalesce(F.col("_d0"), F.lit(0)))
    wy = dy.groupBy("w_id").agg(F.sum("_dd").alias("s"), F.max("w_ytd_cents").alias("w"))
    if warehouse is not None:
        w0 = warehouse.select("w_id", (F.col("w_ytd") * 100).cast("long").alias("_w0"))
        wy = wy.join(w0, "w_id", "left").withColumn("w", F.col("w") - F.coalesce(F.col("_w0"), F.lit(0)))
    wy = wy.where(F.col("s") != F.col("w")).select(
        F.lit("ytd_balance").alias("check"), "w_id", F.lit(None).cast("int").alias("d_id"),
        F.concat_ws(",", "s", "w").alias("detail"))
    return dense.unionByName(dl).unionByName(st).unionByName(wy)


# --- W5: audit of two snapshots ---------------------------------------------------------

def _cents(col: str) -> F.Column:
    return (F.col(col) * 100).cast("long")


def _versions(old: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str],
              laid: Sequence[str] | None = None) -> DataFrame:
    """Full outer diff: ``keys``, each of ``cols`` as o_<col> and n_<col>, and _old / _new,
    which are null where that side has no such row.  ``laid``: the keys that both sides are
    laid out by, if those are not all."""
    a = old.select(*keys, *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("_old"))
    b = new.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_new"))
    j = a.join(b, same_key(list(keys), list(laid or keys)), "full")
    return j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], *[c for c in j.columns if c.lstrip("_") not in keys])


def _found(df: DataFrame, rules: dict[str, F.Column], w: str, d: str | None, key: str | None, detail: F.Column) -> DataFrame:
    """One row for each rule that a row breaks; the rows are read once for all rules."""
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.select(F.explode(F.array_compact(names)).alias("check"), F.col(w).cast("int").alias("w_id"),
                     (F.col(d) if d else F.lit(None)).cast("int").alias("d_id"),
                     (F.col(key) if key else F.lit(None)).cast("long").alias("id"), detail.cast("string").alias("detail"))


def _differs(*cols: str) -> F.Column:
    out = F.lit(False)
    for c in cols:
        out = out | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    return out


def audit_states(old, new) -> DataFrame:
    """W5: what a correct run can't have done between two snapshots of a state
    -> (check, w_id, d_id, id, detail), empty when every rule holds:

    * no district, customer, order or line is lost;
    * a district's next order id never falls and rises by the orders added;
    * a warehouse's YTD changes by the sum of its districts' YTD changes;
    * a customer's balance changes by the amounts delivered to them less what they
      paid, the delivery count by the orders delivered; payments never get fewer;
    * an order's carrier is set once; its customer, size and entry date, and a line's
      item, quantity, amount and supplier never change.

    Needs nothing but the snapshots: what was delivered follows from the carriers.
    A table is diffed by one full join on its key, on which both sides can be laid
    out alike; sums combine on the map side, so a hot district is no hot task."""
    dist = _versions(old.district, new.district, ["d_w_id", "d_id"], ["d_next_o_id", "d_ytd"])
    orders = _versions(old.orders, new.orders, ["o_w_id", "o_d_id", "o_id"],
                       ["o_c_id", "o_carrier_id", "o_entry_d"])
    added = orders.where("_old is null").groupBy(F.col("o_w_id").alias("d_w_id"), F.col("o_d_id").alias("d_id")) \
        .agg(F.count(F.lit(1)).alias("_added"))
    dist_rows = dist.join(added, ["d_w_id", "d_id"], "left").withColumn("_added", F.coalesce("_added", F.lit(0)))
    both = F.col("_old") & F.col("_new")
    lost = F.col("_new").isNull()
    out = _found(dist_rows, {
        "district_lost": lost,
        "next_o_id_falls": both & (F.col("n_d_next_o_id") < F.col("o_d_next_o_id")),
        "orders_added": both & (F.col("n_d_next_o_id") - F.col("o_d_next_o_id") != F.col("_added")),
    }, "d_w_id", "d_id", None, F.concat_ws(",", "o_d_next_o_id", "n_d_next_o_id", "_added"))

    by_w = dist.groupBy(F.col("d_w_id").alias("w_id")).agg(
        F.sum(F.coalesce(_cents("n_d_ytd"), F.lit(0)) - F.coalesce(_cents("o_d_ytd"), F.lit(0))).alias("_sum"))
    wh = _versions(old.warehouse, new.warehouse, ["w_id"], ["w_ytd"]).join(by_w, "w_id", "left")
    wh = wh.withColumn("_change", F.coalesce(_cents("n_w_ytd"), F.lit(0)) - F.coalesce(_cents("o_w_ytd"), F.lit(0)))
    out = out.unionByName(_found(wh, {"warehouse_lost": lost, "ytd_change": both & ~F.col("_change").eqNullSafe(F.col("_sum"))},
                                 "w_id", None, None, F.concat_ws(",", "_change", "_sum")))

    # delivered between the snapshots: orders that have a carrier now and had none
    sent = orders.where("o_o_carrier_id is null and n_o_carrier_id is not null") \
        .select(F.col("o_w_id").alias("ol_w_id"), F.col("o_d_id").alias("ol_d_id"), F.col("o_id").alias("ol_o_id"),
                F.col("n_o_c_id").alias("c_id"))
    lines = new.orderline.select("ol_w_id", "ol_d_id", "ol_o_id", _cents("ol_amount").alias("_a"))
    amount = sent.join(lines, ["ol_w_id", "ol_d_id", "ol_o_id"], "left").groupBy("ol_w_id", "ol_d_id", "ol_o_id", "c_id") \
        .agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("_a"))
    got = amount.groupBy(F.col("ol_w_id").alias("c_w_id"), F.col("ol_d_id").alias("c_d_id"), "c_id") \
        .agg(F.sum("_a").alias("_got"), F.count(F.lit(1)).alias("_n"))
    cust = _versions(old.customer, new.customer, ["c_w_id", "c_d_id", "c_id"],
                     ["c_balance", "c_ytd_payment", "c_payment_cnt", "c_delivery_cnt"])
    cust = cust.join(got, ["c_w_id", "c_d_id", "c_id"], "left") \
        .withColumn("_got", F.coalesce("_got", F.lit(0))).withColumn("_n", F.coalesce("_n", F.lit(0))) \
        .withColumn("_change", _cents("n_c_balance") - _cents("o_c_balance")) \
        .withColumn("_paid", _cents("n_c_ytd_payment") - _cents("o_c_ytd_payment"))
    out = out.unionByName(_found(cust, {
        "customer_lost": lost,
        "balance_change": both & (F.col("_change") != F.col("_got") - F.col("_paid")),
        "delivery_count": both & (F.col("n_c_delivery_cnt") - F.col("o_c_delivery_cnt") != F.col("_n")),
        "payment_count": both & (F.col("n_c_payment_cnt") < F.col("o_c_payment_cnt")),
    }, "c_w_id", "c_d_id", "c_id", F.concat_ws(",", "_change", "_got", "_paid")))

    out = out.unionByName(_found(orders, {
        "order_lost": lost,
        "carrier_changed": both & F.col("o_o_carrier_id").isNotNull() & _differs("o_carrier_id"),
        "order_changed": both & _differs("o_c_id", "o_entry_d"),
    }, "o_w_id", "o_d_id", "o_id", F.concat_ws(",", "o_o_carrier_id", "n_o_carrier_id")))
    ol = _versions(old.lines_with_supply, new.lines_with_supply, ["ol_w_id", "ol_d_id", "ol_o_id", "ol_number"],
                   ["ol_i_id", "ol_quantity", "ol_amount", "ol_supply_w_id"], laid=BUCKETED["orderline"])
    return out.unionByName(_found(ol, {
        "line_lost": lost, "line_changed": both & _differs("ol_i_id", "ol_quantity", "ol_amount", "ol_supply_w_id"),
    }, "ol_w_id", "ol_d_id", "ol_o_id", F.col("ol_number")))
