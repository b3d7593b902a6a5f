"""P6: reads as of their place in a log.

A read record sees the state after all records with a smaller ``ord``.  State
that changes inside the log is kept as version rows, each valid for a range
of ``ord``; a read finds its version by an equi-join on the key (orders: at
most three versions) or by counting (next order ids, stock draws).

* ``order_status_as_of``: balance and last order by running aggregates, the
  header from the version of that order, all lines with their delivery date;
* ``top_balance_as_of``: a temporal top-k, see there;
* ``related_as_of``: item pairs carry the ``ord`` of their order; the orders of both sides must be
  older than the read.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotline.functions.money import cents
from depotline.functions.sequencing import running_aggs
from depotline.operators.reads import fmt_ts, item_pairs, ordered_item_pairs, with_place_names
from depotline.sources.adapter import State

BEFORE = -1  # the ord of what was there before the log
ENTRY_TS = "2000-01-01 00:00:00"


def next_order_as_of(state: State, order_ids: DataFrame, req: DataFrame) -> DataFrame:
    """``req`` (req_id = ord, w_id, d_id, ...) with ``next_o_id``: the district's next
    order id when all earlier N records of the log have been applied."""
    ev = order_ids.select("ord", "w_id", "d_id", F.lit(1).cast("long").alias("_n")) \
        .unionByName(req.select(F.col("req_id").alias("ord"), "w_id", "d_id", F.lit(0).cast("long").alias("_n")))
    seen = running_aggs(ev, ["w_id", "d_id"], "ord", [("_n", "_before", "sum", True)]) \
        .where("_n = 0").select(F.col("ord").alias("req_id"), "_before")
    d = state.district.select(F.col("d_w_id").alias("w_id"), "d_id", "d_next_o_id")
    return req.join(seen, "req_id").join(d, ["w_id", "d_id"]) \
              .withColumn("next_o_id", F.col("d_next_o_id") + F.col("_before")).drop("_before", "d_next_o_id")


def log_orders(rp, entry_ts: str = ENTRY_TS) -> tuple[DataFrame, DataFrame]:
    """The orders and the lines of the log's N records, as rows of the state."""
    new_o = rp.order_ids.select(F.col("w_id").alias("o_w_id"), F.col("d_id").alias("o_d_id"), "o_id",
                                F.col("c_id").alias("o_c_id"), F.lit(entry_ts).cast("timestamp").alias("o_entry_d"))
    new_l = rp.lines.select(F.col("w_id").alias("ol_w_id"), F.col("d_id").alias("ol_d_id"), F.col("o_id").alias("ol_o_id"),
                            "ol_number", F.col("i_id").alias("ol_i_id"), F.col("qty").alias("ol_quantity"),
                            F.col("amount").alias("ol_amount"), F.col("supply_w_id").alias("ol_supply_w_id"))
    return new_o, new_l


def after_orders(rp, entry_ts: str = ENTRY_TS) -> State:
    """The state with the orders and lines of the log's N records added (what reads as
    of a point of the log look into; their own keys keep later ones out)."""
    new_o, new_l = log_orders(rp, entry_ts)
    return replace(rp.state, key=None, orders=rp.state.orders.unionByName(new_o, allowMissingColumns=True),
                   orderline=rp.state.lines_with_supply.unionByName(new_l, allowMissingColumns=True))


def stock_as_of(state: State, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(req_id, i_id, s_quantity): for ``wanted`` (req_id = ord, w_id, i_id) the stock
    after the last draw with a smaller ord, or that of ``state``.

    Each read takes the newest draw before it in one running pass over the draws and
    reads of its stock key; of repeated draws the lowest stock is taken as the newest."""
    draws = lines.select("ord", F.col("supply_w_id").alias("w_id"), "i_id", "ol_number",
                         F.struct("ord", "ol_number", (-F.col("s_quantity_after")).alias("less")).alias("_draw"))
    reads = wanted.select(F.col("req_id").alias("ord"), "w_id", "i_id", F.lit(0).alias("ol_number"),
                          F.lit(None).cast(draws.schema["_draw"].dataType).alias("_draw"))
    keys = wanted.select(F.col("w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id")).distinct()
    base = state.stock_for(keys).select(F.col("s_w_id").alias("w_id"), F.col("s_i_id").alias("i_id"), "s_quantity")
    ev = running_aggs(draws.unionByName(reads), ["w_id", "i_id"], "ord", [("_draw", "_last", "last", True)],
                      tiebreak=["ol_number"], per_key=base)
    return ev.where("_draw is null").select(F.col("ord").alias("req_id"), "i_id",
                                            F.coalesce(-F.col("_last.less"), "s_quantity").alias("s_quantity"))


# --- order status --------------------------------------------------------------------------

def order_versions(rp, wanted: DataFrame) -> DataFrame:
    """(w_id, d_id, o_id, ord_from, ord_to, carrier_id, in_log) of the orders of ``wanted``
    (w_id, d_id, o_id): an order's carrier from ``ord_from`` on, up to and without ``ord_to``."""
    key = ["w_id", "d_id", "o_id"]
    old = rp.state.orders.select(F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id",
                                 F.lit(BEFORE).cast("long").alias("ord_from"), F.col("o_carrier_id").alias("carrier_id"),
                                 F.lit(False).alias("in_log"))
    new = rp.order_ids.select(*key, F.col("ord").alias("ord_from"), F.lit(None).cast("int").alias("carrier_id"),
                              F.lit(True).alias("in_log"))
    given = rp.delivery.where(F.col("o_id").isNotNull()).select(*key, F.col("ord").alias("ord_from"), "carrier_id",
                                                                F.lit(True).alias("in_log"))
    rows = old.unionByName(new).unionByName(given).join(wanted, key, "left_semi")
    w = Window.partitionBy(*key).orderBy("ord_from")  # an order is placed once and delivered once
    return rows.withColumn("ord_to", F.lead("ord_from", 1, (1 << 63) - 1).over(w))


def asked_lines(rp, asked: DataFrame, as_of_ts: str = ENTRY_TS) -> DataFrame:
    """The orders of ``asked`` (w_id, d_id, o_id), each with its lines (left join).

    The state's orders and those of the log share no key, so each kind is joined with its own
    lines: the state's tables stay as they are laid out and only rows of asked orders move."""
    key = ["w_id", "d_id", "o_id"]
    old_o, old_l = rp.state.orders, rp.state.lines_with_supply
    new_o, new_l = log_orders(rp, as_of_ts)
    new_l = new_l.withColumn("ol_delivery_d", F.lit(None).cast(old_l.schema["ol_delivery_d"].dataType))
    held = None
    for o, ol in ((old_o, old_l), (new_o, new_l)):
        o = o.select(F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id", "o_entry_d")
        ol = ol.select(F.col("ol_w_id").alias("w_id"), F.col("ol_d_id").alias("d_id"), F.col("ol_o_id").alias("o_id"),
                       "ol_number", "ol_i_id", "ol_supply_w_id", "ol_quantity", "ol_amount", "ol_delivery_d")
        part = o.join(asked, key, "left_semi").join(ol, key, "left")
        held = part if held is None else held.unionByName(part)
    return held


def order_status_as_of(rp, reads: DataFrame, as_of_ts: str = ENTRY_TS) -> DataFrame:
    """The full order status of each row of ``reads`` (ord, w_id, d_id, c_id, o_id,
    balance_cents: ``replay.replay_reads``), a row for each line of the order."""
    key = ["w_id", "d_id", "o_id"]
    asked = reads.select(*key).where(F.col("o_id").isNotNull()).distinct()
    ver = order_versions(rp, asked).where("ord_from < ord_to")
    r = reads.select("ord", *key, "c_id", "balance_cents").join(ver, key, "left").where(
        F.col("o_id").isNull() | ((F.col("ord_from") < F.col("ord")) & (F.col("ord") <= F.col("ord_to"))))
    c = rp.state.customer.select(F.col("c_w_id").alias("w_id"), F.col("c_d_id").alias("d_id"), "c_id", "c_first", "c_middle", "c_last")
    j = r.join(asked_lines(rp, asked, as_of_ts), key, "left").join(c, ["w_id", "d_id", "c_id"], "left")
    date = F.when(F.col("carrier_id").isNotNull(),
                  F.when(F.col("in_log"), F.lit(as_of_ts).cast("timestamp")).otherwise(F.col("ol_delivery_d")))
    return j.select(F.col("ord").alias("req_id"), F.col("w_id").alias("c_w_id"), F.col("d_id").alias("c_d_id"), "c_id",
                    "c_first", "c_middle", "c_last", F.col("balance_cents").alias("c_balance_cents"), "o_id",
                    fmt_ts("o_entry_d").alias("o_entry_d"), F.col("carrier_id").alias("o_carrier_id"), "ol_number", "ol_i_id",
                    "ol_supply_w_id", "ol_quantity", cents(F.col("ol_amount")).alias("ol_amount_cents"),
                    fmt_ts(F.when(F.col("ol_number").isNotNull(), date)).alias("ol_delivery_d"))


# --- top balance ---------------------------------------------------------------------------

# Nodes of more than 2^CHUNK_BITS places are looked up apart by the runs of so many places.
CHUNK_BITS = 12


def dyadic_nodes(ver: DataFrame, levels: Column) -> DataFrame:
    """The rows of ``ver`` once for each dyadic node (level, node) of 2^level places that the
    places a .. b - 1 are made up of."""
    first, last = F.expr("shiftright(a + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(b, level)")
    nodes = F.array(F.when(first % 2 == 1, first), F.when(last % 2 == 1, last - 1))
    return ver.withColumn("level", F.explode(F.sequence(F.lit(0), levels))).where(first < last) \
              .withColumn("node", F.explode(nodes)).where("node is not null")


def top_balance_as_of(rp, places: DataFrame, ledger: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` customers with the highest balance at each place (``ord``) of the log.

    Places are numbered.  A customer's balance between two changes is a version
    that holds for a range of places.  Ranges are cut into dyadic nodes (at most
    two for each level), and each node keeps its ``k`` best versions; a place
    then looks at the nodes above it, one for each level, and takes the ``k``
    best of these.  So customers and places are never paired: versions shuffle
    by node with a map-side top-k, and a place reads k rows for each level.
    A version is cut into many nodes, so versions are dealt over all shuffle partitions by
    customer first; a node above many places is repeated for each run of
    2^``CHUNK_BITS`` places, as otherwise one task would answer them all at the root.
    Customers that the log doesn't touch have one version over all places, so
    only the ``k`` best of them matter.  ``ledger``: (ord, w_id, d_id, c_id, delta)."""
    who = ["w_id", "d_id", "c_id"]
    best = [F.desc_nulls_last("bal"), *who]
    base = rp.state.customer.select(F.col("c_w_id").alias("w_id"), F.col("c_d_id").alias("d_id"), "c_id",
                                    cents(F.col("c_balance")).alias("bal"))
    n_places = places.select(F.count(F.lit(1))).scalar()
    none = [F.lit(None).cast(ledger.schema[c].dataType).alias(c) for c in who]
    ev = ledger.select("ord", *who, "delta", F.lit(1).alias("_after")).unionByName(
        places.select("ord", *none, F.lit(None).cast("long").alias("delta"), F.lit(0).alias("_after")))
    ev = running_aggs(ev.withColumn("_all", F.lit(0)), ["_all"], "ord",
                      [((1 - F.col("_after")).cast("long"), "a", "sum", True)], tiebreak=["_after"]).drop("_all")
    asked = ev.where("_after = 0").select("ord", (F.col("a") - 1).alias("place"))
    moves = running_aggs(ev.where("_after = 1").drop("_after"), who, "ord", [("delta", "_sum", "sum", True)])
    moves = moves.groupBy(*who, "a").agg(F.max_by("_sum", "ord").alias("_sum"))  # the last change before a place
    touched = moves.select(*who).distinct()
    start = base.join(touched, who, "left_semi").select(*who, F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("_sum"))
    ver = moves.unionByName(start)
    ver = ver.withColumn("b", F.lead("a").over(Window.partitionBy(*who).orderBy("a")))
    ver = ver.select(*who, "_sum", F.greatest("a", F.lit(0)).alias("a"), F.coalesce("b", n_places).alias("b"))
    ver = ver.join(base, who).select(*who, (F.col("bal") + F.col("_sum")).alias("bal"), "a", "b")
    still = base.join(touched, who, "left_anti").orderBy(*best).limit(k)
    ver = ver.unionByName(still.select(*who, "bal", F.lit(0).cast("long").alias("a"), n_places.alias("b"))).where("a < b")
    levels = F.ceil(F.log2(n_places + 1)).cast("int")
    # a number of its own keeps adaptive execution from putting these partitions together
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = dyadic_nodes(ver.repartition(parts, *who, "a"), levels).select(*who, "bal", "level", "node")
    top = node.withColumn("_r", F.row_number().over(Window.partitionBy("level", "node").orderBy(*best))) \
              .where(F.col("_r") <= k).drop("_r")
    above = asked.withColumn("level", F.explode(F.sequence(F.lit(0), levels))) \
                 .withColumn("node", F.expr("shiftright(place, level)")) \
                 .withColumn("run", F.expr(f"shiftright(place, {CHUNK_BITS})"))
    # the runs of places below a node, or the one that it is part of
    first, last = (F.expr(f"shiftright(shiftleft(node + {n}L, level) - {n}, {CHUNK_BITS})") for n in (0, 1))
    top = top.withColumn("run", F.explode(F.sequence(first, last)))
    found = above.repartition(parts, "level", "node", "run").join(top, ["level", "node", "run"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("ord").orderBy(*best))).where(F.col("rank") <= k)
    names = rp.state.customer.select(F.col("c_w_id").alias("w_id"), F.col("c_d_id").alias("d_id"), "c_id", "c_first", "c_middle", "c_last")
    out = with_place_names(found.join(names, who).withColumnsRenamed({"w_id": "c_w_id", "d_id": "c_d_id"}), rp.state, "c_w_id", "c_d_id")
    return out.select(F.col("ord").alias("req_id"), F.col("rank").cast("int").alias("rank"), "c_w_id",
                      F.col("c_d_id"), "c_id", "c_first", "c_middle", "c_last", F.col("bal").alias("c_balance_cents"),
                      "w_name", "d_name")


# --- related customers ---------------------------------------------------------------------

def dated_item_pairs(rp, who: DataFrame | None = None) -> DataFrame:
    """(w_id, d_id, c_id, i1, i2, since) for every order, of the state and the log, and item pair of it;
    ``since`` is the ord of the order.  Of the customers ``who`` (w_id, d_id, c_id) only, if given."""
    state, ids, lines = rp.state, rp.order_ids.select("ord", "w_id", "d_id", "c_id"), rp.lines.select("ord", "i_id")
    if who is not None:
        o, ol = state.orders, state.orderline
        o = o.join(who, (o.o_w_id == who.w_id) & (o.o_d_id == who.d_id) & (o.o_c_id == who.c_id), "left_semi")
        ol = ol.join(o, (ol.ol_w_id == o.o_w_id) & (ol.ol_d_id == o.o_d_id) & (ol.ol_o_id == o.o_id), "left_semi")
        state, ids = replace(state, orders=o, orderline=ol), ids.join(who, ["w_id", "d_id", "c_id"], "left_semi")
        lines = lines.join(ids, "ord", "left_semi")
    old = ordered_item_pairs(state).withColumn("since", F.lit(BEFORE).cast("long"))
    new = item_pairs(lines.groupBy("ord").agg(F.array_sort(F.collect_set("i_id")).alias("items")), "ord").join(ids, "ord")
    return old.unionByName(new.select("w_id", "d_id", "c_id", "i1", "i2", F.col("ord").alias("since")))


def related_as_of(rp, req: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Related customers of each request (req_id = ord, w_id, d_id, c_id) as of its place.

    Customers are related from the first ord on at which both have an order with a common
    pair, so a customer is searched for once, however often asked for.  The asked customers'
    pairs come from their own lines; the pairs of all orders move once, for the join, and
    are never written."""
    who = ["w_id", "d_id", "c_id"]
    other = dated_item_pairs(rp) if pairs is None else pairs
    asked = req.select(*who).distinct()
    own = dated_item_pairs(rp, asked) if pairs is None else pairs.join(asked, who, "left_semi")
    own = own.groupBy(F.col("w_id").alias("r_w"), F.col("d_id").alias("r_d"), F.col("c_id").alias("r_c"), "i1", "i2") \
             .agg(F.min("since").alias("r_since"))
    found = own.join(other, ["i1", "i2"]).where(F.col("w_id") != F.col("r_w")) \
               .groupBy("r_w", "r_d", "r_c", *who).agg(F.min(F.greatest("since", "r_since")).alias("since"))
    mine = req.select("req_id", *[F.col(c).alias(f"_{c}") for c in who])
    return found.join(mine, (F.col("r_w") == F.col("_w_id")) & (F.col("r_d") == F.col("_d_id")) & (F.col("r_c") == F.col("_c_id"))) \
                .where(F.col("since") < F.col("req_id")).select("req_id", *who).distinct()
