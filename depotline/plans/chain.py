"""P7: apply a batch of log records to a state and produce the next state.

A long log can be cut into batches; the state after batch b feeds batch b+1.
A batch changes rows: ``batch_changes`` gives the changed and the new rows of every
table, whole rows by key (no table ever loses a row, so there are no tombstones).
``write_delta`` writes these rows only, so the bytes of a batch follow the batch and
not the state; ``read_chain`` puts the newest version of every changed key in
place of the snapshot's row, and ``write_snapshot`` compacts a chain of deltas.
Cutting the log must not change the results: the test-suite compares a one-batch
replay with a two-batch chain.

Folders of a chain: ``v=<n>/full/<table>`` and ``v=<n>/delta/<table>``; a version
counts once its ``done`` marker is written, so a lost driver leaves nothing half read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.functions.money import MONEY, TOTAL_MONEY, WIDE_MONEY
from depotline.operators import writes
from depotline.plans.replay import Log, Replay, replay_balance, validate, without
from depotline.schema import KEYS
from depotline.sources.adapter import State
from depotline.sources.sinks import BUCKETED, _exists, freed_shuffles, same_key, work_table

DEFAULT_AS_OF = "2000-01-01 00:00:00"

CHAIN_TABLES = ["warehouse", "district_base", "district", "customer", "orders", "orderline", "item",
                "stock_overrides"]
# The tables that a batch changes, with their keys.
CHANGED = {**{t: KEYS[t] for t in ("warehouse", "district", "customer", "orders", "orderline")},
           "stock_overrides": KEYS["stock"]}


def apply_batch(spark: SparkSession, state: State, log: Log, as_of_ts: str = DEFAULT_AS_OF,
                key: str | None = None) -> tuple[State, Replay]:
    """-> (next state, the batch's replay with all per-record results).

    Records that reference missing rows are rejected first; ``errors`` of the
    returned replay holds them with their reasons.  ``as_of_ts`` is the entry
    date of new orders and the delivery date of delivered lines (a parameter,
    never the clock).  Work tables are this call's own: ``key`` only begins
    their folder's name."""
    key = key and f"{key}-{uuid.uuid4().hex[:12]}"
    found = validate(state, log)
    errors = work_table(spark, key, "errors", lambda: found) if key else found
    rp = Replay(spark, state, without(log, errors), key)
    rp.errors = errors
    rp.changes = batch_changes(state, rp, as_of_ts)
    return with_changes(state, rp.changes), rp


def batch_changes(state: State, rp: Replay, as_of_ts: str = DEFAULT_AS_OF) -> dict[str, DataFrame]:
    """The rows that the batch changes or adds, whole rows, one per key of ``CHANGED``."""
    ts = F.lit(as_of_ts).cast("timestamp")

    # warehouses and districts: payments and new orders
    n_new = rp.order_ids.groupBy(F.col("w_id").alias("d_w_id"), "d_id").agg(F.count(F.lit(1)).alias("_n"))
    pay_d = rp.log.pay.groupBy(F.col("w_id").alias("d_w_id"), "d_id").agg(F.sum("amount").cast(WIDE_MONEY).alias("_p"))
    dist = state.district.join(n_new, ["d_w_id", "d_id"], "left").join(pay_d, ["d_w_id", "d_id"], "left") \
        .where(F.col("_n").isNotNull() | F.col("_p").isNotNull())
    dist = dist.withColumn("d_next_o_id", (F.col("d_next_o_id") + F.coalesce(F.col("_n"), F.lit(0))).cast("long")) \
        .withColumn("d_ytd", (F.col("d_ytd") + F.coalesce(F.col("_p"), F.lit(0))).cast(TOTAL_MONEY)).drop("_n", "_p")
    pay_w = rp.log.pay.groupBy("w_id").agg(F.sum("amount").cast(WIDE_MONEY).alias("_p"))
    wh = state.warehouse.join(pay_w, "w_id") \
        .withColumn("w_ytd", (F.col("w_ytd") + F.col("_p")).cast(TOTAL_MONEY)).drop("_p")

    # customers: balances and counts after payments and deliveries
    bal = replay_balance(rp).select(
        "c_w_id", "c_d_id", "c_id",
        (F.col("c_balance_cents").cast("decimal(20,0)") / 100).cast(TOTAL_MONEY).alias("c_balance"),
        (F.col("c_ytd_payment_cents").cast("decimal(20,0)") / 100).cast(TOTAL_MONEY).alias("c_ytd_payment"),
        F.col("c_payment_cnt").cast("int").alias("c_payment_cnt"), F.col("c_delivery_cnt").cast("int").alias("c_delivery_cnt"))
    kept = state.customer.drop("c_balance", "c_ytd_payment", "c_payment_cnt", "c_delivery_cnt")
    cust = kept.join(bal, CHANGED["customer"]).select(*state.customer.columns)

    # orders: those delivered now, plus the new ones
    delivered = rp.delivery.where(F.col("o_id").isNotNull()).select(
        F.col("w_id").alias("o_w_id"), F.col("d_id").alias("o_d_id"), "o_id", F.col("carrier_id").alias("_carrier"))
    old_o = state.orders.join(delivered, CHANGED["orders"]).withColumn("o_carrier_id", F.col("_carrier")).drop("_carrier")
    size = rp.lines.groupBy("ord").agg(
        F.count(F.lit(1)).cast("int").alias("o_ol_cnt"),
        F.min((F.col("supply_w_id") == F.col("w_id")).cast("int")).alias("o_all_local"))
    new_o = rp.order_ids.join(size, "ord", "left").select(
        F.col("w_id").alias("o_w_id"), F.col("d_id").alias("o_d_id"), "o_id", F.col("c_id").alias("o_c_id"),
        ts.alias("o_entry_d"), F.coalesce("o_ol_cnt", F.lit(0)).alias("o_ol_cnt"),
        F.coalesce("o_all_local", F.lit(1)).alias("o_all_local"))
    new_o = new_o.join(delivered, CHANGED["orders"], "left").withColumnRenamed("_carrier", "o_carrier_id")

    # order lines: the delivery date of those delivered now, plus the new lines
    sent = delivered.select(F.col("o_w_id").alias("ol_w_id"), F.col("o_d_id").alias("ol_d_id"),
                            F.col("o_id").alias("ol_o_id"), ts.alias("_sent"))
    on_order = CHANGED["orderline"][:3]
    old_l = state.lines_with_supply.join(sent, on_order).withColumn("ol_delivery_d", F.col("_sent")).drop("_sent")
    new_l = rp.lines.select(F.col("w_id").alias("ol_w_id"), F.col("d_id").alias("ol_d_id"),
                            F.col("o_id").alias("ol_o_id"), "ol_number", F.col("i_id").alias("ol_i_id"),
                            F.col("amount").cast(MONEY).alias("ol_amount"),
                            F.col("supply_w_id").alias("ol_supply_w_id"), F.col("qty").alias("ol_quantity"),
                            "ol_dist_info")
    new_l = new_l.join(sent, on_order, "left").withColumnRenamed("_sent", "ol_delivery_d")

    # stock: the keys drawn by the batch (stock_after starts from the state's own overrides)
    stock = writes.stock_after(state, rp.log.n_hdr, rp.log.n_lines).select(
        "s_w_id", "s_i_id", "s_quantity", "s_ytd", "s_order_cnt", "s_remote_cnt")
    if state.stock_overrides is not None:
        stock = stock.withColumn("s_ytd", F.col("s_ytd").cast(state.stock_overrides.schema["s_ytd"].dataType))
    return {"warehouse": wh, "district": dist, "customer": cust,
            "orders": old_o.unionByName(new_o, allowMissingColumns=True),
            "orderline": old_l.unionByName(new_l, allowMissingColumns=True), "stock_overrides": stock}


def upsert(base: DataFrame | None, changed: DataFrame, keys: list[str], laid: list[str] | None = None) -> DataFrame:
    """``base`` with the rows of ``changed`` in place of those of their keys, and the new ones.
    Rows of ``base`` that are laid out by the columns ``laid`` meet the changed ones as they lie."""
    if base is None:
        return changed
    gone = changed.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return base.join(gone, same_key(keys, laid or keys), "left_anti").unionByName(changed, allowMissingColumns=True)


def with_changes(state: State, changes: dict[str, DataFrame]) -> State:
    base = {**{n: getattr(state, n) for n in CHAIN_TABLES}, "orderline": state.lines_with_supply}
    return State(sources=state.sources, stock_table=state.stock_table,
                 **{n: upsert(t, changes[n], CHANGED[n], BUCKETED.get(n)) if n in changes else t for n, t in base.items()})


# --- a chain on disk ------------------------------------------------------------------

# Every so many versions the stream writes a full snapshot again, so that a reader
# merges fewer deltas than this.
COMPACT_EVERY = 8


def _done(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/done")


def write_snapshot(state: State, path: str) -> None:
    """Every table whole, below ``path``/full."""
    for name in CHAIN_TABLES:
        df = getattr(state, name)
        if df is not None:
            with freed_shuffles(df.sparkSession):
                df.write.mode("overwrite").parquet(f"{path}/full/{name}")
    _done(state.district.sparkSession, f"{path}/full")


def write_delta(changes: dict[str, DataFrame], path: str) -> None:
    """The changed rows only, below ``path``/delta."""
    for name, df in changes.items():
        with freed_shuffles(df.sparkSession):
            df.write.mode("overwrite").parquet(f"{path}/delta/{name}")
    _done(changes["district"].sparkSession, f"{path}/delta")


def read_snapshot(spark: SparkSession, path: str, like: State) -> State:
    tables = {}
    for name in CHAIN_TABLES:
        p = f"{path}/full/{name}"
        tables[name] = spark.read.parquet(p) if _exists(spark, p) else None
    return State(sources=like.sources, stock_table=like.stock_table, **tables)


def read_chain(spark: SparkSession, root: str, version: int, like: State) -> State:
    """The state after ``version``: the newest snapshot up to it and the deltas since.

    Versions without a finished snapshot or delta (batches that never ran) are
    passed over; a chain without any snapshot starts from ``like``.  Of a key's versions in the deltas the newest wins, by an
    aggregation that combines on the map side; the snapshot is read once."""
    deltas = []
    for v in range(version, -2, -1):
        if _exists(spark, f"{root}/v={v}/full/done"):
            break
        if _exists(spark, f"{root}/v={v}/delta/done"):
            deltas.append(v)
    else:
        v = None
    state = like if v is None else read_snapshot(spark, f"{root}/v={v}", like)
    if not deltas:
        return state
    return with_changes(state, {n: newest_rows(spark, root, deltas, n) for n in CHANGED})


def newest_rows(spark: SparkSession, root: str, versions: list[int], table: str) -> DataFrame:
    """The newest row of every key of ``table`` in the deltas of ``versions``."""
    rows = None
    for v in versions:
        d = spark.read.parquet(f"{root}/v={v}/delta/{table}").withColumn("_v", F.lit(v))
        rows = d if rows is None else rows.unionByName(d, allowMissingColumns=True)
    cols = [c for c in rows.columns if c != "_v"]
    if len(versions) == 1:
        return rows.select(*cols)
    newest = rows.groupBy(*CHANGED[table]).agg(F.max_by(F.struct(*cols), F.col("_v")).alias("_r"))
    return newest.select("_r.*")


def run_chain(spark: SparkSession, state: State, batches: list[Log], root: str, key: str,
              as_of_ts: str = DEFAULT_AS_OF) -> State:
    """Apply the batches one after the other, each to the state that the deltas so far
    give, and return the last state.  Finished batches of ``root`` are not run again."""
    for v, log in enumerate(batches):
        if not _exists(spark, f"{root}/v={v}/delta/done"):
            _, rp = apply_batch(spark, read_chain(spark, root, v - 1, state), log, as_of_ts, key=key)
            write_delta(rp.changes, f"{root}/v={v}")
    return read_chain(spark, root, len(batches) - 1, state)


def split_log(log: Log, cut) -> tuple[Log, Log]:
    """Records with ord < cut (a number or a scalar column), and the rest."""
    return log.each(lambda _, df: df.where(F.col("ord") < cut)), log.each(lambda _, df: df.where(F.col("ord") >= cut))
