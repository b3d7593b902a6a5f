"""Run transaction files end to end: the set-oriented form of a client run.

``run_log`` reads every client file under a folder, orders the records
(round-robin over files, ``txlog.client_interleave``), applies the writes
(N, P, D) as one batch with ``chain.apply_batch`` and answers every read
record with the matching operator, each read type as one job over all its
records (the record's ``ord`` is its ``req_id``):

every read as of its place in the log (``plans.as_of``): O with name, balance,
header and all lines, S and I by the district's next order id and the stock after
the earlier N records, T by the balances after the earlier payments and
deliveries, R by the orders placed before it.

``report`` holds the printed lines of every applied record (``operators.report``).
Malformed records and records that reference missing rows are returned in
``errors`` with their reason; they change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.functions.money import cents
from depotline.operators import reads
from depotline.operators import report as text
from depotline.operators.writes import payment_receipts
from depotline.plans.chain import apply_batch
from depotline.plans.as_of import next_order_as_of, order_status_as_of, related_as_of, stock_as_of, top_balance_as_of
from depotline.plans.replay import Log, Replay, balance_ledger, replay_reads
from depotline.sources.adapter import State
from depotline.sources.sinks import work_table
from depotline.sources.txlog import client_interleave, parse_rows, read_lines, valid_and_errors

TOP_K = 10


# ord of batch b starts at b * BATCH_ORD_SPAN (records of later batches sort later)
BATCH_ORD_SPAN = 1 << 40


def records_to_log(records: DataFrame, order_lines: DataFrame, batch_id: int) -> Log:
    r = client_interleave(records).withColumn("ord", F.col("ord") + F.lit(batch_id * BATCH_ORD_SPAN))
    n_hdr = r.where(F.col("txn_type") == "N").select("ord", "w_id", "d_id", "c_id", "file", "record_no")
    n_lines = order_lines.join(n_hdr.select("ord", "file", "record_no"), ["file", "record_no"]) \
                         .select("ord", "ol_number", "i_id", "supply_w_id", "qty")
    n_hdr = n_hdr.drop("file", "record_no")
    pay = r.where(F.col("txn_type") == "P").select("ord", "w_id", "d_id", "c_id", "amount")
    dlv = r.where(F.col("txn_type") == "D").select("ord", "w_id", "carrier_id")
    status = r.where(F.col("txn_type") == "O").select("ord", "w_id", "d_id", "c_id")
    reads = r.where(F.col("txn_type").isin("S", "I", "T", "R")).select(
        "ord", "txn_type", "w_id", "d_id", "c_id", "threshold", "last_l")
    return Log(n_hdr=n_hdr, n_lines=n_lines, pay=pay, dlv=dlv, status=status, reads=reads)


def answers(rp: Replay, after: State, as_of_ts: str = "2000-01-01 00:00:00") -> dict[str, DataFrame]:
    """The read records of a batch answered as of their place; ``after`` is the state
    that the batch leaves."""
    levels = next_order_as_of(rp.state, rp.order_ids, rp.log.asked("S", "w_id", "d_id", "threshold", "last_l"))
    recent = next_order_as_of(rp.state, rp.order_ids, rp.log.asked("I", "w_id", "d_id", "last_l"))
    return {
        "order_status": order_status_as_of(rp, replay_reads(rp), as_of_ts),
        "stock_level": reads.stock_level(after, levels, stock_as_of(rp.state, rp.lines, reads.recent_items(after, levels))),
        "popular_items": reads.popular_items(after, recent),
        "popular_item_pct": reads.popular_item_pct(after, recent),
        "popular_item_pct_by_name": reads.popular_item_pct_by_name(after, recent),
        "top_balance": top_balance_as_of(rp, rp.log.asked("T").withColumnRenamed("req_id", "ord"), balance_ledger(rp), TOP_K),
        "related_customers": related_as_of(rp, rp.log.asked("R", "w_id", "d_id", "c_id")),
    }


def report(rp: Replay, out: dict[str, DataFrame], as_of_ts: str = "2000-01-01 00:00:00") -> DataFrame:
    """The results of a batch as the printed lines of its records: (ord, line_no, text)."""
    asked = rp.log.asked
    amounts = rp.lines.withColumn("amount_cents", cents(F.col("amount")))
    recent = asked("I", "w_id", "d_id", "last_l")
    parts = [
        text.render_new_orders(rp.totals(), amounts, as_of_ts),
        text.render_payment_receipts(payment_receipts(rp.state, rp.log.pay)),
        text.render_deliveries(rp.log.dlv),
        text.render_order_status(out["order_status"]),
        text.render_stock_level(out["stock_level"]),
        text.render_popular_items(recent, out["popular_items"], out["popular_item_pct_by_name"]),
        text.render_top_balance(asked("T"), out["top_balance"]),
        text.render_related(asked("R", "w_id", "d_id", "c_id"), out["related_customers"]),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    return lines


def run_log(spark: SparkSession, state: State, path: str, skip=(), as_of_ts: str = "2000-01-01 00:00:00",
            key: str | None = None) -> dict[str, DataFrame]:
    own = f"{key}-{uuid.uuid4().hex[:12]}"

    def store(name: str, df: DataFrame) -> DataFrame:
        return work_table(spark, own, name, lambda: df) if key else df

    typed, order_lines, orphan = parse_rows(read_lines(spark, path), skip=skip, store=store)
    # parsed once; every later step reads the written records
    records, errors = valid_and_errors(store("records", typed), orphan)
    order_lines = store("order_lines", order_lines)
    log = records_to_log(records, order_lines, 0)
    nxt, rp = apply_batch(spark, state, log, as_of_ts, key=key)
    r = client_interleave(records)
    missing = rp.errors.select("ord", "reason").join(r.select("ord", "file", "record_no", "txn_type"), "ord") \
                .select("file", "record_no", "reason", F.col("txn_type").alias("text"))
    found = answers(rp, nxt, as_of_ts)
    return {
        "errors": errors.unionByName(missing),
        "state": nxt,
        "new_order_totals": rp.totals(),
        "new_order_lines": rp.lines,
        "payments": rp.log.pay,
        "deliveries": rp.delivery,
        **found,
        "report": report(rp, found, as_of_ts),
    }
