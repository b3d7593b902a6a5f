"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from depotline.operators import derived, reads
from depotline.plans import requests as rq
from depotline.sources.adapter import load_state

Query = Callable[[SparkSession, str], DataFrame]


def _reads(fn) -> Query:
    return lambda spark, sf_dir: fn(load_state(spark, sf_dir, "all"))


def _popular_items(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.popular_items(s, rq.district_requests(s))


def _popular_item_pct(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.popular_item_pct(s, rq.district_requests(s))


def _stock_level(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.stock_level(s, rq.district_requests(s))


def _order_status(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.order_status(s, rq.customer_requests(s))


def _last_order(spark, sf_dir):
    s = load_state(spark, sf_dir)
    lo = reads.last_order(s, rq.customer_requests(s))
    return lo.withColumn("o_entry_d", reads.fmt_ts("o_entry_d"))


def _popular_item_pct_by_name(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.popular_item_pct_by_name(s, rq.district_requests(s))


def _related_customers_by_lines(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.related_customers_by_lines(s, rq.searched_customers(s))


def _related_customers(spark, sf_dir):
    s = load_state(spark, sf_dir)
    return reads.related_customers(s, rq.searched_customers(s))


QUERIES: dict[str, Query] = {
    "popular_items": _popular_items,
    "popular_item_pct": _popular_item_pct,
    "stock_level": _stock_level,
    "order_status": _order_status,
    "last_order": _last_order,
    "top_balance": _reads(lambda s: reads.top_balance(s, rq.TOP_K)),
    "top_balance_by_district": _reads(lambda s: reads.top_balance_by_district(s, rq.TOP_K)),
    "related_customers": _related_customers,
    "related_pairs": _reads(reads.related_pairs),
    "related_customers_by_lines": _related_customers_by_lines,
    "popular_item_pct_by_name": _popular_item_pct_by_name,
    "pending_orders": _reads(reads.pending_orders),
    "oldest_pending": _reads(reads.oldest_pending),
    "order_amount": _reads(reads.order_amount),
    "order_summary": _reads(derived.order_summary),
    "customer_district": _reads(derived.customer_district),
    "orders_orderline": _reads(derived.orders_orderline),
    "stock_item": _reads(derived.stock_item),
}


# --- state-changing jobs and replay (base state + derived log) -------------------

def _replay_q(fn):
    def q(spark, sf_dir):
        from depotline.plans.replay import replay_context
        return fn(replay_context(spark, sf_dir))
    return q


def _register_writes():
    from pyspark.sql import functions as F

    from depotline.functions.money import cents
    from depotline.operators import writes as W
    from depotline.plans import as_of as A
    from depotline.plans import replay as P
    from depotline.sources.sinks import scratch_table

    def nol(rp):
        return rp.lines.withColumn("amount_cents", cents(F.col("amount"))).drop("amount")

    def rstock(rp):
        s = W.stock_after(rp.state, rp.log.n_hdr, rp.log.n_lines)
        return s.select("s_w_id", "s_i_id", F.col("s_order_cnt").alias("n_draws"), "s_quantity")

    def replay_errors(spark, sf_dir):
        rp = P.replay_context(spark, sf_dir)
        return P.replay_errors(rp, P.faulty_records(spark, sf_dir, rp.state))

    def as_of(rp):
        """Reads in the middle of the log: one per 'view' record, of its district."""
        req = rp.log.status.select(F.col("ord").alias("req_id"), "w_id", "d_id",
                                   F.lit(rq.STOCK_THRESHOLD).alias("threshold"), F.lit(rq.LAST_ORDERS).alias("last_l"))
        return A.after_orders(rp), A.next_order_as_of(rp.state, rp.order_ids, req)

    def replay_stock_level(rp):
        after, req = as_of(rp)
        wanted = scratch_table(rp.spark, "asof_items", reads.recent_items(after, req))
        q = A.stock_as_of(rp.state, rp.lines, wanted)
        return reads.stock_level(after, req, q).drop("threshold", "last_l")

    def replay_popular_items(rp):
        after, req = as_of(rp)
        pop = reads.popular_lines(after, reads.recent_keys(after, req))
        return pop.groupBy("req_id").agg(F.count_distinct("o_id").alias("n_orders"), F.count_distinct("i_id").alias("n_items"),
                                         F.sum("max_qty").cast("long").alias("sum_qty"))

    def replay_top_balance(rp):
        places = rp.log.asked("T").withColumnRenamed("req_id", "ord")
        return A.top_balance_as_of(rp, places, P.balance_ledger(rp), rq.TOP_K)

    def replay_related(rp):
        return A.related_as_of(rp, rp.log.asked("R", "w_id", "d_id", "c_id"))

    QUERIES.update({
        "replay_order_ids": _replay_q(P.replay_order_ids),
        "new_order_lines": _replay_q(nol),
        "new_order_totals": _replay_q(lambda rp: rp.totals()),
        "stock_after": _replay_q(lambda rp: W.stock_after(rp.state, rp.log.n_hdr, rp.log.n_lines)),
        "replay_stock": _replay_q(rstock),
        "payment_effects": _replay_q(lambda rp: W.payment_effects(rp.state, rp.log.pay)),
        "payment_receipts": _replay_q(lambda rp: W.payment_receipts(rp.state, rp.log.pay)),
        "delivery_effects": _replay_q(lambda rp: W.deliver(rp.state, rp.log.dlv)),
        "replay_delivery": _replay_q(P.replay_delivery),
        "replay_balance": _replay_q(P.replay_balance),
        "replay_ytd": _replay_q(P.replay_ytd),
        "replay_reads": _replay_q(P.replay_reads),
        "replay_errors": replay_errors,
        "replay_stock_level": _replay_q(replay_stock_level),
        "replay_popular_items": _replay_q(replay_popular_items),
        "replay_order_status": _replay_q(lambda rp: A.order_status_as_of(rp, P.replay_reads(rp))),
        "replay_top_balance": _replay_q(replay_top_balance),
        "replay_related": _replay_q(replay_related),
    })


_register_writes()


# --- chained batches, audit of two snapshots -------------------------------------------

def _register_chain():
    from pyspark.sql import functions as F

    from depotline.functions.money import cents
    from depotline.operators import checks as C
    from depotline.plans import chain as CH
    from depotline.plans.replay import replay_context
    from depotline.sources.adapter import State
    from depotline.sources.sinks import WRITE_LOCK, work_path

    def chained(spark, sf_dir):
        """(base state, state after the derived log in two batches, joined by their deltas)."""
        rp = replay_context(spark, sf_dir)
        half = rp.log.pay.select(F.expr("max(ord) div 2")).scalar()
        with WRITE_LOCK:
            root = work_path(spark, rp.key, "chain")
            return rp.state, CH.run_chain(spark, rp.state, list(CH.split_log(rp.log, half)), root, f"{rp.key}-chain")

    def final_rows(st):
        """A state as (tbl, w_id, d_id, id, v1, v2, v3)."""
        def rows(df, tbl, w, d, key, v1, v2, v3):
            long = [c.cast("long") for c in (key, v1, v2, v3)]
            return df.select(F.lit(tbl).alias("tbl"), F.col(w).cast("int").alias("w_id"), d.cast("int").alias("d_id"),
                             *[c.alias(n) for c, n in zip(long, ("id", "v1", "v2", "v3"))])

        lines = st.orderline.groupBy("ol_w_id", "ol_d_id", "ol_o_id").agg(
            F.count(F.lit(1)).alias("n"), cents(F.sum("ol_amount")).alias("a"), F.count("ol_delivery_d").alias("sent"))
        c = F.col
        return rows(st.customer, "customer", "c_w_id", c("c_d_id"), c("c_id"), cents(c("c_balance")), c("c_payment_cnt"),
                    c("c_delivery_cnt")) \
            .unionByName(rows(st.district, "district", "d_w_id", c("d_id"), F.lit(0), c("d_next_o_id"), cents(c("d_ytd")), F.lit(0))) \
            .unionByName(rows(st.warehouse, "warehouse", "w_id", F.lit(0), F.lit(0), cents(c("w_ytd")), F.lit(0), F.lit(0))) \
            .unionByName(rows(st.orders, "order", "o_w_id", c("o_d_id"), c("o_id"), c("o_c_id"), c("o_carrier_id"), F.lit(0))) \
            .unionByName(rows(lines, "lines", "ol_w_id", c("ol_d_id"), c("ol_o_id"), c("n"), c("a"), c("sent"))) \
            .unionByName(rows(st.stock_overrides, "stock", "s_w_id", F.lit(0), c("s_i_id"), c("s_quantity"), c("s_ytd"),
                              c("s_order_cnt")))

    def with_faults(old, st):
        """``st`` with faults of every kind that the audit looks for, chosen by ids."""
        delivered = old.orders.where("o_carrier_id is not null")
        gone = delivered.where("o_id % 59 = 0").select("o_w_id", "o_d_id", "o_id")
        orders = st.orders.join(gone, ["o_w_id", "o_d_id", "o_id"], "left_anti") \
            .withColumn("o_carrier_id", F.expr("o_carrier_id + if(o_id % 53 = 0, 1, 0)")) \
            .withColumn("o_entry_d", F.expr("o_entry_d + if(o_id % 71 = 0, interval 1 day, interval 0 day)"))
        on = (F.col("ol_w_id") == F.col("o_w_id")) & (F.col("ol_d_id") == F.col("o_d_id")) & (F.col("ol_o_id") == F.col("o_id"))
        lines = st.orderline.join(gone, on, "left_anti") \
            .withColumn("ol_quantity", F.expr("ol_quantity + if(ol_o_id % 47 = 0 and ol_number = 1, 1, 0)"))
        cust = st.customer.where("c_id % 97 <> 0") \
            .withColumn("c_balance", F.expr("c_balance + if(c_id % 89 = 0, 1, 0)")) \
            .withColumn("c_delivery_cnt", F.expr("c_delivery_cnt + if(c_id % 83 = 0, 1, 0)")) \
            .withColumn("c_payment_cnt", F.expr("c_payment_cnt - if(c_id % 79 = 0, 1000000, 0)"))
        dist = st.district.where("not (d_w_id = 3 and d_id = 1)") \
            .withColumn("d_next_o_id", F.expr("d_next_o_id - if(d_id = 2, 1000000, 0)"))
        wh = st.warehouse.withColumn("w_ytd", F.expr("w_ytd + if(w_id = 2, 1, 0)"))
        return State(warehouse=wh, district_base=st.district_base, district=dist, customer=cust, orders=orders,
                     orderline=lines, item=st.item, sources=st.sources, stock_overrides=st.stock_overrides)

    def audit(spark, sf_dir):
        old, new = chained(spark, sf_dir)
        return C.audit_states(old, with_faults(old, new)).drop("detail")

    def check_fk_orphans(spark, sf_dir):
        """A4 where parents are missing: every seventh customer and every eleventh part."""
        t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
             for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
        t["customer"] = t["customer"].where("c_custkey % 7 <> 0")
        t["part"] = t["part"].where("p_partkey % 11 <> 0")
        return C.check_fk(t)

    QUERIES.update({
        "chain_two_batches": lambda spark, sf_dir: final_rows(chained(spark, sf_dir)[1]),
        "audit_snapshots": audit,
        "check_fk_orphans": check_fk_orphans,
    })


_register_chain()


# --- checks, metrics, log ingest, reports, ledger ----------------------------------------

def _register_misc():
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from depotline.functions.money import cents
    from depotline.operators import checks as C
    from depotline.operators import metrics as M
    from depotline.operators import report as RP
    from depotline.operators import writes as W
    from depotline.plans import as_of as A
    from depotline.plans import replay as P
    from depotline.sources import csv_tables as CSV
    from depotline.session import fit_partitions
    from depotline.sources import txlog as TX
    from depotline.sources.adapter import SOURCE_COLUMNS, read_source
    from depotline.sources.sinks import WRITE_LOCK, _exists, scratch_table, snapshot_key, table_bytes, work_path, work_table

    def sources(spark, sf_dir):
        fit_partitions(spark, table_bytes(spark, sf_dir, *SOURCE_COLUMNS))
        return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
                for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}

    def meas(spark, sf_dir):
        return M.measurements(read_source(spark, sf_dir, "events"))

    def log_files(rp, skip=()):
        """The derived log, all eight letters, written as text files and read back:
        (records, order lines, orphans)."""
        path = work_path(rp.spark, rp.key, "log_text")
        lg = rp.log
        with WRITE_LOCK:
            if not _exists(rp.spark, path):
                TX.write_log(TX.render_log(lg.n_hdr, lg.n_lines, lg.pay, lg.dlv, lg.status, lg.reads), path)
        return TX.parse_rows(TX.read_lines(rp.spark, path), skip=skip,
                             store=lambda name, df: work_table(rp.spark, rp.key, name, lambda: df))

    def log_records(rp):
        """Every record read from the files, with its place in the whole log and sums of its lines."""
        records, lines, _ = log_files(rp)
        sizes = records.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
        # one row for each file
        files = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).drop("_n")
        sums = lines.groupBy("file", "record_no").agg(
            F.sum(F.col("ol_number") * (F.col("i_id") * 100 + F.col("qty"))).alias("line_sum"),
            F.sum(F.col("ol_number") * F.col("supply_w_id")).alias("supply_sum"))
        return records.join(files, "file").join(sums, ["file", "record_no"], "left").select(
            (F.col("_before") + F.col("record_no")).alias("seq"), "txn_type", "w_id", "d_id", "c_id", "carrier_id", "threshold",
            "last_l", cents(F.col("amount")).alias("amount_cents"), "n_lines", "line_sum", "supply_sum", "reason")

    def txlog_counts(rp):
        records, lines, orphan = log_files(rp, skip=("S", "I", "T", "R"))
        kind = F.when(F.col("reason").isNull(), F.col("txn_type")).otherwise(F.lit("error"))
        ok = records.groupBy(kind.alias("txn_type")).agg(F.count(F.lit(1)).alias("n_records"))
        n = lines.select(F.count(F.lit(1))).scalar()
        ok = ok.withColumn("n_lines", F.when(F.col("txn_type") == "N", n).otherwise(0).cast("long"))
        bad = orphan.groupBy().agg(F.count(F.lit(1)).alias("n_records")).where(F.col("n_records") > 0) \
                    .select(F.lit("orphan").alias("txn_type"), "n_records", F.lit(0).cast("long").alias("n_lines"))
        return ok.unionByName(bad)

    def check_invariants(rp):
        return C.check_invariants(rp.state.district, rp.order_ids, rp.delivery, rp.lines,
                                  P.replay_ytd(rp), rp.state.warehouse)

    def ledger(spark, sf_dir):
        cust = read_source(spark, sf_dir, "customer")
        n = cust.select(F.count(F.lit(1))).scalar()
        acc = cust.select(F.col("c_custkey").alias("acct"),
                          cents(F.col("c_acctbal").cast("decimal(12,2)")).alias("balance"))
        ev = read_source(spark, sf_dir, "events")
        tr = ev.select(F.pmod(F.col("user_id"), n).alias("from_acct"),
                       F.pmod(F.col("event_id"), n).alias("to_acct"),
                       cents(F.col("value").cast("decimal(12,2)")).alias("amount"))
        out = W.ledger_post(acc, tr)
        return out.select("acct", F.col("balance").alias("balance_cents"),
                          F.col("n_postings").cast("long").alias("n_postings"))

    def measure_log(spark, sf_dir):
        """(clients, types) of the measure log that the events' summaries are written to."""
        path = work_path(spark, snapshot_key(spark, sf_dir, "measure"), "measure_log")
        with WRITE_LOCK:
            if not _exists(spark, path):
                m = meas(spark, sf_dir)
                M.write_measure_log(M.render_measure_log(M.latency_summary(m), M.latency_by_type(m)), path)
        return [df.where("run = 1").drop("run") for df in M.read_measure_log(spark, path)]

    def asked(rp, kind, *cols):
        """The log's read records of one kind with the district's next order id."""
        return A.next_order_as_of(rp.state, rp.order_ids, rp.log.asked(kind, "w_id", "d_id", *cols))

    def report_stock_level(rp):
        after, req = A.after_orders(rp), asked(rp, "S", "threshold", "last_l")
        q = A.stock_as_of(rp.state, rp.lines, reads.recent_items(after, req))
        return RP.render_stock_level(reads.stock_level(after, req, q))

    def report_popular_items(rp):
        after, req = A.after_orders(rp), asked(rp, "I", "last_l")
        return RP.render_popular_items(req, reads.popular_items(after, req), reads.popular_item_pct_by_name(after, req))

    def report_top_balance(rp):
        places = rp.log.asked("T")
        top = A.top_balance_as_of(rp, places.withColumnRenamed("req_id", "ord"), P.balance_ledger(rp), rq.TOP_K)
        return RP.render_top_balance(places, top)

    def report_related(rp):
        req = rp.log.asked("R", "w_id", "d_id", "c_id")
        # the report reads its rows several times
        return RP.render_related(req, scratch_table(rp.spark, "related", A.related_as_of(rp, req)))

    def csv_tables(spark, sf_dir):
        """Tables written as scaled text files, two kinds of bad lines among them, loaded and decoded."""
        st = load_state(spark, sf_dir, "all")
        root = work_path(spark, snapshot_key(spark, sf_dir, "csv"), "files")
        parts = []
        for name, key, money, rate in (("district", ["d_w_id", "d_id"], "d_ytd", "d_tax"),
                                       ("customer", ["c_w_id", "c_d_id", "c_id"], "c_balance", "c_discount"),
                                       ("item", ["i_id"], "i_price", None)):
            path = f"{root}/{name}"
            with WRITE_LOCK:
                if not _exists(spark, path):
                    df = getattr(st, name)
                    lines = CSV.csv_lines(df, name)
                    for i, spoil in ((7, F.concat(F.lit("x"), "value")), (5, F.concat("value", F.lit(",0")))):
                        lines = lines.unionByName(CSV.csv_lines(df.where(F.col(key[-1]) % i == 0), name).select(spoil.alias("value")))
                    lines.write.mode("overwrite").text(path)
            rows = CSV.from_scaled(CSV.read_rows(spark, path, name), name)
            good = F.col("bad_text").isNull()
            bp = (F.col(rate) * 10000).cast("long") if rate else F.lit(None).cast("long")
            parts.append(rows.select(
                F.lit(name).alias("tbl"), F.when(good, F.concat_ws(",", *key)).alias("key"),
                F.when(good, cents(F.col(money))).alias("money_cents"), F.when(good, bp).alias("rate_bp"), F.col("bad_text").alias("text")))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    QUERIES.update({
        "report_deliveries": _replay_q(lambda rp: RP.render_deliveries(rp.log.dlv)),
        "report_order_status": _replay_q(lambda rp: RP.render_order_status(A.order_status_as_of(rp, P.replay_reads(rp)))),
        "report_stock_level": _replay_q(report_stock_level),
        "report_popular_items": _replay_q(report_popular_items),
        "report_top_balance": _replay_q(report_top_balance),
        "report_related": _replay_q(report_related),
        "csv_tables": csv_tables,
        "check_pk": lambda spark, sf_dir: C.check_pk(sources(spark, sf_dir)),
        "check_fk": lambda spark, sf_dir: C.check_fk(sources(spark, sf_dir)),
        "check_invariants": _replay_q(check_invariants),
        "latency_summary": lambda spark, sf_dir: M.latency_summary(meas(spark, sf_dir)),
        "latency_by_type": lambda spark, sf_dir: M.latency_by_type(meas(spark, sf_dir)),
        "throughput_fleet": lambda spark, sf_dir: M.throughput_fleet(meas(spark, sf_dir)),
        "measure_log": lambda spark, sf_dir: measure_log(spark, sf_dir)[0],
        "measure_log_types": lambda spark, sf_dir: measure_log(spark, sf_dir)[1],
        "log_records": _replay_q(log_records),
        "txlog_counts": _replay_q(txlog_counts),
        "report_lines": _replay_q(lambda rp: RP.render_payment_receipts(
            W.payment_receipts(rp.state, rp.log.pay))),
        "ledger_post": ledger,
        "new_order_report": _replay_q(lambda rp: RP.render_new_orders(
            rp.totals(), rp.lines.withColumn("amount_cents", cents(F.col("amount"))))),
    })


_register_misc()
