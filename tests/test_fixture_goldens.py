"""Golden values computed by hand on the small wholesale fixture."""

import pytest
from pyspark.sql import functions as F

from depotline.operators import checks, derived, reads, writes
from tests.fixture_data import fixture_state


@pytest.fixture(scope="module")
def fx(spark, tmp_path_factory):
    st, tables = fixture_state(spark, str(tmp_path_factory.mktemp("fixture")))
    return spark, st, tables


def _req(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pending_and_oldest(fx):
    spark, st, _ = fx
    assert reads.pending_orders(st).count() == 19
    got = {(r.o_d_id, r.o_id) for r in reads.oldest_pending(st).collect()}
    assert got == {(d, 2 if d == 3 else 1) for d in range(1, 11)}


def test_order_status(fx):
    spark, st, _ = fx
    req = _req(spark, [(1, 1, 1, 1)], "req_id long, w_id int, d_id int, c_id long")
    rows = reads.order_status(st, req).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.c_first, r.c_middle, r.c_last, r.c_balance_cents) == ("John", "A", "Last", 2000)
    assert (r.o_id, r.o_carrier_id) == (10, None)
    assert (r.ol_i_id, r.ol_supply_w_id, r.ol_quantity, r.ol_amount_cents, r.ol_delivery_d) == (2, 1, 1, 30000, None)


@pytest.mark.parametrize("threshold,expected", [(60, 2), (20, 0)])
def test_stock_level(fx, threshold, expected):
    spark, st, _ = fx
    req = _req(spark, [(1, 1, 1, threshold, 2)], "req_id long, w_id int, d_id int, threshold int, last_l int")
    assert reads.stock_level(st, req).collect()[0].items_below == expected


def test_popular_items_and_share(fx):
    spark, st, _ = fx
    req = _req(spark, [(1, 1, 1, 2)], "req_id long, w_id int, d_id int, last_l int")
    got = {(r.o_id, r.i_id, r.max_qty) for r in reads.popular_items(st, req).collect()}
    assert got == {(9, 1, 1), (10, 2, 1)}
    pct = {(r.i_id, r.pct) for r in reads.popular_item_pct(st, req).collect()}
    assert pct == {(1, 0.5), (2, 0.5)}


def test_order_summary(fx):
    spark, st, _ = fx
    s = derived.order_summary(st).where("o_w_id = 1 AND o_d_id = 1 AND o_id = 1").collect()[0]
    assert (s.max_quantity, s.item_ids, s.total_amount_cents) == (1, "2,1", 50000)


def test_top_balance(fx):
    spark, st, _ = fx
    rows = reads.top_balance(st, 10).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.c_first, r.c_middle, r.c_last, r.c_balance_cents, r.w_name, r.d_name) == \
        ("John", "A", "Last", 2000, "ware1", "district1")


def test_related_customers_single_warehouse(fx):
    spark, st, _ = fx
    req = _req(spark, [(1, 1, 1, 1)], "req_id long, w_id int, d_id int, c_id long")
    assert reads.related_customers(st, req).count() == 0


def test_new_order(fx):
    spark, st, _ = fx
    n_hdr = _req(spark, [(0, 1, 1, 1)], "ord long, w_id int, d_id int, c_id long")
    n_lines = _req(spark, [(0, k, k, 1, 5) for k in range(1, 5)],
                   "ord long, ol_number int, i_id long, supply_w_id int, qty int")
    lines = writes.new_order_lines(st, n_hdr, n_lines)
    got = sorted((r.i_id, r.o_id, int(r.amount * 100), r.s_quantity_after) for r in lines.collect())
    assert got == [(1, 11, 100000, 15), (2, 11, 150000, 15), (3, 11, 200000, 105), (4, 11, 250000, 100)]
    t = writes.new_order_totals(st, n_hdr, lines).collect()[0]
    assert (t.o_id, t.all_local, t.n_items, t.total_cents) == (11, 1, 4, 772863)


def test_payment(fx):
    spark, st, _ = fx
    pay = _req(spark, [(0, 1, 1, 1)], "ord long, w_id int, d_id int, c_id long") \
        .withColumn("amount", F.lit("50000.00").cast("decimal(12,2)"))
    e = writes.payment_effects(st, pay).collect()[0]
    assert (e.c_balance_cents, e.c_ytd_payment_cents, e.c_payment_cnt) == (-4998000, 4999000, 11)
    y = {r.d_id: (r.d_ytd_cents, r.w_ytd_cents) for r in writes.district_ytd(st, pay).collect()}
    assert y[1] == (5000000, 5050000)
    assert y[2] == (0, 5050000)


def test_delivery(fx):
    spark, st, _ = fx
    dlv = _req(spark, [(0, 1, 1)], "ord long, w_id int, carrier_id int")
    out = writes.deliver(st, dlv)
    got = {r.d_id: (r.o_id, r.amount_cents) for r in out.collect()}
    assert got == {d: ((2, 0) if d == 3 else (1, 50000 if d == 1 else 20000)) for d in range(1, 11)}
    eff = writes.delivery_customer_effects(st, out).collect()
    assert [(r.c_id, r.c_balance_cents, r.c_delivery_cnt) for r in eff] == [(1, 52000, 2)]
    assert writes.missing_customers(st, out).count() == 9


def test_fk_orders_customer(fx):
    spark, st, t = fx
    v = checks.fk_violations(t["orders"], ["o_w_id", "o_d_id", "o_c_id"], t["customer"],
                             ["c_w_id", "c_d_id", "c_id"], "orders->customer")
    assert v.count() == 9


def test_pk_holds(fx):
    spark, st, t = fx
    assert checks.pk_violations(t["orderline"], ["ol_w_id", "ol_d_id", "ol_o_id", "ol_number"], "ol").count() == 0


def test_invariants_hold_after_a_batch(fx):
    """W5 on the fixture: warehouse YTD 500.00 against districts at 0 is a
    pre-existing difference; the audit compares the changes of the batch."""
    spark, st, _ = fx
    from depotline.plans.replay import Log, Replay
    n_hdr = _req(spark, [(0, 1, 1, 1)], "ord long, w_id int, d_id int, c_id long")
    n_lines = _req(spark, [(0, k, k, 1, 5) for k in range(1, 5)],
                   "ord long, ol_number int, i_id long, supply_w_id int, qty int")
    pay = _req(spark, [(1, 1, 1, 1)], "ord long, w_id int, d_id int, c_id long") \
        .withColumn("amount", F.lit("12.50").cast("decimal(12,2)"))
    dlv = _req(spark, [(3, 1, 1)], "ord long, w_id int, carrier_id int")
    status = _req(spark, [], "ord long, w_id int, d_id int, c_id long")
    rp = Replay(spark, st, Log(n_hdr, n_lines, pay, dlv, status), None)
    bad = checks.check_invariants(st.district, rp.order_ids, rp.delivery, rp.lines,
                                  writes.district_ytd(st, pay), st.warehouse)
    assert bad.count() == 0
