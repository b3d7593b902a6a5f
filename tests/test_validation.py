"""Requests that reference missing rows are reported and change nothing."""

import os

from pyspark.sql import functions as F

from depotline.operators import reads
from depotline.plans.client_run import run_log
from depotline.sources.txlog import parse_txlog, render_log
from tests.fixture_data import fixture_state


def _run(spark, folder, state, text, key=None):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "0.txt"), "w") as f:
        f.write(text)
    return run_log(spark, state, folder, key=key)


def test_missing_rows_are_reported_and_change_nothing(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    log = "\n".join(["N,1,1,1,2", "1,1,5", "99,1,5", "N,77,1,1,1", "1,1,5", "N,1,1,1,1", "1,8,5", "P,1,1,77,100.00",
                     "P,9,9,1,100.00", "D,4,1", "O,1,1,55", "P,1,1,1,10.00"])
    out = _run(spark, os.path.join(tmpdir_path, "logs"), st, log, key="bad")
    got = sorted((r.record_no, r.reason, r.text) for r in out["errors"].collect())
    assert got == [(1, "unknown item", "N"), (2, "unknown customer", "N"), (3, "unknown stock", "N"),
                   (4, "unknown customer", "P"), (5, "unknown customer", "P"), (6, "unknown warehouse", "D"),
                   (7, "unknown customer", "O")]
    nxt = out["state"]
    assert out["new_order_totals"].count() == 0 and out["deliveries"].count() == 0
    assert nxt.orders.count() == st.orders.count() and nxt.orderline.count() == st.orderline.count()
    assert [r.d_next_o_id for r in nxt.district.where("d_id = 1").collect()] == [11]
    # only the valid payment moved money
    before, after = (x.warehouse.agg(F.sum("w_ytd")).first()[0] for x in (st, nxt))
    assert float(after - before) == 10.0
    assert float(sum(r.d_ytd for r in nxt.district.collect()) - sum(r.d_ytd for r in st.district.collect())) == 10.0


def test_two_logs_under_one_key(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    for n, amount in enumerate(("10.00", "20.00")):
        out = _run(spark, os.path.join(tmpdir_path, f"l{n}"), st, f"P,1,1,1,{amount}", key="same")
        assert [str(r.amount) for r in out["payments"].collect()] == [amount]


def test_new_order_fields_and_reads_after_writes(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    out = _run(spark, os.path.join(tmpdir_path, "logs"), st, "\n".join(
        ["S,1,1,60,1", "N,1,1,1,2", "1,1,5", "2,1,9", "S,1,1,16,1", "N,1,1,1,1", "2,1,1", "I,1,1,1", "S,1,1,16,2"]), key="fields")
    new = {r.o_id: (r.o_ol_cnt, r.o_all_local) for r in out["state"].orders.where("o_id > 10").collect()}
    assert new == {11: (2, 1), 12: (1, 1)}
    levels = [r.items_below for r in out["stock_level"].orderBy("req_id").collect()]
    # order 10: item 2 at 20; then order 11 leaves items 1, 2 at 15, 11; then order 12 leaves item 2 at 10
    assert levels == [1, 2, 2]
    assert [(r.o_id, r.i_id) for r in out["popular_items"].collect()] == [(12, 2)]


def test_order_of_many_lines_round_trips(spark):
    hdr = spark.createDataFrame([(7, 1, 1, 1), (9, 1, 1, 1)], "ord long, w_id int, d_id int, c_id long")
    lines = spark.createDataFrame([(7, n, n, 1, 1) for n in range(1, 1501)] + [(9, 1, 5, 1, 2)],
                                  "ord long, ol_number int, i_id long, supply_w_id int, qty int")
    none = hdr.where("false")
    text = render_log(hdr, lines, none.withColumn("amount", F.lit("1")), none.withColumn("carrier_id", F.lit(1)), none)
    records, errors = parse_txlog(text, "pos", ("line_no",))
    assert errors.count() == 0
    got = [r.lines for r in records.orderBy("record_no").collect()]
    assert [len(x) for x in got] == [1500, 1] and [x.i_id for x in got[0]] == list(range(1, 1501))


def test_lower_case_record_does_not_spoil_the_one_before(spark):
    df = spark.createDataFrame([("f", 0, 0, "P,1,1,1,5.00"), ("f", 0, 1, "x,1,2"), ("f", 0, 2, "T")],
                               "file string, block long, pos long, value string")
    records, errors = parse_txlog(df)
    assert [r.txn_type for r in records.orderBy("record_no").collect()] == ["P", "T"]
    assert [r.reason for r in errors.collect()] == ["unknown record type"]


def test_duplicate_lines_of_the_requested_order_do_not_count(spark, tmpdir_path):
    """Only lines of the other order are counted."""
    from dataclasses import replace
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    orders = spark.createDataFrame([(1, 1, 1, 1), (2, 1, 1, 5), (3, 1, 1, 6)],
                                   "o_w_id int, o_d_id int, o_id long, o_c_id long")
    lines = spark.createDataFrame([(1, 1, 1, 1, 7), (1, 1, 1, 2, 7), (2, 1, 1, 1, 7), (3, 1, 1, 1, 7), (3, 1, 1, 2, 7)],
                                  "ol_w_id int, ol_d_id int, ol_o_id long, ol_number int, ol_i_id long")
    req = spark.createDataFrame([(1, 1, 1, 1)], "req_id long, w_id int, d_id int, c_id long")
    got = reads.related_customers_by_lines(replace(st, orders=orders, orderline=lines, key=None), req).collect()
    assert [(r.w_id, r.c_id) for r in got] == [(3, 6)]


def test_reads_of_missing_rows_and_impossible_amounts(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    log = "\n".join(["S,9,9,60,2", "I,9,9,2", "R,9,9,9", "N,1,1,1,2", "1,1,11", "1,1,-11", "P,1,1,1,-5.00", "P,1,1,1,0.00", "T"])
    out = _run(spark, os.path.join(tmpdir_path, "logs"), st, log, key="reads")
    got = sorted((r.record_no, r.reason, r.text) for r in out["errors"].collect())
    assert got == [(1, "unknown district", "S"), (2, "unknown district", "I"), (3, "unknown customer", "R"),
                   (4, "quantity below 1", "N"), (5, "amount not above 0", "P"), (6, "amount not above 0", "P")]
    assert all(out[k].count() == 0 for k in ("stock_level", "popular_items", "related_customers", "payments", "new_order_lines"))
    assert out["top_balance"].count() == 1


def test_draws_outside_the_closed_form_take_the_step_rule(spark, tmpdir_path):
    from depotline.operators import writes
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    hdr = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 1, 1)], "ord long, w_id int, d_id int, c_id long")
    lines = spark.createDataFrame([(0, 1, 1, 1, 11), (1, 1, 1, 1, -11)], "ord long, ol_number int, i_id long, supply_w_id int, qty int")
    got = writes.new_order_lines(st, hdr, lines).orderBy("ord").collect()
    assert [(r.s_quantity_before, r.s_quantity_after) for r in got] == [(20, 109), (109, 120)]
    assert [r.s_quantity for r in writes.stock_after(st, hdr, lines).collect()] == [120]
