"""End-to-end run of a client file with all record types on the fixture."""

import os

from depotline.plans.client_run import run_log
from tests.fixture_data import fixture_state


def test_run_log_fixture(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    logs = os.path.join(tmpdir_path, "logs")
    os.makedirs(logs)
    with open(os.path.join(logs, "0.txt"), "w") as f:
        f.write("\n".join([
            "N,1,1,1,4", "1,1,5", "2,1,5", "3,1,5", "4,1,5",
            "P,1,1,1,50000.00",
            "O,1,1,1",
            "S,1,1,60,2",
            "I,1,1,2",
            "T",
            "R,1,1,1",
            "D,1,1",
            "Q,1",
        ]))
    out = run_log(spark, st, logs, key=os.path.basename(tmpdir_path))
    assert [r.reason for r in out["errors"].collect()] == ["unknown record type"]
    t = out["new_order_totals"].collect()[0]
    assert (t.o_id, t.total_cents) == (11, 772863)
    o = out["order_status"].orderBy("ol_number").collect()
    # as of its position: the new order 11 exists, the payment is applied
    assert {(r.o_id, r.c_balance_cents, r.c_last, r.o_carrier_id) for r in o} == {(11, 2000 - 5000000, "Last", None)}
    assert [(r.ol_i_id, r.ol_quantity, r.ol_delivery_d) for r in o] == [(i, 5, None) for i in (1, 2, 3, 4)]
    assert out["stock_level"].collect()[0].items_below == 2
    # the order placed at the head of the file is one of the last two
    assert {(r.o_id, r.i_id) for r in out["popular_items"].collect()} == {(10, 2)} | {(11, i) for i in (1, 2, 3, 4)}
    # the payment before the T record counts, the delivery after it doesn't
    assert [(r.rank, r.c_id, r.c_balance_cents, r.w_name) for r in out["top_balance"].collect()] == [(1, 1, 2000 - 5000000, "ware1")]
    assert out["related_customers"].count() == 0
    d = {r.d_id: r.o_id for r in out["deliveries"].collect()}
    assert d[1] == 1 and d[3] == 2
    c = out["state"].customer.collect()[0]
    # 20.00 - 50000.00 + 500.00 delivered (order 1 of district 1)
    assert int(c.c_balance * 100) == 2000 - 5000000 + 50000
