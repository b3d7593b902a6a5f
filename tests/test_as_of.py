"""Reads as of their place in a log, against step-by-step simulations."""

import os
import random
import re
from dataclasses import replace
from types import SimpleNamespace

import pytest

from depotline.operators import reads
from depotline.plans import as_of
from depotline.plans.client_run import run_log
from tests.fixture_data import fixture_state


@pytest.mark.parametrize("seed,n_places", [(1, 1), (2, 7), (3, 40)])
def test_top_balance_equals_a_step_simulation(spark, tmpdir_path, seed, n_places):
    r = random.Random(seed)
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    customers = [(1, 1 + c % 3, c, "a", "b", f"c{c}", r.choice([None, 0, 100, r.randrange(-500, 500)])) for c in range(40)]
    frame = spark.createDataFrame(customers, "c_w_id int, c_d_id int, c_id long, c_first string, c_middle string, c_last string, cents int")
    rp = SimpleNamespace(state=replace(st, customer=frame.selectExpr("*", "cast(cents / 100 as decimal(14,2)) as c_balance")))
    ords = r.sample(range(1000), 200 + n_places)
    places, moves = sorted(ords[:n_places]), []
    for o in sorted(ords[n_places:]):
        c = customers[0 if r.random() < 0.4 else r.randrange(25)]  # a hot customer; 15 are never touched
        moves.append((o, c[0], c[1], c[2], r.randrange(-300, 300)))
    ledger = spark.createDataFrame(moves, "ord long, w_id int, d_id int, c_id long, delta long")
    asked = spark.createDataFrame([(p,) for p in places], "ord long")
    got = {}
    for x in as_of.top_balance_as_of(rp, asked, ledger, 5).orderBy("req_id", "rank").collect():
        got.setdefault(x.req_id, []).append((x.c_id, x.c_balance_cents))
    for p in places:
        bal = {c[2]: c[6] for c in customers}
        for o, _, _, c, d in moves:
            if o < p and bal[c] is not None:
                bal[c] += d
        want = sorted(customers, key=lambda c: (bal[c[2]] is None, -(bal[c[2]] or 0), c[0], c[1], c[2]))[:5]
        assert got[p] == [(c[2], bal[c[2]]) for c in want]


def test_no_task_answers_all_places(spark, tmpdir_path, monkeypatch):
    """A node above many places is repeated by runs of places: the answers stay the same,
    and the plan neither looks at a node alone nor lets versions pile up before they are cut."""
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    customers = [(1, 1, c, "a", "b", f"c{c}", 100 * c) for c in range(12)]
    frame = spark.createDataFrame(customers, "c_w_id int, c_d_id int, c_id long, c_first string, c_middle string, c_last string, cents int")
    rp = SimpleNamespace(state=replace(st, customer=frame.selectExpr("*", "cast(cents / 100 as decimal(14,2)) as c_balance")))
    ledger = spark.createDataFrame([(3 * o, 1, 1, o % 5, 7 * o - 300) for o in range(90)], "ord long, w_id int, d_id int, c_id long, delta long")
    asked = spark.range(1, 270, 2).withColumnRenamed("id", "ord")
    whole = sorted(map(tuple, as_of.top_balance_as_of(rp, asked, ledger, 3).collect()))
    monkeypatch.setattr(as_of, "CHUNK_BITS", 2)
    df = as_of.top_balance_as_of(rp, asked, ledger, 3)
    assert sorted(map(tuple, df.collect())) == whole
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(\(\(level#\d+ = level#\d+\) AND \(node#\d+L? = node#\d+L?\)\) AND \(run#\d+L? = run#\d+L?\)", plan)
    assert re.search(r"RepartitionByExpression \[[^\]]*\ba#\d+L?\], 8", plan)


def test_reads_between_writes(spark, tmpdir_path):
    """Each read of the file sees what came before it and nothing else."""
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    logs = os.path.join(tmpdir_path, "logs")
    os.makedirs(logs)
    with open(os.path.join(logs, "0.txt"), "w") as f:
        f.write("\n".join(["O,1,1,1", "T", "P,1,1,1,10.00", "O,1,1,1", "T", "N,1,1,1,1", "3,1,2", "O,1,1,1",
                           *["D,1,7"] * 11, "O,1,1,1", "T"]))
    out = run_log(spark, st, logs, as_of_ts="2024-05-06 07:08:09", key=os.path.basename(tmpdir_path))
    status = out["order_status"].orderBy("req_id", "ol_number").collect()
    assert [(r.o_id, r.ol_i_id, r.o_carrier_id) for r in status] == [(10, 2, None), (10, 2, None), (11, 3, None), (11, 3, 7)]
    assert [r.o_entry_d for r in status] == ["2022-08-02 17:16:05.211"] * 2 + ["2024-05-06 07:08:09.000"] * 2
    assert [r.ol_delivery_d for r in status] == [None, None, None, "2024-05-06 07:08:09.000"]
    # 11 orders of district 1 delivered: 500.00, 8 x 200.00, 300.00 and the new one of 2 x 400.00
    after = 2000 - 1000 + 50000 + 8 * 20000 + 30000 + 80000
    assert [r.c_balance_cents for r in status] == [2000, 1000, 1000, after]
    assert [r.c_balance_cents for r in out["top_balance"].orderBy("req_id").collect()] == [2000, 1000, after]


def test_related_needs_both_orders_before_the_read(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    pairs = spark.createDataFrame([(1, 1, 1, 5, 6, 10), (2, 1, 9, 5, 6, 20), (2, 1, 8, 5, 6, -1), (1, 2, 7, 5, 6, -1)],
                                  "w_id int, d_id int, c_id long, i1 long, i2 long, since long")
    req = spark.createDataFrame([(o, 1, 1, 1) for o in (5, 10, 15, 25)], "req_id long, w_id int, d_id int, c_id long")
    got = sorted((r.req_id, r.c_id) for r in as_of.related_as_of(SimpleNamespace(state=st), req, pairs).collect())
    assert got == [(15, 8), (25, 8), (25, 9)]


def test_recent_reads_join_on_the_whole_key(spark):
    """No range is left in any join of the recent-order reads."""
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL
    for name in ("stock_level", "popular_items", "popular_item_pct", "replay_stock_level", "replay_popular_items"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().toString()
        assert "o_lo" not in plan and "o_hi" not in plan and "NestedLoop" not in plan


def test_requests_beyond_the_first_order(spark, tmpdir_path):
    st, _ = fixture_state(spark, os.path.join(tmpdir_path, "fx"))
    req = spark.createDataFrame([(1, 1, 1, 60, 1000), (2, 1, 1, 60, 0), (3, 9, 9, 60, 5), (4, 1, 2, 60, 1)],
                                "req_id long, w_id int, d_id int, threshold int, last_l int")
    got = {(r.req_id, r.o_id) for r in reads.recent_keys(st, req).collect()}
    assert got == {(1, o) for o in range(1, 11)} | {(4, 1)}
    assert {r.req_id: r.items_below for r in reads.stock_level(st, req).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}
