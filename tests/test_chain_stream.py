"""P7: cutting the log into batches does not change the final state.
T1: the streaming replay of log files equals the chained batch replay."""

import os

from pyspark.sql import functions as F

from depotline.operators.checks import audit_states
from depotline.plans.chain import apply_batch, newest_rows, read_chain, read_snapshot, run_chain, split_log, write_delta, write_snapshot
from depotline.plans.replay import derived_log
from depotline.sources.adapter import load_state
from depotline.streaming.stream_replay import stream_replay
from tests.conftest import SF_SMALL


def _final(st):
    cust = {(r.c_w_id, r.c_d_id, r.c_id): (r.c_balance, r.c_payment_cnt, r.c_delivery_cnt)
            for r in st.customer.collect()}
    dist = {(r.d_w_id, r.d_id): (r.d_next_o_id, r.d_ytd) for r in st.district.collect()}
    stock = {(r.s_w_id, r.s_i_id): (r.s_quantity, int(r.s_ytd), r.s_order_cnt)
             for r in st.stock_overrides.collect()}
    delivered = st.orders.where(F.col("o_carrier_id").isNotNull()).count()
    return cust, dist, stock, delivered


def test_chain_equals_one_batch(spark, tmpdir_path):
    base = load_state(spark, SF_SMALL, "base")
    log = derived_log(spark, SF_SMALL, base)
    tag = os.path.basename(tmpdir_path)
    one, _ = apply_batch(spark, base, log, key=f"{tag}-one")
    write_snapshot(one, f"{tmpdir_path}/one")
    one = read_snapshot(spark, f"{tmpdir_path}/one", base)

    lo, hi = split_log(log, 1500)
    s1, _ = apply_batch(spark, base, lo, key=f"{tag}-b1")
    write_snapshot(s1, f"{tmpdir_path}/b1")
    s1 = read_snapshot(spark, f"{tmpdir_path}/b1", base)
    s2, _ = apply_batch(spark, s1, hi, key=f"{tag}-b2")
    write_snapshot(s2, f"{tmpdir_path}/b2")
    s2 = read_snapshot(spark, f"{tmpdir_path}/b2", base)
    assert _final(one) == _final(s2)
    # the same by deltas; a right run passes the audit of its two snapshots
    chained = run_chain(spark, base, [lo, hi], f"{tmpdir_path}/chain", f"{tag}-chain")
    assert _final(one) == _final(chained)
    assert audit_states(base, one).collect() == []


def test_delta_follows_the_batch(spark, tmpdir_path):
    """A batch of a few records writes a few rows, however large the state; of two
    deltas the newer row of a key counts, and a snapshot cuts the chain."""
    base = load_state(spark, SF_SMALL, "base")
    log = derived_log(spark, SF_SMALL, base)
    tag = os.path.basename(tmpdir_path)
    first = [r.ord for r in log.pay.orderBy("ord").limit(3).collect()]
    few = log.each(lambda _, df: df.where(F.col("ord").isin(first)))
    state = base
    for v in (0, 1):
        state, rp = apply_batch(spark, state, few, key=f"{tag}-{v}")
        write_delta(rp.changes, f"{tmpdir_path}/v={v}")
        sizes = {n: spark.read.parquet(f"{tmpdir_path}/v={v}/delta/{n}").count() for n in rp.changes}
        assert 1 <= sizes["customer"] <= 3 and sizes["orders"] == sizes["orderline"] == sizes["stock_overrides"] == 0
        state = read_chain(spark, tmpdir_path, v, base)
    paid = few.pay.groupBy("c_id").agg(F.count("*").alias("n")).collect()
    now = {r.c_id: r.c_payment_cnt for r in newest_rows(spark, tmpdir_path, [1, 0], "customer").collect()}
    assert now == {r.c_id: 2 * r.n for r in paid}
    assert state.customer.count() == base.customer.count()
    write_snapshot(state, f"{tmpdir_path}/v=1")
    cut = read_chain(spark, tmpdir_path, 5, base)  # versions 2 to 5 never ran
    assert cut.customer.where("c_payment_cnt > 0").count() == len(paid)
    assert "delta" not in " ".join(cut.customer.inputFiles())


def test_stream_replay_small_log(spark, tmpdir_path):
    base = load_state(spark, SF_SMALL, "base")
    cust = base.customer.where("c_w_id = 1 AND c_d_id = 1").orderBy("c_id").first()
    cid = cust.c_id
    land = os.path.join(tmpdir_path, "landing")
    os.makedirs(land)
    # two time slices, one file each
    with open(os.path.join(land, "a.txt"), "w") as f:
        f.write(f"N,{cid},1,1,2\n5,1,3\n7,2,4\nP,1,1,{cid},10.50\nD,1,3\n"
                f"O,1,1,{cid}\nS,1,1,60,5\nI,1,1,5\nT\nR,1,1,{cid}")
    q = stream_replay(spark, land, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", base)
    q.awaitTermination(120)
    with open(os.path.join(land, "b.txt"), "w") as f:
        f.write(f"P,1,1,{cid},4.50\nD,1,4")
    q = stream_replay(spark, land, f"{tmpdir_path}/out", f"{tmpdir_path}/ckpt", base)
    q.awaitTermination(120)
    out = f"{tmpdir_path}/out"
    oids = spark.read.parquet(f"{out}/results/batch=0/order_ids").collect()
    assert len(oids) == 1
    d1 = spark.read.parquet(f"{out}/results/batch=1/delivery")
    assert d1.count() == base.district_base.where("d_w_id = 1").count()
    # the reads of the first file are answered in its batch, as of their place
    res = f"{out}/results/batch=0"
    status = spark.read.parquet(f"{res}/order_status").collect()
    assert {r.o_id for r in status} == {oids[0].o_id} and len(status) == 2
    assert spark.read.parquet(f"{res}/top_balance").count() == 10
    assert spark.read.parquet(f"{res}/stock_level").count() == 1
    assert spark.read.parquet(f"{res}/popular_items").where(f"o_id = {oids[0].o_id}").count() >= 1
    assert spark.read.parquet(f"{out}/results/batch=1/top_balance").count() == 0
    assert not os.path.exists(f"{out}/state/v=1/full")
    s1 = read_chain(spark, f"{out}/state", 1, base)
    c = s1.customer.where(f"c_id = {cid}").collect()[0]
    c0 = cust
    assert c.c_payment_cnt == c0.c_payment_cnt + 2
    # every delivered amount and payment lands in the balance
    paid = 15
    dl = spark.read.parquet(f"{out}/results/batch=0/delivery").unionByName(d1) \
        .where(f"o_id IS NOT NULL AND c_id = {cid} AND w_id = 1 AND d_id = 1")
    got = sum(r.amount_cents for r in dl.collect()) / 100
    assert float(c.c_balance) == float(c0.c_balance) - paid + got
