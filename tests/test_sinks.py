"""A5 state layout and A7 result sink round trips."""

from pyspark.sql import functions as F

from depotline.sources.adapter import load_state
from depotline.sources.sinks import BUCKET_BYTES, bucket_count, write_results, write_state
from tests.conftest import SF_SMALL


def test_write_state_round_trip(spark, tmpdir_path):
    st = load_state(spark, SF_SMALL, "all")
    write_state(st, f"{tmpdir_path}/state", ["orders", "district"])
    o = spark.read.parquet(f"{tmpdir_path}/state/orders")
    assert o.count() == st.orders.count()
    assert o.exceptAll(st.orders).count() == 0
    # range-partitioned and sorted: every file holds a contiguous key range
    files = o.select(F.input_file_name().alias("f"), "o_w_id", "o_d_id", "o_id") \
        .groupBy("f").agg(F.min(F.struct("o_w_id", "o_d_id", "o_id")).alias("lo"),
                          F.max(F.struct("o_w_id", "o_d_id", "o_id")).alias("hi")).orderBy("lo").collect()
    for a, b in zip(files, files[1:]):
        assert tuple(a.hi) < tuple(b.lo)


def test_write_results_partitioned(spark, tmpdir_path):
    df = spark.createDataFrame([("N", 1), ("P", 2), ("P", 3)], "txn_type string, v int")
    write_results(df, f"{tmpdir_path}/res")
    write_results(df, f"{tmpdir_path}/res")  # a retry replaces the batch
    back = spark.read.parquet(f"{tmpdir_path}/res/results")
    assert sorted((r.txn_type, r.v) for r in back.collect()) == [("N", 1), ("P", 2), ("P", 3)]
    assert spark.read.parquet(f"{tmpdir_path}/res/results/batch=0/txn_type=P").count() == 2


def test_bucketed_layout(spark):
    """One file for each bucket, the number of buckets from the size of the data, and
    a request for one district reaches the scan as a filter."""
    st = load_state(spark, SF_SMALL, "all")
    n = bucket_count(spark)
    for t in (st.orders, st.orderline):
        assert len(t.inputFiles()) == n
    assert bucket_count(spark, 1000 * BUCKET_BYTES + 1) == 1001
    assert bucket_count(spark, 1 << 60) == 100_000
    plan = st.orders.where("o_w_id = 1 AND o_d_id = 2 AND o_id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_w_id,1)" in plan and "EqualTo(o_d_id,2)" in plan and "Exchange" not in plan
