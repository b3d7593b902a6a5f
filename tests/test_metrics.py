"""Run summaries: percentile = element at 0-based index floor(n * p)."""

import os
import random

from pyspark.sql import functions as F

from depotline.operators import metrics as M


def _naive(values, p):
    s = sorted(values)
    return s[len(s) * p // 100]


def test_percentiles_match_index_rule(spark):
    rng = random.Random(5)
    rows = []
    # client 0: n = 20 (n*0.95 = 19 and n*0.5 = 10 are whole), client 1: n = 37, client 2: hot
    for client, n in [(0, 20), (1, 37), (2, 400)]:
        for _ in range(n):
            rows.append((client, "N", round(rng.uniform(0.01, 9.99), 2)))
    m = spark.createDataFrame(rows, "client int, txn_type string, elapsed double") \
        .withColumn("elapsed", F.col("elapsed").cast("decimal(12,2)"))
    got = {r.client: r for r in M.latency_summary(m).collect()}
    for client in (0, 1, 2):
        vals = [float(e) for c, _, e in rows if c == client]
        r = got[client]
        assert r.n == len(vals)
        assert r.median_s == _naive(vals, 50)
        assert r.p95_s == _naive(vals, 95)
        assert r.p99_s == _naive(vals, 99)


def test_percentile_bucketed_path(spark):
    """Many distinct values in one client: the bucketed running count (small
    width) gives the same order statistics."""
    rng = random.Random(9)
    vals = [rng.randint(1, 100000) / 100 for _ in range(3000)]
    m = spark.createDataFrame([(0, "N", v) for v in vals], "client int, txn_type string, elapsed double") \
        .withColumn("elapsed", F.col("elapsed").cast("decimal(12,2)"))
    p = M.exact_percentiles(m, ["client"], (1, 50, 99), width=64).collect()[0]
    assert (p.p1, p.p50, p.p99) == (_naive(vals, 1), _naive(vals, 50), _naive(vals, 99))


def test_percentiles_keep_nanoseconds(spark):
    """Values below a hundredth, an outlier far above and negative ones keep their order."""
    vals = ["0.000000001", "0.000000002", "0.000000003", "0.004", "0.004000001", "86400.5", "-0.25", "-3"]
    m = spark.createDataFrame([(0, v) for v in vals], "client int, v string") \
        .select("client", F.col("v").cast("decimal(18,9)").alias("elapsed"))
    pcts = tuple(range(0, 100, 13))
    got = M.exact_percentiles(m, ["client"], pcts, width=2).collect()[0]
    assert [got[f"p{p}"] for p in pcts] == [_naive([float(v) for v in vals], p) for p in pcts]


def test_measure_log_round_trip(spark, tmpdir_path):
    m = spark.createDataFrame([(0, "new_order", "0.000001250"), (0, "payment", "2.5"), (1, "new_order", "3")],
                              "client int, txn_type string, elapsed string") \
        .withColumn("elapsed", F.col("elapsed").cast("decimal(18,9)"))
    M.write_measure_log(M.render_measure_log(M.latency_summary(m), M.latency_by_type(m)), f"{tmpdir_path}/log")
    clients, types = M.read_measure_log(spark, f"{tmpdir_path}/log")
    assert clients.drop("run").exceptAll(M.latency_summary(m)).count() == 0 and clients.count() == 2
    assert types.drop("run").exceptAll(M.latency_by_type(m)).count() == 0 and types.count() == 3


def test_measure_log_of_two_runs(spark, tmpdir_path):
    """A log as a client writes it: two runs in one file, other lines between, a broken number."""
    os.makedirs(f"{tmpdir_path}/log/client=7")
    with open(f"{tmpdir_path}/log/client=7/a.txt", "w") as f:
        f.write("starting\nTotal number of transactions processed: 12\n"
                "Total elapsed time for processing the transactions: 1.5e-05 seconds\n"
                "Transaction throughput: 800000 transactions/second\n"
                ">>> Total number of top_balance processed 3\ntop_balance's throughput 2.5\n"
                "top_balance's average transaction latency: 0.4 seconds\ntop_balance's Median transaction latency: 0.3\n"
                "top_balance's 99th percentile transaction latency: 0.9 seconds\n"
                "Total number of transactions processed: 5\nTransaction throughput: x transactions/second\n")
    clients, types = M.read_measure_log(spark, f"{tmpdir_path}/log")
    rows = {r.run: r for r in clients.collect()}
    assert (rows[1].n, rows[1].total_s, rows[1].throughput, rows[1].p95_s) == (12, 1.5e-05, 800000.0, None)
    assert (rows[2].n, rows[2].throughput) == (5, None) and len(rows) == 2
    assert [tuple(r) for r in types.collect()] == [(7, 1, "top_balance", 3, 2.5, 0.4, 0.3, 0.9)]
