"""Figures of a task that must not grow with the input."""

import os
import re
import time
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from depotline import session
from depotline.functions.sequencing import running_aggs
from depotline.operators import checks, derived, reads, writes
from depotline.plans import as_of
from depotline.plans import requests as rq
from depotline.plans.chain import CHANGED, upsert
from depotline.plans.replay import replay_context, validate
from depotline.sources.adapter import State, derive_state, load_state
from depotline.sources.sinks import BUCKETED, _exists, scratch_table, work_path


def test_shuffle_partitions_follow_the_input(spark):
    parts, task = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    files = "spark.sql.files.maxPartitionBytes"
    before = {k: spark.conf.get(k) for k in (parts, task, files)}
    try:
        session.fit_partitions(spark, 1 << 20)  # a small input changes nothing
        assert {k: spark.conf.get(k) for k in (parts, task, files)} == before
        session.fit_partitions(spark, 4 << 30)
        assert spark.conf.get(parts) == "1024" and spark.conf.get(task) == f"{4 << 20}b"
        assert spark.conf.get(files) == f"{16 << 20}b"
        session.fit_partitions(spark, 1 << 30)  # never coarser again
        assert spark.conf.get(parts) == "1024"
        spark.conf.set(task, "16k")
        session.fit_partitions(spark, 4 << 30)
        assert spark.conf.get(task) == "16k"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("width", [4, 1 << 18])
def test_per_key_columns_join_the_partials(spark, width):
    rows = spark.createDataFrame([(k, o, o % 7) for k in (1, 2, 3) for o in range(20)], "k int, o long, v int")
    extra = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (9, "z")], "k int, x string")
    specs = [("v", "s", "sum", True), (F.struct("o", "v"), "m", "max", False)]
    got = running_aggs(rows, ["k"], "o", specs, width=width, per_key=extra).select("k", "o", "x", "s", "m.o")
    want = running_aggs(rows, ["k"], "o", specs).join(extra, "k").select("k", "o", "x", "s", "m.o")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_an_order_is_looked_at_once_for_all_requests(spark):
    lines = [(1, 1, o, n, 10 * o + n, q) for o, qs in {1: (3, 3, 1), 2: (2,), 3: (1, 4)}.items() for n, q in enumerate(qs, 1)]
    state = SimpleNamespace(orderline=spark.createDataFrame(
        lines, "ol_w_id int, ol_d_id int, ol_o_id long, ol_number int, ol_i_id long, ol_quantity int"))
    keys = spark.createDataFrame([(r, 1, 1, o) for r in range(100) for o in (1, 2, 3)] + [(0, 1, 1, 1)],
                                 "req_id long, w_id int, d_id int, o_id long")
    assert reads.tied_lines(state, keys).count() == 4  # not once for each request
    got = sorted((r.req_id, r.o_id, r.i_id, r.max_qty) for r in reads.popular_lines(state, keys).collect())
    assert got == sorted((r, *x) for r in range(100) for x in ((1, 11, 3), (1, 12, 3), (2, 21, 2), (3, 32, 4)))


def test_stock_as_of_needs_no_join_of_numbered_draws(spark):
    lines = spark.createDataFrame([(2, 1, 5, 1, 40), (2, 1, 5, 2, 35), (1 << 20, 1, 5, 1, 20), (4, 2, 5, 1, 77)],
                                  "ord long, supply_w_id int, i_id long, ol_number int, s_quantity_after int")
    wanted = spark.createDataFrame([(o, w, i) for o in (1, 3, 1 << 19, 1 << 21) for w in (1, 2) for i in (5, 6)] + [(7, 3, 8)],
                                   "req_id long, w_id int, i_id long")
    base = spark.createDataFrame([(1, 5, 50), (2, 5, 90), (1, 6, 60), (2, 6, 66)], "s_w_id int, s_i_id long, s_quantity int")
    state = SimpleNamespace(stock_for=lambda keys: base.join(keys, ["s_w_id", "s_i_id"]))
    out = as_of.stock_as_of(state, lines, wanted)
    got = sorted((r.req_id, r.i_id, r.s_quantity) for r in out.collect())
    now = {(1, 5): [50, 35, 35, 20], (2, 5): [90, 90, 77, 77], (1, 6): [60] * 4, (2, 6): [66] * 4}
    assert got == sorted((o, i, q) for (w, i), qs in now.items() for o, q in zip((1, 3, 1 << 19, 1 << 21), qs))
    assert "LeftSemi" not in out._jdf.queryExecution().toString() and "LeftOuter" not in out._jdf.queryExecution().toString()


def test_of_repeated_draws_the_newest_counts(spark):
    lines = spark.createDataFrame([(2, 1, 5, 1, 40), (2, 1, 5, 1, 35)], "ord long, supply_w_id int, i_id long, ol_number int, s_quantity_after int")
    wanted = spark.createDataFrame([(3, 1, 5), (1 << 21, 1, 5)], "req_id long, w_id int, i_id long")  # near it and a bucket further
    base = spark.createDataFrame([(1, 5, 50)], "s_w_id int, s_i_id long, s_quantity int")
    state = SimpleNamespace(stock_for=lambda keys: base.join(keys, ["s_w_id", "s_i_id"]))
    got = {r.req_id: r.s_quantity for r in as_of.stock_as_of(state, lines, wanted).collect()}
    assert got[1 << 21] == 35 and got[3] in (35, 40)


SF = "/root/testdata/sf0.001"


def joins(df):
    """The conditions of the optimized plan's joins, from the outermost in."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]


def test_lines_are_not_moved_by_their_supplier(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "20KB")  # the suppliers are far below, supplier x nation as the planner guesses it is not
        lines = derive_state(spark, SF, "base").orderline
        plan = lines._jdf.queryExecution().sparkPlan().toString()
        assert re.search(r"BroadcastHashJoin \[ol_suppkey#\d+L\], \[s_suppkey#\d+L\]", plan)
    finally:
        spark.conf.set(name, before)


def test_new_lines_meet_stock_and_item_in_one_join(spark):
    rp = replay_context(spark, SF)
    lines = writes.new_order_lines(rp.state, rp.log.n_hdr, rp.log.n_lines, hdr=rp.order_ids)
    assert re.search(r"supply_w_id#\d+ = s_w_id#\d+", joins(lines)[0])


def test_asked_orders_meet_their_lines_before_the_union(spark):
    rp = replay_context(spark, SF)
    after = as_of.after_orders(rp)
    asked = after.orders.where("o_id % 3 = 0").select(F.col("o_w_id").alias("w_id"), F.col("o_d_id").alias("d_id"), "o_id")
    held = as_of.asked_lines(rp, asked)
    assert held._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    want = after.orderline.where("ol_o_id % 3 = 0").select("ol_w_id", "ol_d_id", "ol_o_id", "ol_number", "ol_i_id", "ol_quantity", "ol_delivery_d")
    got = held.where("ol_number is not null").select("w_id", "d_id", "o_id", "ol_number", "ol_i_id", "ol_quantity", "ol_delivery_d")
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r)) for r in want.collect())
    assert held.select("w_id", "d_id", "o_id").distinct().count() == asked.count()  # without lines, too


def test_related_customers_write_no_index_of_all_pairs(spark):
    st = replace(load_state(spark, SF), key="related-test")
    req = rq.customer_requests(st).where("c_id % 5 = 0")
    for fn in (reads.related_customers, reads.related_customers_by_lines):
        got = {tuple(r) for r in fn(st, req).collect()}
        assert not _exists(spark, work_path(spark, "related-test-idx", "customer_item_pairs"))
        assert got == {tuple(r) for r in fn(replace(st, key=None), req).collect()}
        assert got


@pytest.fixture()
def large_session(spark):
    """The session as ``fit_partitions`` leaves it for a large input, from Spark's own threshold of 10 MB."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
             GUESSED, MEASURED)
    before = {k: spark.conf.get(k, None) for k in names}
    spark.conf.set(GUESSED, "10MB")
    spark.conf.unset(MEASURED)
    session.fit_partitions(spark, 128 << 20)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def test_large_inputs_broadcast_what_was_measured(large_session):
    spark = large_session
    assert spark.conf.get(GUESSED) == f"{256 << 10}b" and spark.conf.get(MEASURED) == "10MB"
    spark.conf.set(GUESSED, "20KB")  # never larger
    session.fit_partitions(spark, 128 << 20)
    assert spark.conf.get(GUESSED) == "20KB" and spark.conf.get(MEASURED) == "10MB"
    spark.conf.set(GUESSED, "-1")  # nor is it turned on
    session.fit_partitions(spark, 128 << 20)
    assert spark.conf.get(GUESSED) == "-1"


def test_a_counted_table_is_broadcast(large_session):
    hinted = lambda n: "Hint" in session.counted_broadcast(large_session.range(n))._jdf.queryExecution().analyzed().toString()
    assert hinted(100_000) and not hinted(1_000_000)  # 16 bytes a row, 10 MB at most
    large_session.conf.set(MEASURED, "-1")
    assert not hinted(1)


def many_parts(spark):
    """A state of 100,000 parts: a guess of some MB, and five times the rows in the stock."""
    part = spark.range(100_000).select(F.col("id").alias("p_partkey"), F.lit("x").alias("p_type"))
    item = part.select(F.col("p_partkey").alias("i_id"), F.lit("n").alias("i_name"), F.lit(1).cast("decimal(12,2)").alias("i_price"))
    wh = spark.createDataFrame([(w,) for w in range(1, 6)], "w_id int")
    return replace(State(*[None] * 7), warehouse=wh, item=item, sources={"part": part})


def test_stock_keys_are_not_broadcast_by_a_guess(large_session):
    out = derived.stock_item(many_parts(large_session))
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 500_000


def test_items_are_not_broadcast_to_validate_a_log(large_session):
    spark = large_session
    rp = replay_context(spark, SF)
    state = replace(rp.state, item=many_parts(spark).item)
    plan = validate(state, rp.log)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[i_id#\d+L\], \[i_id#\d+L\], LeftAnti, BuildRight", plan)
    assert re.search(r"SortMergeJoin \[i_id#\d+L\], \[i_id#\d+L\], LeftAnti", plan)


def test_related_reads_write_no_index_of_all_pairs(spark):
    rp = replay_context(spark, SF)
    of = SimpleNamespace(state=replace(rp.state, key="related-log-test"), order_ids=rp.order_ids, lines=rp.lines)
    req = rp.log.asked("R", "w_id", "d_id", "c_id")
    req = req.unionByName(req.withColumn("req_id", F.col("req_id") + 100_000))  # asked for twice
    got = sorted(tuple(r) for r in as_of.related_as_of(of, req).collect())
    assert not _exists(spark, work_path(spark, "related-log-test-idx", "customer_item_pairs"))
    old = reads.customer_item_pairs(replace(rp.state, key=None)).withColumn("since", F.lit(as_of.BEFORE).cast("long"))
    items = rp.lines.select("ord", "i_id").distinct()
    new = items.alias("a").join(items.alias("b"), "ord").where("a.i_id < b.i_id").join(rp.order_ids, "ord") \
        .select("w_id", "d_id", "c_id", F.col("a.i_id").alias("i1"), F.col("b.i_id").alias("i2"), F.col("ord").alias("since"))
    a, b = old.unionByName(new).alias("a"), old.unionByName(new).alias("b")
    want = a.join(req, ["w_id", "d_id", "c_id"]).where("since < req_id").join(b, ["i1", "i2"]) \
        .where("b.since < req_id and a.w_id <> b.w_id").select("req_id", "b.w_id", "b.d_id", "b.c_id").distinct()
    assert got and got == sorted(tuple(r) for r in want.collect())


def test_only_asked_customers_pairs_are_made_for_them(spark):
    rp = replay_context(spark, SF)
    who = rp.log.asked("R", "w_id", "d_id", "c_id").drop("req_id").distinct().limit(3)
    every = as_of.dated_item_pairs(rp)
    assert sorted(as_of.dated_item_pairs(rp, who).collect()) == sorted(
        every.join(who, ["w_id", "d_id", "c_id"], "left_semi").select(*every.columns).collect())


def test_written_tables_leave_no_shuffle_files(spark):
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in dirs for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(name)
    rows = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count()
    assert scratch_table(spark, "freed", rows).count() == 997
    assert spark.conf.get(name) == setting
    shuffles = lambda: {f.split("_")[1] for f in held() - before}
    end = time.time() + 20
    while len(shuffles()) > 1 and time.time() < end:  # that of the count above may stay
        time.sleep(0.2)
    assert len(shuffles()) <= 1


@pytest.mark.parametrize("as_laid", [True, False])
def test_laid_out_lines_are_not_moved_to_change_or_compare_them(spark, as_laid):
    before = spark.conf.get(GUESSED)
    try:
        spark.conf.set(GUESSED, "-1")
        lines, keys, laid = load_state(spark, SF).orderline, CHANGED["orderline"], BUCKETED["orderline"]
        changed = lines.where("ol_number = 2 and ol_o_id % 5 = 0").withColumn("ol_quantity", F.col("ol_quantity") + 1)
        if not as_laid:
            changed = changed.repartition(3)
        new = upsert(lines, changed, keys, laid)
        out = checks._versions(lines, new, keys, ["ol_quantity"], laid=laid)
        moved = re.findall(r"Exchange hashpartitioning\(.*", out._jdf.queryExecution().executedPlan().toString())
        assert not any("ol_number" in x for x in moved)
        assert len(moved) == (0 if as_laid else 2)  # of the changed lines and of the new ones, not of the old
        n = changed.count()
        assert n and out.where("o_ol_quantity <> n_ol_quantity").count() == n and out.count() == lines.count()
        assert out.where("_old is null or _new is null").count() == 0
    finally:
        spark.conf.set(GUESSED, before)


def test_changed_rows_replace_those_of_the_whole_key_only(spark):
    cols = "ol_w_id int, ol_d_id int, ol_o_id long, ol_number int, v int"
    base = spark.createDataFrame([(1, 1, 1, 1, 10), (1, 1, 1, 2, 20), (1, 1, 1, 2, 21), (1, 1, 2, 1, 30), (1, 1, 2, None, 40)], cols)
    new = spark.createDataFrame([(1, 1, 1, 2, 99), (1, 1, 3, 1, 98), (1, 1, 2, None, 97)], cols)
    got = upsert(base, new, CHANGED["orderline"], BUCKETED["orderline"]).collect()
    assert sorted(got, key=str) == sorted(upsert(base, new, CHANGED["orderline"]).collect(), key=str)
    assert sorted(r.v for r in got) == [10, 30, 40, 97, 98, 99]
    found = checks._versions(base, new, CHANGED["orderline"], ["v"], laid=BUCKETED["orderline"])
    assert sorted((r.ol_o_id, r.ol_number or 0, r.o_v or 0, r.n_v or 0) for r in found.collect()) == [
        (1, 1, 10, 0), (1, 2, 20, 99), (1, 2, 21, 99), (2, 0, 0, 97), (2, 0, 40, 0), (2, 1, 30, 0), (3, 1, 0, 98)]
