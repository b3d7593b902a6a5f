"""T1: Structured Streaming replay of transaction-log files.

``readStream.text`` on a landing folder; each micro-batch (inside
``foreachBatch``, where the frame is static) is parsed, turned into log
frames, applied to the state of the batch before with ``plans.chain.apply_batch``
and written as the rows it changes (``state/v=<batchId>/delta``); every
``chain.COMPACT_EVERY``-th batch also writes a full snapshot, which later batches
start from.  Read records (O, S, I, T, R) are answered in their batch, as of their
place in it.  A retried batch reads the same earlier versions and overwrites its
own outputs, so it is idempotent.  Whole files are handed to a batch, so an N record never
straddles batches.  A batch result equals the one-shot replay when files
arrive in ``ord`` order (one file per time slice).
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from depotline.plans.chain import COMPACT_EVERY, apply_batch, read_chain, write_delta, write_snapshot
from depotline.plans.client_run import answers, records_to_log
from depotline.sources.adapter import State
from depotline.sources.sinks import _exists, work_table
from depotline.sources.txlog import parse_rows, valid_and_errors

def stream_replay(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  initial: State, as_of_ts: str = "2000-01-01 00:00:00",
                  available_now: bool = True) -> StreamingQuery:
    """Start the streaming replay; ``initial`` is written as snapshot v=-1 once."""
    states = f"{out_dir}/state"
    if not _exists(spark, f"{states}/v=-1/full/done"):
        write_snapshot(initial, f"{states}/v=-1")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("pos", F.monotonically_increasing_id())
        own = f"stream-{uuid.uuid4().hex[:12]}-b{batch_id}"

        def store(name: str, df: DataFrame) -> DataFrame:
            return work_table(spark, own, name, lambda: df)

        typed, order_lines, orphan = parse_rows(lines, store=store)
        records, errors = valid_and_errors(store("records", typed), orphan)
        order_lines = store("order_lines", order_lines)
        prev = read_chain(spark, states, batch_id - 1, initial)
        key = "stream-" + hashlib.sha1(out_dir.encode()).hexdigest()[:12] + f"-b{batch_id}"
        _, rp = apply_batch(spark, prev, records_to_log(records, order_lines, batch_id), as_of_ts, key=key)
        base = f"{out_dir}/results/batch={batch_id}"
        missing = rp.errors.select(F.lit(None).cast("string").alias("file"), F.col("ord").alias("record_no"), "reason",
                                   F.col("txn_type").alias("text"))
        errors.unionByName(missing).write.mode("overwrite").parquet(f"{base}/errors")
        rp.order_ids.write.mode("overwrite").parquet(f"{base}/order_ids")
        rp.delivery.write.mode("overwrite").parquet(f"{base}/delivery")
        rp.totals().write.mode("overwrite").parquet(f"{base}/new_order_totals")
        write_delta(rp.changes, f"{states}/v={batch_id}")
        nxt = read_chain(spark, states, batch_id, initial)
        for kind, rows in answers(rp, nxt, as_of_ts).items():
            rows.write.mode("overwrite").parquet(f"{base}/{kind}")
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            write_snapshot(nxt, f"{states}/v={batch_id}")

    src = (spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(in_dir)
           .select(F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"), "value"))
    w = src.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
