"""State snapshots and result sinks.

A5  ``write_state``: the state tables as parquet, range-partitioned and sorted
    by their keys (balanced files even when one district holds a third of the
    rows; min/max statistics then prune key lookups and o_id ranges).
A7  ``write_results``: typed result frames, partitioned by transaction type,
    errors in their own folder.

Snapshots live under the session's shared checkpoint folder
(``spark.checkpoint.dir``); a finished table has a ``_SUCCESS`` marker written
by the commit protocol, so a half-written snapshot is rebuilt, never read.
"""

from __future__ import annotations

import hashlib
import os
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotline.session import ensure_checkpoint_dir

# Layout keys of the materialised tables.
LAYOUT = {
    "warehouse": None,
    "district_base": None,
    "district": None,
    "customer": ["c_w_id", "c_d_id", "c_id"],
    "orders": ["o_w_id", "o_d_id", "o_id"],
    "orderline": ["ol_w_id", "ol_d_id", "ol_o_id", "ol_number"],
    "item": ["i_id"],
}

SNAPSHOT_VERSION = "5"

# Tables joined and grouped on the order key are also bucketed on it (same
# bucket count), so orders x orderline joins and per-order aggregations read
# co-partitioned files without a shuffle.  Hashing the full key (w, d, o_id)
# keeps a hot district spread over all buckets.
BUCKETED = {
    "orders": ["o_w_id", "o_d_id", "o_id"],
    "orderline": ["ol_w_id", "ol_d_id", "ol_o_id"],
}


def same_key(keys: list[str], laid: list[str]) -> Column:
    """Each of ``keys`` equals its column of the other side, _<key>.  Keys that the rows are not
    laid out by are compared by two bounds, which the planner takes for no key of the join: the
    rows then meet as they lie, and an order has few lines."""
    cond = F.lit(True)
    for k in keys:
        a, b = F.col(k), F.col(f"_{k}")
        cond = cond & (a == b if k in laid else (a <= b) & (a >= b))
    return cond


def _code_version() -> str:
    """Digest of the package sources: a snapshot or work table written by other
    code is never reused.  The text operators write none of these tables."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1(SNAPSHOT_VERSION.encode())
    for dirpath, _dirs, files in sorted(os.walk(root)):
        if os.path.relpath(dirpath, root).split(os.sep)[0] == "llm":
            continue
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode())
                    h.update(fh.read())
    return h.hexdigest()[:10]


CODE_VERSION = _code_version()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("text").load(f"{path}/_SUCCESS")
        return True
    except AnalysisException:
        return False


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are removed as each write ends, and not when the
    driver next collects its garbage: a written table is read back, its plan never runs again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_table(df: DataFrame, path: str, keys: list[str] | None) -> None:
    if keys:
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    else:
        df = df.coalesce(1)
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").parquet(path)


# Bytes of the orders and lineitem files per bucket: a bucket is one file of each
# order table and one task of every job that reads it by its order key.
BUCKET_BYTES = 256 << 20


def bucket_count(spark: SparkSession, n_bytes: int = 0) -> int:
    """Buckets of the order tables: from the size of the data, at least the session's
    shuffle partitions, at most what Spark allows; ``depotline.buckets`` overrides."""
    asked = spark.conf.get("depotline.buckets", None)
    if asked:
        return max(1, int(asked))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES)))


def _table_name(path: str) -> str:
    return "depotline_" + hashlib.sha1(path.encode()).hexdigest()[:16]


def write_bucketed(spark: SparkSession, df: DataFrame, path: str, bucket_cols: list[str],
                   sort_cols: list[str], n: int) -> None:
    """Bucketed, sorted external table at ``path``.  Rows are first shuffled by the
    bucket's own hash, so a bucket is written by one task as one file, whatever
    the number of tasks that made the rows."""
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    with freed_shuffles(spark):
        (df.repartition(n, *bucket_cols).write.mode("overwrite").bucketBy(n, *bucket_cols).sortBy(*sort_cols)
           .option("path", path).format("parquet").saveAsTable(name))


def read_bucketed(spark: SparkSession, path: str, bucket_cols: list[str], sort_cols: list[str],
                  n: int) -> DataFrame:
    """Register (idempotently) the bucketed table over existing files and read it."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                  f"CLUSTERED BY ({', '.join(bucket_cols)}) SORTED BY ({', '.join(sort_cols)}) "
                  f"INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_state(state, path: str, tables: list[str] | None = None) -> None:
    """Write every state table (A5 layout) under ``path``."""
    for name in tables or list(LAYOUT):
        write_table(getattr(state, name), f"{path}/{name}", LAYOUT[name])


def table_bytes(spark: SparkSession, sf_dir: str, *tables: str) -> int:
    """Bytes of the files of the named tables of a folder, in any store."""
    sc = spark.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in tables]
    stores = [p.getFileSystem(sc._jsc.hadoopConfiguration()) for p in paths]
    return sum(fs.getContentSummary(p).getLength() for fs, p in zip(stores, paths) if fs.exists(p))


def _file_facts(spark: SparkSession, path: str) -> list[str]:
    """name:length:time of the files of a folder of tables, through Hadoop's file
    systems, so that changed data in any store gets a new key."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    facts, todo = [fs.makeQualified(root).toString()], [root] if fs.exists(root) else []
    for folder in todo:  # the folder itself, then the tables that are folders of part files
        for st in fs.listStatus(folder):
            facts.append(f"{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}")
            if st.isDirectory() and folder is root:
                todo.append(st.getPath())
    return sorted(facts)


def snapshot_key(spark: SparkSession, sf_dir: str, mode: str) -> str:
    parts = [*_file_facts(spark, sf_dir), mode, CODE_VERSION]
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def snapshot_path(spark: SparkSession, sf_dir: str, mode: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/depotline-state/{snapshot_key(spark, sf_dir, mode)}-{mode}"


# Tables that do not depend on which orders are loaded: written once and
# shared by the snapshots of every mode.
SHARED = {"warehouse", "district_base", "customer", "item"}


def materialize(spark: SparkSession, derive, path: str, sources: dict, shared_path: str | None = None,
                n_bytes: int = 0):
    """Read the state snapshot at ``path``; tables that are missing are derived
    (``derive()`` builds the lazy state once) and written first.  The returned
    state reads parquet only: its lineage is cut at the snapshot.  Tables in
    SHARED live under ``shared_path`` (one copy for all modes); ``n_bytes``, the
    size of the order data, sets the number of buckets."""
    from depotline.sources.adapter import State

    tables, state = {}, None
    nb = bucket_count(spark, n_bytes)
    # orders first: district and orderline are then derived from the written
    # orders, so the dense numbering runs once.
    for name in ["orders"] + [n for n in LAYOUT if n != "orders"]:
        root = shared_path if (shared_path and name in SHARED) else path
        p = f"{root}/{name}" + (f".b{nb}" if name in BUCKETED else "")
        if not _exists(spark, p):
            if state is None:
                state = derive(tables.get("orders"))
            t0 = time.time()
            if name in BUCKETED:
                write_bucketed(spark, getattr(state, name), p, BUCKETED[name], LAYOUT[name], nb)
            else:
                write_table(getattr(state, name), p, LAYOUT[name])
            if os.environ.get("DEPOTLINE_TRACE"):
                print(f"snapshot {name}: {time.time() - t0:.2f}s")
        if name in BUCKETED:
            tables[name] = read_bucketed(spark, p, BUCKETED[name], LAYOUT[name], nb)
        else:
            tables[name] = spark.read.parquet(p)
        if name == "orders":
            state = None
    return State(sources=sources, **tables)


# One writer per snapshot / work table within a driver process (queries may be
# started from several threads of one application).
WRITE_LOCK = threading.RLock()


def work_path(spark: SparkSession, key: str, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/depotline-work/{key}/{name}"


def work_table(spark: SparkSession, key: str, name: str, build) -> DataFrame:
    """A written intermediate table under the shared checkpoint folder: built
    once by ``build()`` (a lazy frame), then read back.  Cuts the lineage of
    long chains and lets later queries reuse the result; a lost executor only
    costs its own tasks, never a recomputation of the whole chain."""
    p = work_path(spark, key, name)
    with WRITE_LOCK:
        return _work_table(spark, p, name, build)


def _work_table(spark: SparkSession, p: str, name: str, build) -> DataFrame:
    if not _exists(spark, p):
        t0 = time.time()
        df = build()
        with freed_shuffles(spark):
            df.write.mode("overwrite").parquet(p)
        if os.environ.get("DEPOTLINE_TRACE"):
            print(f"work table {name}: {time.time() - t0:.2f}s")
    return spark.read.parquet(p)


def scratch_table(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A work table of this call's own: written each time and never reused."""
    return work_table(spark, f"scratch-{uuid.uuid4().hex}", name, lambda: df)


def write_results(df: DataFrame, path: str, batch: str = "0", errors: DataFrame | None = None) -> None:
    """A7: typed results of a batch, one folder per batch and transaction type, and
    its rejected records under ``errors``.  A repeated batch replaces its own
    folders, so a retry leaves no duplicates."""
    w = df.write.mode("overwrite")
    if "txn_type" in df.columns:
        w = w.partitionBy("txn_type")
    w.parquet(f"{path}/results/batch={batch}")
    if errors is not None:
        errors.write.mode("overwrite").parquet(f"{path}/errors/batch={batch}")
