"""Session helpers: one place for the settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "depotline") -> SparkSession:
    """Create (or reuse) a session with the settings the library assumes.

    On a cluster pass ``master=None`` and let spark-submit decide; locally the
    tests pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.ansi.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("DEPOTLINE_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Input files of this many bytes get one more partition of each shuffle, and adaptive execution puts
# as many bytes of compressed shuffle data into one task.  Sorted or hashed rows take up to 50
# times the memory that they have bytes in a compressed shuffle.
INPUT_BYTES = 4 << 20
TASK_BYTES = 4 << 20
FILE_BYTES = 16 << 20
SMALL_BYTES = 64 << 20  # an input up to this leaves the session as it is
# For larger inputs, tables that the planner guesses to be larger than this are broadcast only
# once adaptive execution has measured them.  The guess follows the bytes of the compressed columns
# that are read and knows nothing of rows that an explode adds: ids, a byte or two a row in
# a file, take 30 to 100 times as much in the driver's hash table.
GUESSED_BROADCAST = 256 << 10


def fit_partitions(spark: SparkSession, n_bytes: int) -> None:
    """Let the session's shuffle partitions grow with the input, so that the rows of a task
    and its memory do not.  Partitions only ever get finer."""
    parts, task = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if n_bytes <= SMALL_BYTES:
        return
    spark.conf.set(parts, str(max(int(spark.conf.get(parts)), -(-n_bytes // INPUT_BYTES))))
    # a task's share of the files bounds what its map side hashes and sorts
    for name, most in ((task, TASK_BYTES), ("spark.sql.files.maxPartitionBytes", FILE_BYTES)):
        if _size(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    now = spark.conf.get(guessed)
    if not now.strip().startswith("-") and _size(now) > GUESSED_BROADCAST:  # negative: no broadcast at all
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, now)
        spark.conf.set(guessed, f"{GUESSED_BROADCAST}b")


def counted_broadcast(df: DataFrame) -> DataFrame:
    """A written table of whole numbers with a broadcast hint, if its counted rows are no more than
    adaptive execution would broadcast: the rows it meets then need no shuffle to find that out."""
    conf, guessed = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    most = conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or conf.get(guessed)
    if most.strip().startswith("-"):
        return df
    return F.broadcast(df) if df.count() * 8 * (len(df.columns) + 1) <= _size(most) else df


def _size(text: str) -> int:
    """Bytes of a size setting such as 64MB, 16m or 1024."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``; that folder (not the
    per-application subfolder Spark adds for RDD checkpoints) holds the state
    snapshots, so a snapshot written by one application is reused by the
    next.  Without the setting a local master gets a fresh scratch folder;
    on a cluster that is an error, because executors do not share one.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf)
        return conf
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    conf = tempfile.mkdtemp(prefix="depotline-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf)
    return conf
