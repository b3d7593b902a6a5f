"""Run metrics: latency / throughput summaries of measured transactions.

A measurement is (client, txn_type, elapsed seconds as an exact decimal).
Percentiles follow the run summary definition: the element at 0-based index
``floor(n * p)`` of the sorted values (not ``percentile_disc``, which differs
when ``n * p`` is whole).  They are computed exactly and skew-safe:

1. a histogram ``(group, value) -> count`` (map-side combined aggregation) at the
   value's own scale, nanoseconds for the given events;
2. counts over slices of the values.  A slice keeps the leading bits of the value, so
   there is a bounded number of slices whatever the range, and one outlier does not
   push all others into one slice;
3. a running count over a group's slices finds the slice of each wanted index, and
   only the values of these slices are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_CLIENTS = 20
# Seconds to the nanosecond.
ELAPSED = T.DecimalType(18, 9)
# Fixed percentiles of the summaries, in percent.
SUMMARY_PCTS = (50, 95, 99)
TYPE_PCTS = (50, 99)


def measurements(events: DataFrame, n_clients: int = N_CLIENTS) -> DataFrame:
    """events -> (client, txn_type, elapsed): client = pmod(user_id, n_clients)."""
    return events.select(F.pmod(F.col("user_id"), F.lit(n_clients)).cast("int").alias("client"),
                         F.col("event_type").alias("txn_type"),
                         F.col("value").cast(ELAPSED).alias("elapsed"))


def _slice(v: str, width: int) -> F.Column:
    """A slice number that rises with the whole number ``v``: its leading bits, ``width``
    (a power of two) slices for each doubling."""
    bits = width.bit_length()
    return F.expr(f"sign({v}) * (greatest(length(bin(abs({v}))) - {bits}, 0) * {width} "
                  f"+ shiftright(abs({v}), greatest(length(bin(abs({v}))) - {bits}, 0)))").cast("long")


def exact_percentiles(m: DataFrame, keys: Sequence[str], pcts: Sequence[int],
                      value: str = "elapsed", width: int = 1024) -> DataFrame:
    """(keys..., p<pct> for pct in pcts): element at index floor(n*pct/100), exact at the
    scale of ``value`` (other types than decimals count as nanoseconds)."""
    keys = list(keys)
    kind = m.schema[value].dataType
    if not isinstance(kind, T.DecimalType):
        m, kind = m.withColumn(value, F.col(value).cast(ELAPSED)), ELAPSED
    hist = m.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    hist = hist.withColumn("_v", (F.col(value) * F.lit(10 ** kind.scale)).cast("long")).withColumn("_s", _slice("_v", width))
    slices = hist.groupBy(*keys, "_s").agg(F.sum("_cnt").alias("_in"))
    by_slice = Window.partitionBy(*keys).orderBy("_s")  # a bounded number of slices
    slices = slices.withColumn("_hi", F.sum("_in").over(by_slice)).withColumn("_n", F.sum("_in").over(Window.partitionBy(*keys)))
    wanted = slices.select(*keys, "_s", (F.col("_hi") - F.col("_in")).alias("_lo"), "_hi",
                           F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pct"), F.expr(f"_n * {int(p)} div 100").alias("ix"))
                                               for p in pcts])).alias("_w"))
    wanted = wanted.where((F.col("_lo") <= F.col("_w.ix")) & (F.col("_w.ix") < F.col("_hi")))
    places = wanted.groupBy(*keys, "_s").agg(F.min("_lo").alias("_lo"), F.collect_list("_w").alias("_ws"))  # at most len(pcts)
    in_slice = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = hist.join(places, [*keys, "_s"]).withColumn("_to", F.col("_lo") + F.sum("_cnt").over(in_slice))
    hit = F.filter("_ws", lambda w: (F.col("_to") - F.col("_cnt") <= w["ix"]) & (w["ix"] < F.col("_to")))
    h = h.select(*keys, F.col(value), F.explode(hit).alias("_w"))
    return h.groupBy(*keys).agg(*[F.max(F.when(F.col("_w.pct") == int(p), F.col(value))).cast("double").alias(f"p{p}")
                                  for p in pcts])


def _summary(m: DataFrame, keys: list[str], pcts: Sequence[int]) -> DataFrame:
    base = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                F.sum("elapsed").cast("double").alias("total_s"))
    base = base.where(F.col("total_s") > 0)
    base = base.select(*keys, "n", "total_s",
                       (F.col("n") / F.col("total_s")).alias("throughput"),
                       (F.col("total_s") / F.col("n")).alias("mean_s"))
    return base.join(exact_percentiles(m, keys, pcts), keys, "inner")


def latency_summary(m: DataFrame) -> DataFrame:
    """M1: per client n, total, throughput, mean, median, p95, p99."""
    s = _summary(m, ["client"], SUMMARY_PCTS)
    return s.select("client", "n", "total_s", "throughput", "mean_s",
                    F.col("p50").alias("median_s"), F.col("p95").alias("p95_s"),
                    F.col("p99").alias("p99_s"))


def latency_by_type(m: DataFrame) -> DataFrame:
    """M2: per client and type; types with zero total time are omitted."""
    s = _summary(m, ["client", "txn_type"], TYPE_PCTS)
    return s.select("client", "txn_type", "n", "throughput", "mean_s",
                    F.col("p50").alias("median_s"), F.col("p99").alias("p99_s"))


def throughput_fleet(m: DataFrame) -> DataFrame:
    """M3: min / max / avg client throughput, overall ('ALL') and per type.
    The average divides by the actual number of clients."""
    overall = latency_summary(m).select(F.lit("ALL").alias("txn_type"), "throughput")
    per_type = latency_by_type(m).select("txn_type", "throughput")
    u = overall.unionByName(per_type)
    return u.groupBy("txn_type").agg(
        F.min("throughput").alias("min_tput"), F.max("throughput").alias("max_tput"),
        F.round(F.avg("throughput"), 6).alias("avg_tput"), F.count(F.lit(1)).alias("n_clients"))


# --- M4: the textual measure log and its extraction -------------------------------

# The labels of a client's log, each with what follows its number.
CLIENT_LABELS = {
    "n": ("Total number of transactions processed: ", ""),
    "total_s": ("Total elapsed time for processing the transactions: ", " seconds"),
    "throughput": ("Transaction throughput: ", " transactions/second"),
    "mean_s": ("Average transaction latency: ", " seconds"),
    "median_s": ("Median transaction latency: ", " seconds"),
    "p95_s": ("95th percentile transaction latency: ", " seconds"),
    "p99_s": ("99th percentile transaction latency: ", " seconds"),
}
# The labels of one transaction type; ``%`` stands for its name.
TYPE_LABELS = {
    "n": (">>> Total number of % processed ", ""),
    "throughput": ("%'s throughput ", ""),
    "mean_s": ("%'s average transaction latency: ", " seconds"),
    "median_s": ("%'s Median transaction latency: ", ""),
    "p99_s": ("%'s 99th percentile transaction latency: ", " seconds"),
}


def render_measure_log(summary: DataFrame, by_type: DataFrame) -> DataFrame:
    """(client, section, line_no, text): a client's own section (''), then its types by name."""
    own = F.array(*[F.concat(F.lit(a), F.col(c).cast("string"), F.lit(b)) for c, (a, b) in CLIENT_LABELS.items()])
    types = F.array(*[F.concat(F.replace(F.lit(a), F.lit("%"), F.col("txn_type")), F.col(c).cast("string"), F.lit(b))
                      for c, (a, b) in TYPE_LABELS.items()])
    return summary.select("client", F.lit("").alias("section"), F.posexplode(own).alias("line_no", "text")) \
        .unionByName(by_type.select("client", F.col("txn_type").alias("section"), F.posexplode(types).alias("line_no", "text")))


def write_measure_log(lines: DataFrame, path: str) -> None:
    """One text file for each client below ``path``/client=<client>, lines in order.  A
    client has seven lines and five for each type, however long its run."""
    lines.repartition("client").sortWithinPartitions("client", "section", "line_no") \
         .select("client", F.col("text").alias("value")).write.mode("overwrite").partitionBy("client").text(path)


def read_measure_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text files below ``path``/client=<client> -> (clients, types), typed rows.

    A file may hold several runs, one after the other: a line belongs to the run whose
    first line is the last one at or before it, by a running count in the file's order.
    Lines without a known label are passed over; a label that a run does not have, or
    whose number cannot be read, is null."""
    text = spark.read.text(path).select(
        "client", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
    first = CLIENT_LABELS["n"][0]
    in_file = Window.partitionBy("client", "file").orderBy("block", "pos")
    text = text.withColumn("run", F.sum(F.startswith("value", F.lit(first)).cast("int")).over(in_file))

    def number(prefix: F.Column, suffix: str) -> F.Column:
        rest = F.when(F.startswith("value", prefix) & F.endswith("value", F.lit(suffix)),
                      F.substring(F.col("value"), F.length(prefix) + 1, F.length("value")))
        return F.trim(F.regexp_replace(rest, f"{suffix}$", "")) if suffix else F.trim(rest)

    def typed(frame: DataFrame, keys: list[str], labels: dict, fill) -> DataFrame:
        return frame.groupBy(*keys).agg(*[
            F.max(number(fill(a), b)).try_cast("long" if c == "n" else "double").alias(c) for c, (a, b) in labels.items()])

    clients = typed(text, ["client", "file", "run"], CLIENT_LABELS, F.lit).where("run > 0").drop("file")
    name = F.coalesce(*[F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
                        for p in (r"^>>> Total number of (.+) processed ", r"^(.+)'s (?:throughput|average|Median|99th) ")])
    named = text.withColumn("txn_type", name).where(F.col("txn_type").isNotNull())
    types = typed(named, ["client", "file", "run", "txn_type"], TYPE_LABELS,
                  lambda a: F.replace(F.lit(a), F.lit("%"), F.col("txn_type"))).drop("file")
    return clients, types
