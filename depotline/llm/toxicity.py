"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios (NB-LR).

A document's features are the distinct character n-grams (3 to 5) of its whole
lower-cased text, hashed into ``BUCKETS``.  With p and q the smoothed shares
of the toxic and the other documents that hold a feature, the feature's value
is r = log(p / q) if present; a logistic regression with an L2 penalty is
trained on these values.  At most ``FEATURES`` buckets, those with the
strongest evidence (twice the log-likelihood ratio of at least ``EVIDENCE``, far beyond chance) take part.

Fitted on a bounded sample of the learning folds' labels: about
``TRAIN_TOXIC`` toxic and ``TRAIN_OTHER`` other rows, those with the smallest
hashes, whole texts; weights undo the sampling, so that a score is the
estimated probability of label 1.

* null text: an empty text, scored like any other (the share without evidence)
* only one label to learn from: every score is the smoothed share of label 1
* repeated ids in the labels: toxic if any of them is; a null label is none
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import HELD_OUT_FOLD, fold, table, with_text_columns, write_table
from depotline.llm.keytable import MULTIPLIER

SIZES = (3, 4, 5)
BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
CHUNK = 4096
FEATURES = 8_192
EVIDENCE = 20.0
TRAIN_TOXIC = 3_000
TRAIN_OTHER = 6_000
SMOOTHING = 1.0
PENALTY = 2.0
STEPS = 150
THRESHOLD = 0.3
PART_CHARS = 1 << 20


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    return np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)


def buckets(cps: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place."""
    n = len(cps) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ cps[j:j + n]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def present(cps: np.ndarray) -> np.ndarray:
    """The distinct buckets of one text."""
    return np.unique(np.concatenate([buckets(cps, s) for s in SIZES]))


def training_sample(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> DataFrame:
    """(text, y, weight) of the sampled labels' documents."""
    lab = labels.where((fold(doc_id) != HELD_OUT_FOLD) & F.col(label).isin(0, 1)) \
                .select(F.col(doc_id).alias("_ll_id"), F.col(label).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in lab.groupBy("y").count().collect()}
    share = {y: min(1.0, most / n[y]) for y, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)) if y in n}
    h = F.pmod(F.xxhash64("_ll_id"), F.lit(1 << 30))
    bound, weight = F.lit(0), F.lit(0.0)
    for y, s in share.items():
        bound = F.when(F.col("y") == y, int(s * (1 << 30))).otherwise(bound)
        weight = F.when(F.col("y") == y, 1 / s).otherwise(weight)
    chosen = lab.where(h < bound).groupBy("_ll_id").agg(F.max("y").alias("y")).withColumn("weight", weight)
    # the chosen labels are bounded by TRAIN_TOXIC + TRAIN_OTHER: a few hundred KB
    return df.join(F.broadcast(chosen), F.col(doc_id) == F.col("_ll_id")) \
             .select(F.coalesce(F.col(text), F.lit("")).alias("text"), "y", "weight")


def evidence(sample: DataFrame, documents: tuple[float, float], features: int) -> pd.DataFrame:
    """(bucket, toxic, other): document counts of the strongest buckets."""
    def count(batches):
        n = np.zeros((2, BUCKETS))
        docs = 0
        for b in batches:
            for t, y in zip(b["text"], b["y"]):
                n[y, present(letters(t))] += 1
                docs += 1
        if docs:
            yield pd.DataFrame({"chunk": np.arange(BUCKETS // CHUNK),
                                "other": list(n[0].reshape(-1, CHUNK).astype(np.float32)),
                                "toxic": list(n[1].reshape(-1, CHUNK).astype(np.float32))})

    all0, all1 = documents

    def strongest(chunk: pd.DataFrame) -> pd.DataFrame:
        other, toxic = (np.sum(np.stack(chunk[c].to_list()), axis=0, dtype=np.float64) for c in ("other", "toxic"))

        def part(seen, expected):
            return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

        either, n = other + toxic, all0 + all1
        g = 2 * sum(part(s, either * a / n) + part(a - s, (n - either) * a / n) for s, a in ((other, all0), (toxic, all1)))
        bucket = int(chunk["chunk"].iloc[0]) * CHUNK + np.arange(CHUNK)
        d = pd.DataFrame({"bucket": bucket, "toxic": toxic, "other": other, "g": g})
        return d[g >= EVIDENCE].nlargest(features, "g")

    chunks = sample.mapInPandas(count, "chunk int, other array<float>, toxic array<float>")
    return chunks.groupBy("chunk").applyInPandas(strongest, "bucket long, toxic double, other double, g double") \
                 .orderBy(F.desc("g"), "bucket").limit(features).toPandas()


class NbLinear:
    """Bias and the weight of each bucket (0 for those that take no part)."""

    def __init__(self, bias: float, bucket: np.ndarray, weight: np.ndarray):
        self.bias = bias
        self.row = np.full(BUCKETS, -1, np.int16 if len(bucket) < 1 << 15 else np.int32)
        self.row[bucket] = np.arange(len(bucket))
        self.weight = weight

    def rows(self, cps: np.ndarray) -> np.ndarray:
        """The distinct chosen features of a text; long texts go in parts that overlap."""
        found = []
        for a in range(0, len(cps), PART_CHARS):
            part = cps[a:a + PART_CHARS + max(SIZES) - 1]
            for s in SIZES:
                r = self.row[buckets(part, s)]
                found.append(r[r >= 0])
        return np.unique(np.concatenate(found))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.bias + self.weight[self.rows(letters(text))].sum()))))


def logistic(rows: list[np.ndarray], value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights (times value) of the penalised fit, by accelerated gradient steps."""
    doc, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows).astype(np.int64)
    x, w = value[col], np.zeros(len(value))
    weight = weight / weight.mean()
    share = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = bias + np.bincount(doc, x * w[col], len(rows))
        e = weight * (1 / (1 + np.exp(-z)) - y)
        g = (np.bincount(col, x * e[doc], len(w)) + PENALTY * w) / len(rows)
        gb = e.sum() / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - t / (STEPS + 1)))
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.99 ** t)) + 1e-8)
    return bias, w * value


def fit(df: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
        label: str = "toxic", features: int = FEATURES) -> NbLinear:
    sample = write_table(training_sample(df, labels, text, doc_id, label), "toxic-sample")
    n = {r["y"]: (float(r["n"]), float(r["w"])) for r in sample.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    (other, w0), (toxic, w1) = n.get(0, (0.0, 0.0)), n.get(1, (0.0, 0.0))
    prior = float(np.log((w1 + 1) / (w0 + 1)))
    ev = evidence(sample, (other, toxic), features) if toxic and other else None
    if ev is None or ev.empty:
        return NbLinear(prior, np.zeros(0, np.int64), np.zeros(0))
    p, q = ((ev[c].to_numpy() + SMOOTHING) / (a + 2 * SMOOTHING) for c, a in (("toxic", toxic), ("other", other)))
    bucket, ratio = ev["bucket"].to_numpy(), np.log(p / q)
    model = NbLinear(0.0, bucket, ratio)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def chosen(batches):
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "weight": b["weight"],
                                "rows": [shared.value.rows(letters(t)).astype(np.int32) for t in b["text"]]})

    # bounded by the sample: TRAIN_TOXIC + TRAIN_OTHER rows of at most FEATURES numbers
    got = sample.mapInPandas(chosen, "y int, weight double, rows array<int>").toPandas()
    got = got.assign(size=[len(r) for r in got["rows"]], sum=[int(np.sum(r)) for r in got["rows"]]) \
             .sort_values(["y", "size", "sum"])
    bias, weight = logistic([np.asarray(r) for r in got["rows"]], ratio,
                            got["y"].to_numpy(float), got["weight"].to_numpy())
    return NbLinear(bias, bucket, weight)


def classify(df: DataFrame, model: NbLinear, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` and ``predicted``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS small integers

    def predict(texts):
        score = np.array([shared.value.score(t) for t in texts], float)
        return score, (score >= threshold).astype(np.int32)

    return with_text_columns(df, text, "score double, predicted int", predict)


def op9_nb_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    out = classify(docs.select("doc_id", (fold() == HELD_OUT_FOLD).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
