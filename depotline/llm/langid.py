"""Language ID by prediction by partial matching (PPM, escape method C).

Per language, a byte context tree of orders 0 to ``ORDER`` holds how often
each byte followed each context in the training texts.  A byte c after a
context with total T and D distinct successors costs -log2(count(c) / (T + D))
bits; an unseen one costs the escape -log2(D / (T + D)) and is then coded in
the next shorter context, at last uniformly in 256.  The statistics are
frozen, so a text's code length under a language is an exact sum over its
bytes; the language with the shortest code wins.  Texts are lower-cased first
and start after ``ORDER`` line feeds.

The trees are fitted on a bounded sample: of the learning folds, about
``TRAIN_DOCS`` documents of each language, those with the smallest hashes.  A
text over ``TRAIN_BYTES`` bytes is learned from ``TRAIN_PIECES`` pieces spread
evenly over it, about ``TRAIN_BYTES`` together.  As statistics are frozen, the cost of
every known (context, byte) for every language is tabulated once; scoring
looks up each byte's longest known context.

* null text, or a text without letters: ``und``, score 0
* nothing to learn from: every prediction is ``und``
* score: the share of the winner's probability in that of all languages
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import HELD_OUT_FOLD, drop_table, fit_batches, fold, table, with_text_columns, write_table
from depotline.llm.keytable import KeyTable

ORDER = 4
TRAIN_DOCS = 400
TRAIN_TOTAL = 40_000  # documents of all languages; more than 100 languages have fewer each
TRAIN_BYTES = 32_768
TRAIN_PIECES = 8
CHUNK_BYTES = 1 << 17  # scored at once; the working arrays take some 100 times this
UNKNOWN = "und"


def gram_keys(data: np.ndarray, order: int) -> np.ndarray:
    """Key of (the ``order`` bytes before, the byte) for each byte from ORDER on.
    Non-zero: a leading 1 marks the length."""
    n = len(data) - ORDER
    key = np.full(n, 1, np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[ORDER - back:ORDER - back + n]
    return key


def as_bytes(text: str) -> bytes:
    return b"\n" * ORDER + text.lower().encode("utf-8", "replace")


def training_sample(df: DataFrame, text: str, lang: str, doc_id: str, train_docs: int,
                    train_bytes: int) -> DataFrame:
    """(lang, text) of about ``train_docs`` documents of each language; long ones in pieces."""
    d = df.where((fold(doc_id) != HELD_OUT_FOLD) & F.col(lang).isNotNull()
                 & (F.octet_length(text) > 0)) \
          .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                  F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30)).alias("h"))
    # one row per language, written so that the planner knows its size
    counts = write_table(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    each = max(1, min(train_docs, TRAIN_TOTAL // max(1, counts.count())))
    bound = F.floor(F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * (1 << 30))
    d = d.join(counts, "lang")
    return d.where(F.col("h") < bound).select("lang", F.explode(pieces("text", train_bytes)).alias("text"))


def pieces(text: str, most: int) -> Column:
    """The whole text, or of a longer one TRAIN_PIECES pieces of about ``most`` bytes
    together, the first at its start and the last at its end."""
    t, chars, size = F.col(text), F.char_length(text), F.octet_length(text)
    each = F.greatest((chars * F.lit(float(most)) / size / TRAIN_PIECES).cast("int"), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_PIECES - 1)), lambda k: F.substring(
        t, (k * ((chars - each) / (TRAIN_PIECES - 1))).cast("int") + 1, each))
    return F.when(size <= most, F.array(t)).otherwise(cut)


def with_letters(df: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text has a letter."""
    def letter(texts):
        return [[bool(t) and any(map(str.isalpha, t)) for t in texts]]
    return with_text_columns(df, text, "_ll_letter boolean", letter).where("_ll_letter").drop("_ll_letter")


def count_grams(sample: DataFrame) -> pd.DataFrame:
    """(lang, order, gram, n) over the sample."""
    def count(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                raw = [np.frombuffer(as_bytes(t), np.uint8) for t in texts]
                for o in range(ORDER + 1):
                    k, n = np.unique(np.concatenate([gram_keys(data, o) for data in raw]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram_order": o, "gram": k.astype(np.int64), "n": n})

    return sample.mapInPandas(count, "lang string, gram_order int, gram long, n long") \
                 .groupBy("lang", "gram_order", "gram").agg(F.sum("n").alias("n")).toPandas()


class Ppm:
    """The context trees of all languages as tables of costs in bits."""

    def __init__(self, grams: pd.DataFrame):
        self.langs = sorted(grams["lang"].unique())
        lang = grams["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        order, gram, n = (grams[c].to_numpy() for c in ("gram_order", "gram", "n"))
        self.cost, self.grams, self.escape, self.contexts = [], [], [], []
        width = len(self.langs)
        for o in range(ORDER + 1):
            own = order == o
            keys, at = np.unique(gram[own], return_inverse=True)
            count = np.zeros((len(keys), width))
            count[at, lang[own]] = n[own]
            contexts, ctx = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, ctx, count)
            np.add.at(distinct, ctx, count > 0)
            seen = total > 0
            escape = np.where(seen, -np.log2(np.where(seen, distinct, 1) / np.where(seen, total + distinct, 1)), 0.0)
            if o:
                # the same byte after the context less its first byte
                shorter = (keys & ((1 << 8 * o) - 1)) | (1 << 8 * o)
                below = self.cost[o - 1][self.grams[o - 1].find(shorter.astype(np.uint64))]
            else:
                below = np.full((len(keys), width), 8.0)
            hit = count > 0
            share = np.where(hit, count, 1) / np.where(seen, total + distinct, 1)[ctx]
            cost = np.where(hit, -np.log2(share), escape[ctx] + below)
            self.cost.append(cost)
            self.grams.append(KeyTable(keys.astype(np.uint64)))
            self.escape.append(escape)
            self.contexts.append(KeyTable(contexts.astype(np.uint64)))
        self.cost = [c.astype(np.float32) for c in self.cost]
        self.escape = [e.astype(np.float32) for e in self.escape]

    def byte_costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte from ORDER on, by language."""
        key = gram_keys(data, ORDER)
        row = self.grams[ORDER].find(key)
        out = self.cost[ORDER][row]
        miss = np.flatnonzero(row < 0)
        out[miss] = 0
        for o in range(ORDER, -1, -1):  # what is unseen escapes to ever shorter contexts
            if not len(miss):
                break
            k = (key[miss] & np.uint64((1 << 8 * (o + 1)) - 1)) | np.uint64(1 << 8 * (o + 1))
            if o < ORDER:
                row = self.grams[o].find(k)
                found = row >= 0
                out[miss[found]] += self.cost[o][row[found]]
                miss, k = miss[~found], k[~found]
            ctx = self.contexts[o].find(k >> np.uint64(8))
            known = ctx >= 0
            out[miss[known]] += self.escape[o][ctx[known]]
        out[miss] += 8.0
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text (not empty), by language."""
        out, raw = np.zeros((len(texts), len(self.langs))), [as_bytes(t) for t in texts]
        first = 0
        while first < len(raw):
            last, size = first, 0
            while last < len(raw) and (last == first or size + len(raw[last]) <= CHUNK_BYTES):
                size += len(raw[last])
                last += 1
            ends = np.cumsum([len(r) for r in raw[first:last]])
            whole = np.frombuffer(b"".join(raw[first:last]), np.uint8)
            # a text longer than a chunk is scored piece by piece, with its context before each
            for a in range(0, len(whole) - ORDER, CHUNK_BYTES):
                cost = self.byte_costs(whole[a:a + CHUNK_BYTES + ORDER])
                pos = np.arange(a + ORDER, a + ORDER + len(cost))
                doc = np.searchsorted(ends, pos, side="right")
                begin = np.r_[0, ends[:-1]][doc]
                cost[pos < begin + ORDER] = 0  # the line feeds before a text
                cut = np.flatnonzero(np.diff(doc, prepend=-1))
                out[first + doc[cut]] += np.add.reduceat(cost, cut, axis=0, dtype=np.float64)
            first = last
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        use = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        if use:
            bits = self.code_lengths([texts[i] for i in use])
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
            for i, b, s in zip(use, best, share):
                lang[i], score[i] = self.langs[b], s
        return lang, score


def fit(df: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
        train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Ppm:
    fit_batches(df.sparkSession)
    sample = write_table(training_sample(df, text, lang, doc_id, train_docs, train_bytes), "lang-sample")
    model = Ppm(count_grams(sample))
    drop_table(sample)
    return model


def identify(df: DataFrame, model: Ppm, *, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``."""
    fit_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    return with_text_columns(df, text, "lang_pred string, score double", lambda texts: shared.value.predict(texts))


def op3_ppm_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", (fold() == HELD_OUT_FOLD).alias("held_out"), "text"), fit(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
