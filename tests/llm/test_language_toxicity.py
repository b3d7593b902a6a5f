import binascii
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from depotline.llm import langid, toxicity
from depotline.llm.common import BATCH_BYTES
from depotline.llm.keytable import KeyTable
from tests.llm.data import edge_rows, frame

SF = "/root/testdata/sf0.01"


def held_out(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_key_table():
    keys = np.unique(np.random.default_rng(0).integers(1, 1 << 62, 5000).astype(np.uint64))
    t = KeyTable(keys)
    assert (t.find(keys) == np.arange(len(keys))).all()
    assert (t.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (KeyTable(np.zeros(0, np.uint64)).find(keys) == -1).all()


def brute_bits(train, text):
    """Code length by walking from the longest context down, byte by byte."""
    seen = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    for t in train:
        b = langid.as_bytes(t)
        for i in range(langid.ORDER, len(b)):
            for o in range(langid.ORDER + 1):
                seen[o][b[i - o:i]][b[i]] += 1
    b, bits = langid.as_bytes(text), 0.0
    for i in range(langid.ORDER, len(b)):
        for o in range(langid.ORDER, -1, -1):
            c = seen[o].get(b[i - o:i])
            if c:
                total = sum(c.values()) + len(c)
                if b[i] in c:
                    bits -= math.log2(c[b[i]] / total)
                    break
                bits -= math.log2(len(c) / total)
        else:
            bits += 8
    return bits


def grams_of(texts_by_lang):
    rows = Counter()
    for lang, texts in texts_by_lang.items():
        for t in texts:
            data = np.frombuffer(langid.as_bytes(t), np.uint8).astype(np.uint64)
            for o in range(langid.ORDER + 1):
                for k in langid.gram_keys(data, o).tolist():
                    rows[lang, o, k] += 1
    return pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["lang", "gram_order", "gram", "n"])


def test_ppm_code_lengths(monkeypatch):
    train = {"aa": ["the cat sat on the mat", "a cat that sat"], "bb": ["der Hund und die Katze", "und die Maus"]}
    model = langid.Ppm(grams_of(train))
    texts = ["the dog sat", "und der Hund", "éé zebra", "x" * 50 + "the cat " * 30]
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(langid, "CHUNK_BYTES", chunk)
        got = model.code_lengths(texts)
        want = [[brute_bits(train[x], t) for x in ("aa", "bb")] for t in texts]
        assert np.allclose(got, want, atol=1e-3)


def test_ppm_memory_of_a_batch():
    langs = {x: [" ".join(f"{x}{i % 97}" for i in range(200))] for x in ("aa", "bb", "cc", "dd")}
    model = langid.Ppm(grams_of(langs))
    texts = [("aa7 bb8 cc9 été " * 100)] * 1_200  # about 2 MB
    tracemalloc.start()
    model.code_lengths(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts)) > 1.8e6 and peak < 32 << 20


def test_language_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = frame(spark, edge_rows())
    spark.conf.set(name, "64MB")
    model = langid.fit(df)
    assert spark.conf.get(name) == f"{BATCH_BYTES}b"
    spark.conf.set(name, "64MB")
    langid.identify(df, model)
    assert spark.conf.get(name) == f"{BATCH_BYTES}b"
    spark.conf.set(name, "64MB")


def test_language_query(spark):
    rows = langid.op3_ppm_language(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(docs)
    assert len(both) == len(docs) and (both.held_out == both.doc_id.map(held_out)).all()
    out = both[both.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def test_language_edges(spark):
    df = frame(spark, edge_rows())
    out = langid.identify(df, langid.fit(df))
    assert out.columns[-2:] == ["lang_pred", "score"] and "slot" in out.columns and out.columns.count("score") == 1
    for r in out.collect():
        assert (r["lang_pred"] == "und") == (not r["text"] or not any(map(str.isalpha, r["text"])))
    assert [r["doc_id"] for r in out.where("doc_id is null").collect()] == [None, None]
    nothing = frame(spark, [(1, "text", None)])
    assert langid.identify(nothing, langid.fit(nothing)).first()["lang_pred"] == "und"
    assert langid.identify(frame(spark, []), langid.fit(frame(spark, []))).count() == 0


def test_language_only_in_long_texts(spark):
    en, de = "the cat sat on the mat and saw the dog. ", "der Hund läuft über die Straße und sieht die Maus. "
    rows = [(i, en * 3, "en") for i in range(30)] + [(100 + i, "7 " * 30_000 + de * 2_000, "de") for i in range(8)]
    docs = frame(spark, rows)
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    assert model.predict(["die Maus sieht über die Straße", "the dog sat"])[0] == ["de", "en"]
    cut = langid.training_sample(docs, "text", "lang", "doc_id", 400, langid.TRAIN_BYTES).where("lang = 'de'")
    texts = [r["text"] for r in cut.collect()]
    n = sum(not held_out(d) for d, _, lang in rows if lang == "de")
    assert len(texts) == n * langid.TRAIN_PIECES and any("Maus" in t for t in texts) and any("7 7" in t for t in texts)
    assert sum(len(t.encode()) for t in texts) <= 1.1 * n * langid.TRAIN_BYTES


def test_toxicity_query(spark):
    rows = toxicity.op9_nb_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").toPandas()
    both = rows.merge(labels)
    assert len(rows) == 10_000 and (rows.held_out == rows.doc_id.map(held_out)).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    out = both[both.held_out]
    p = out.toxic == 1
    rank = out.score.rank()
    auc = (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())
    assert auc > 0.95 and (out.predicted[p] == 1).mean() > 0.8 and (out.predicted[~p] == 0).mean() > 0.97


def test_toxicity_long_text_in_parts(monkeypatch):
    model = toxicity.NbLinear(0.0, np.arange(0, toxicity.BUCKETS, 7), np.ones(len(range(0, toxicity.BUCKETS, 7))))
    cps = toxicity.letters("some words that repeat, and some that do not. " * 40)
    whole = model.rows(cps)
    monkeypatch.setattr(toxicity, "PART_CHARS", 13)
    assert (model.rows(cps) == whole).all()


@pytest.mark.parametrize("labels", [[], [(9, 1)], [(2, 0), (None, 1), (7, None)]])
def test_toxicity_edges(spark, labels):
    df = frame(spark, edge_rows())
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.classify(df, toxicity.fit(df, lab)).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out}) == 1
    assert toxicity.classify(frame(spark, []), toxicity.fit(df, lab)).count() == 0


def test_two_thousand_languages(spark):
    """One language a document, and more than a plan could hold as nested conditions."""
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 3}{chr(97 + i // 676 % 26) * 3}", f"l{i:04d}", "a") for i in range(2000)]
    sample = langid.training_sample(frame(spark, rows), "text", "lang", "doc_id", 400, 32_768)
    learned = [r for r in rows if binascii.crc32(str(r[0]).encode()) % 4 != 2]
    assert sorted((r["lang"], r["text"]) for r in sample.collect()) == sorted((r[2], r[1]) for r in learned)


def _grams(text):
    t = f" {text or ''} ".lower()
    return {t[i:i + n] for n in toxicity.SIZES for i in range(len(t) - n + 1)}


def test_toxicity_against_brute_force(spark):
    """Document counts, log-count ratios and scores worked out from plain n-gram sets of every text."""
    rude, kind = ["you utter fool", "shut up fool", "stupid fool", "go away stupid"], ["a fine day", "we saw the sea", "the tea is warm", "see you there"]
    rows, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        rows.append((i, f"{(rude if toxic else kind)[i % 4]} {kind[i % 3]} n{i % 17}"))
        labels.append((i, int(toxic)))
    rows += [(500, None), (501, ""), (502, "nothing of the kind"), (503, "STUPID FOOL")]
    df, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    texts, learned = dict(rows), [(i, y) for i, y in labels if not held_out(i)]
    n = [sum(y == k for _, y in learned) for k in (0, 1)]
    counts = {}
    for i, y in learned:
        for g in _grams(texts[i]):
            counts.setdefault(g, [0, 0])[y] += 1

    def bucket(g):
        return int(toxicity.buckets(toxicity.letters(g)[1:-1], len(g))[0])
    by_bucket = {}
    for g in counts:
        by_bucket.setdefault(bucket(g), []).append(g)

    def strength(c):
        total, seen, g = sum(n), sum(c), 0.0
        for k in (0, 1):
            for got, expected in ((c[k], seen * n[k] / total), (n[k] - c[k], (total - seen) * n[k] / total)):
                g += 2 * got * np.log(got / expected) if got else 0.0
        return g
    assert all(len(gs) == 1 for gs in by_bucket.values())  # no two n-grams share a bucket here
    strong = {bucket(g): c for g, c in counts.items() if strength(c) >= toxicity.EVIDENCE}
    chosen = np.flatnonzero(model.row >= 0)
    assert len(strong) > 20 and set(map(int, chosen)) == set(strong)
    order = chosen[np.argsort(model.row[chosen])]
    ratio = np.array([np.log((strong[int(b)][1] + 1) / (n[1] + 2)) - np.log((strong[int(b)][0] + 1) / (n[0] + 2)) for b in order])
    # the fit: no better point near the weights under the penalised loss (weights over ratios)
    w = np.where(np.abs(ratio) > 1e-12, model.weight / ratio, 0.0)
    place = {int(b): k for k, b in enumerate(order)}
    held = [sorted({place[bucket(g)] for g in _grams(texts[i]) if bucket(g) in place}) for i, _ in learned]
    y = np.array([k for _, k in learned], float)

    def loss(bias, w):
        z = np.array([bias + sum(ratio[j] * w[j] for j in r) for r in held])
        return (np.logaddexp(0, z) - y * z).sum() + toxicity.PENALTY / 2 * (w ** 2).sum()
    here, start = loss(model.bias, w), loss(np.log(n[1] / n[0]), np.zeros(len(w)))
    assert here < 0.5 * start
    r = np.random.default_rng(0)
    assert all(loss(model.bias + 0.3 * r.normal(), w + 0.1 * r.normal(size=len(w))) > here for _ in range(20))
    # the scores: bias and weights of the text's own n-grams
    weight = dict(zip(map(int, order), model.weight))
    for got in toxicity.classify(df, model).collect():
        z = model.bias + sum(weight.get(bucket(g), 0.0) for g in _grams(texts[got["doc_id"]]))
        assert abs(got["score"] - 1 / (1 + np.exp(-z))) < 1e-9
        assert got["predicted"] == int(got["score"] >= toxicity.THRESHOLD)
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(df, model).collect()}
    assert scores[503] > 0.5 > scores[502]
