import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depotline.llm.common import BATCH_BYTES, fit_batches
from depotline.llm.components import components
from depotline.llm.ngram_join import keep_one, near_duplicates, op7_grouped_prefix_join, wanted_sets
from depotline.llm.shingles import shingle_sets
from tests.llm.data import edge_rows, frame, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (d, a) in enumerate(sets):
        for j, (e, b) in enumerate(sets[:i]):
            if None not in (d, e) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted([(d, len(s), None if d is None else low[find(i)]) for i, (d, s) in enumerate(sets)], key=str)


def result(spark, rows):
    got = near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    return sorted([tuple(r) for r in got], key=str)


def corpus(seed):
    """Copies, near copies around the threshold, chains, and passages that many share."""
    r, rows = random.Random(seed), []
    passage = words(99, 40)
    for family in range(12):
        base = words(1000 * seed + family, r.randrange(6, 120))
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, max(1, len(w) // 12) + 1)):
                w[r.randrange(len(w))] = f"v{r.randrange(50)}"
            if r.random() < 0.2:
                w = w[:-r.randrange(1, 5)] or w
            if r.random() < 0.3:
                w = passage + w
            rows.append(" ".join(w).title() if r.random() < 0.2 else " ".join(w))
        chain = words(7_000 * seed + family, 60)
        for k in range(6):  # each link drops what the one before had first
            rows.append(" ".join(chain[3 * k:] + words(50 * family + k, 3 * k)))
    r.shuffle(rows)
    ids = r.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def test_against_all_pairs(spark):
    for seed in (1, 2, 3):
        rows = corpus(seed)
        assert result(spark, rows) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    r, base = random.Random(5), words(5, 90)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 5)):
            w[r.randrange(len(w))] = f"z{r.randrange(400)}"
        rows.append((i, " ".join(w)))
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [r[:2] for r in edge_rows()]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    same_id = [(1, "a b c d e f g h"), (1, "q r s t u v w x y"), (2, "q r s t u v w x y"), (3, "a b c d e f g h")]
    assert result(spark, same_id) == brute(same_id)


def test_keep_one(spark):
    rows = corpus(4) + [(5_000, ""), (5_001, None), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    stay = {d for d, _, c in brute(rows) if d is not None and d == c}
    out = keep_one(frame(spark, rows))
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").collect()) == sorted(stay)
    assert out.where("doc_id is null").count() == 2 and out.columns == frame(spark, []).columns
    # rows of one id that aren't linked are documents of their own; exact repeats are not
    assert sorted(r["text"] for r in keep_one(frame(spark, [(9, "b"), (9, "b"), (9, "a")])).collect()) == ["a", "b"]


def test_shared_ids_lose_no_unlike_text(spark):
    long = [" ".join(words(s, 60)) for s in (1, 2, 3)]
    rows = [(1, long[0]), (1, long[1]), (2, long[2]), (3, long[1] + " more"), (4, long[0]), (5, "  "), (5, "  "), (6, None)]
    got = sorted((r["doc_id"], r["text"] or "") for r in keep_one(frame(spark, rows)).collect())
    assert got == sorted([(1, long[0]), (1, long[1]), (2, long[2]), (5, "  "), (5, "  "), (6, "")])


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r)[:3] for r in op7_grouped_prefix_join(spark, sf).collect()], key=str)
    assert got == brute(rows)


def test_shingle_counts_across_chunks(monkeypatch):
    texts = [t for _, t in corpus(6)] + ["", None, "É é é x y z", " \n"]
    monkeypatch.setattr("depotline.llm.shingles.CHUNK_BYTES", 512)
    got = [s for _, sets in shingle_sets(texts, 5) for s in sets]
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    ids = {}
    for s, t in zip(got, texts):  # equal shingles have equal hashes, others different ones
        assert len(np.unique(s)) == len(s)
        for key in shingles(t):
            ids.setdefault(key, 0)
    assert len(np.unique(np.concatenate(got))) == len(ids)


def test_components_of_chains_and_stars(spark):
    r = random.Random(3)
    nodes = list(range(200))
    r.shuffle(nodes)
    links = list(zip(nodes[:60], nodes[1:61])) + [(nodes[100], n) for n in nodes[101:150]] + [(-5, -9), (-9, -7)]
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    chain, star = nodes[:61], nodes[100:150]
    want = {n: min(chain) for n in chain} | {n: min(star) for n in star} | dict.fromkeys((-5, -9, -7), -9)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_batches_to_the_workers_are_bounded(spark):
    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    long_rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 18).alias("t"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
    near_duplicates(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert max(r["n"] for r in long_rows.mapInArrow(held, "n long").collect()) <= BATCH_BYTES // (1 << 18) + 1
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1KB")  # batches never get larger
    fit_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1KB"
    result(spark, edge_rows())  # batches of single rows give the same
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")


def test_one_python_worker_a_task(spark):
    """Between two Python steps of the kept sets there is a shuffle, even if the ids could be broadcast."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "a b")], "id long, text string")
    kept = spark.createDataFrame([(1, 7, 2), (2, 7, 2)], "id long, h long, n long")
    found = wanted_sets(docs, kept, 5)
    steps = re.findall(r"MapInArrow|Exchange hashpartitioning", found._jdf.queryExecution().executedPlan().toString())
    assert steps.count("MapInArrow") == 2
    assert "Exchange hashpartitioning" in steps[steps.index("MapInArrow") + 1:len(steps) - steps[::-1].index("MapInArrow")]
    assert sorted((r["id"], r["n"]) for r in found.collect()) == [(1, 2), (2, 2)]
