import math
import random
from collections import Counter

import numpy as np
import pytest

from depotline.llm import lexical_search as ls
from depotline.llm.terms import words
from tests.llm.data import edge_rows, frame

QUERIES = "item_id long, text string, rank string, score string"


def brute(rows, queries, k):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in ((r[0], r[1]) for r in rows) if words(t)]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in set(queries):
        scored = []
        for i, c, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
                    for w, q in Counter(words(text)).items() if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def check(spark, rows, queries, k=5):
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in queries], QUERIES)
    got = ls.search(frame(spark, rows), asked, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == brute(rows, queries, k)
    return got


def made(seed, n, vocabulary=60, topics=5):
    r = random.Random(seed)
    names = [f"t{i}" for i in range(vocabulary)]
    rows = []
    for d in range(n):
        own = names[r.randrange(topics)::topics]
        rows.append((d, " ".join(r.choice(own if r.random() < 0.7 else names) for _ in range(r.randrange(1, 40)))))
    queries = [(q, " ".join(r.choices(names + ["absent"], k=r.randrange(1, 12)))) for q in range(8)]
    return rows, queries


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_DOCS", 3)
    monkeypatch.setattr(ls, "COORDS", 4)


def test_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(ls, "SHARD_CELLS", 64)
    assert check(spark, *made(1, 300))


def test_many_query_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(ls, "QUERY_BYTES", 60)
    assert check(spark, *made(2, 80))


def test_ties_and_copies(spark, small):
    rows = [(i, "same words in all of these") for i in range(40)] + [(7, "same words in all of these")] + [(100, "other words")]
    assert check(spark, rows, [(1, "same WORDS"), (1, "same WORDS"), (2, "these"), (3, "other same")])


def test_edges(spark):
    queries = [(1, "the cat"), (2, None), (3, ""), (4, "?!"), (None, "short words"), (5, "你好 über"), (5, "twice twice row"),
               (6, "nothing at hand ever"), (7, " ".join(f"w{i}" for i in range(3000)))]
    assert check(spark, edge_rows(), queries)
    assert check(spark, edge_rows(), []) == []
    assert check(spark, [], queries) == []


def test_skips_blocks_and_keeps_the_best():
    """Whole blocks are left out, and the results are those of scoring every row."""
    r = np.random.default_rng(3)
    topic = np.arange(2000) // 100
    x = np.zeros((2000, 40), np.int32)
    for t in range(40):
        likely = np.where(topic == t % 20, 0.8, 0.05)
        x[:, t] = np.where(r.random(2000) < likely, r.integers(300_000, 900_000, 2000), 0)
    asked = [Counter([b"a%02d" % i for i in r.choice(40, 5, replace=False)]) for _ in range(10)] + [Counter({b"a03": 1, b"a23": 2})]
    queries = ls.Queries(asked, [b"a%02d" % i for i in range(40)], (x > 0).sum(axis=0), 2000, 100_000)
    x = x[:, np.argsort(queries.rank)]
    lists = ls.Lists(ls.build_lists(0, x, queries))
    scored = 0
    for terms, weight in zip(queries.terms, queries.weights):
        docs, score, n = ls.search_shard(x, np.arange(2000), lists, terms, weight, 10, x.max(axis=0).astype(np.int64))
        every = x[:, terms] @ weight
        want = np.lexsort((np.arange(2000), -every))[:10]
        assert docs.tolist() == want.tolist() and score.tolist() == every[want].tolist()
        scored += n / ((every > 0).sum() * len(asked))
    assert scored < 0.9


def test_summaries_are_the_largest_impacts():
    x = np.random.default_rng(5).integers(0, 1000, (500, 6)).astype(np.int32) * (np.random.default_rng(6).random((500, 6)) < 0.5)
    queries = ls.Queries([Counter([b"%d" % i for i in range(6)])], [b"%d" % i for i in range(6)], (x > 0).sum(axis=0), 500, 9000)
    lists = ls.Lists(ls.build_lists(0, x, queries))
    for t in queries.coords:
        docs, first, end, coords, maxima = lists.blocks(t)
        assert sorted(docs) == np.flatnonzero(x[:, t]).tolist() and len(first) > 1
        for b in range(len(first)):
            assert (maxima[b] == x[docs[first[b]:end[b]]][:, coords].max(axis=0)).all()
