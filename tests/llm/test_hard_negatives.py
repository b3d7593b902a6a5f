import math

import numpy as np
import pytest

from depotline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, slot string, id string, key string, score string"


def usable(i, v, y):
    return i is not None and v is not None and y is not None and None not in v and all(map(math.isfinite, v)) and len(v) > 0


def brute(rows, is_anchor, positives, negatives):
    use = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if usable(i, v, y)}
    n = [len(v) for _, _, v in use]
    width = max(set(n), key=lambda x: (n.count(x), x)) if n else 0
    use = [r for r in use if len(r[2]) == width]
    out = []
    for a, y, v in use:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * z for x, z in zip(v, w)), i, z) for i, z, w in use if i != a)
        for p, pid, z in [r for r in scored if r[2] == y][:positives]:
            some = [r for r in scored if r[2] != y and 50 * -p <= 100 * -r[0] <= 95 * -p][:negatives]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(some)]
    return sorted(out)


def check(spark, rows, step=5, positives=3, negatives=2):
    df = spark.createDataFrame([(i, v, y, "a", "b", "c", "d") for i, v, y in rows], SCHEMA)
    got = hn.mine(df, hn.F.col("id") % step == 0, positives=positives, negatives=negatives)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == brute(rows, lambda i: i % step == 0, positives, negatives)
    return got


def made(seed, n, dims=12, labels=3, scale=0.3):
    r = np.random.default_rng(seed)
    centre = r.standard_normal(dims)
    return [(i, [float(x) for x in centre * 0.2 + scale * r.standard_normal(dims)], int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("size", [1.0, 3.0e3, 2.0e7])
def test_inner_products_are_exact(size):
    r = np.random.default_rng(7)
    for m, n, dims in [(1, 1, 1), (5, 33, 17), (3, 8, 64), (0, 4, 3), (4, 0, 3)]:
        a, c = (np.floor(size * 256 * r.standard_normal((k, dims))) for k in (m, n))
        want = [[sum(int(x) * int(z) for x, z in zip(p, q)) for q in c] for p in a]
        if want and want[0] and max(abs(x) for w in want for x in w) >= 1 << 63:
            continue
        assert hn.inner_products(a, c).tolist() == (want if n else [[] for _ in want])


def test_fields_share_one_integer():
    a, c = np.ones((2, 4)), np.ones((9, 4))
    assert hn.EXACT_BITS // hn.field_bits(a, c) > 1


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 16)
    monkeypatch.setattr(hn, "ANCHOR_ROWS", 7)
    assert check(spark, made(1, 240))


def test_many_anchor_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_VALUES", 60)
    assert check(spark, made(2, 90, dims=6))


def test_ties_repeats_and_hot_vector(spark):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(40)] + [(i, [0.4, 0.2], 1 - i % 2) for i in range(40, 60)]
    assert check(spark, rows + rows[:10] + [(10, [0.1, 0.1], 0)])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 2.9], 1), (2, [0.9, 1.9, 2.0], 0), (None, [1.0, 2.0, 3.0], 0),
            (3, None, 0), (4, [1.0, None, 3.0], 0), (5, [nan, 1.0, 1.0], 1), (10, [inf, 1.0, 1.0], 1), (6, [1.0, 2.0, 2.5], None),
            (7, [1.0, 2.0], 0), (8, [0.0, 0.0, 0.0], 0), (15, [0.0, 0.0, 0.0], 0), (9, [-1.0, -2.0, -3.0], 0), (20, [], 1),
            (11, [3.0e6, 1.0, 1.0], 1), (12, [2.0e6, 1.0, 1.0], 0), (25, [3.1e6, 1.0, 1.0], 1)]
    assert check(spark, rows)
    assert check(spark, []) == []
    assert check(spark, [(5, [1.0], 2)]) == []
