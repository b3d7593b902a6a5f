"""W1s, P2: the stock rule outside the closed form, against the step rule."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from depotline.operators import writes

SCHEMA = "supply_w_id int, i_id long, ord long, ol_number int, qty int, s_quantity int"


def _steps(q, draws):
    out = []
    for x in draws:
        b, q = q, q - x + 100 if q - x < 10 else q - x
        out.append((b, q))
    return out


def _check(spark, keys):
    """``keys``: {item: (start, draws)}; two draws share a record, in line order."""
    rows, expected = [], {}
    for i, (q0, draws) in keys.items():
        for n, (x, res) in enumerate(zip(draws, _steps(q0, draws))):
            rows.append((1, i, 10 + n // 2, 1 + n % 2, x, q0))
            expected[(i, 10 + n // 2, 1 + n % 2)] = res
    random.Random(1).shuffle(rows)
    out = writes.stock_fallback(spark.createDataFrame(rows, SCHEMA))
    got = {(r.i_id, r.ord, r.ol_number): (r._before, r._after) for r in out.select("i_id", "ord", "ol_number", "_before", "_after").collect()}
    assert got == expected


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-300, 300), st.lists(st.integers(-100, 500), min_size=1, max_size=60)), min_size=1, max_size=20))
def test_any_draws(spark, monkeypatch, keys):
    monkeypatch.setattr(writes, "STOCK_BLOCK", 8)  # many blocks in short lists
    _check(spark, dict(enumerate(keys)))


def test_many_blocks_of_one_key(spark):
    """Draws that keep a key in deficit, at the floor, far above it, and mixtures."""
    rnd = random.Random(7)
    keys = {
        1: (20, [rnd.randint(-100, 500) for _ in range(3000)]),
        2: (50, [rnd.randint(1, 199) for _ in range(3000)]),   # about one refill a draw: limits in between count
        3: (5, [rnd.choice([-60, 90, 110]) for _ in range(2000)]),
        4: (10, [500] * 600 + [-100] * 2500),
        5: (99, [3] * 700)}
    _check(spark, keys)


def test_no_draws(spark):
    assert writes.stock_fallback(spark.createDataFrame([], SCHEMA)).count() == 0
