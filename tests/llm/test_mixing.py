import time
from collections import Counter

import pytest

from depotline.llm.mixing import BLOCK_DOCS, given_weights, mix, root_weights, schedule_frame
from tests.llm.data import edge_rows, frame


def earliest_deadline_first(quotas):
    """Slot by slot: the released block with the earliest deadline."""
    size, done, out = sum(quotas.values()), Counter(), []
    for t in range(size):
        due = [(-(-(done[s] + 1) * size // a), s) for s, a in sorted(quotas.items())
               if done[s] < a and done[s] * size // a <= t]
        s = min(due)[1]
        done[s] += 1
        out.append(s)
    return out


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 1, "b": 1, "c": 1}, {"a": 5, "b": 3, "c": 1, "d": 0.2}])
def test_frame_is_edf_and_stays_within_a_block(spark, weights):
    df = frame(spark, [(i, "x", "en", s) for i, s in enumerate(weights)])
    rows = schedule_frame(given_weights(df, weights, slots=60)).collect()
    quotas = {r["_ll_src"]: r["_ll_quota"] for r in rows}
    order = earliest_deadline_first(quotas)
    assert {r["_ll_src"]: r["_ll_slots"] for r in rows} == \
        {s: [t for t, x in enumerate(order) if x == s] for s in quotas}
    seen = Counter()
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * a / len(order)) < 1 for x, a in quotas.items())


def test_mix_keeps_all_and_follows_weights(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small") for i in range(900)]
    out = mix(frame(spark, rows), given_weights(frame(spark, rows), {"big": 3, "small": 1}, slots=4)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900))
    by = sorted(out, key=lambda r: (r["slot"], r["place"]))
    assert len({(r["slot"], r["place"]) for r in out}) == 900 and {r["place"] for r in out} == set(range(BLOCK_DOCS))
    blocks = [r["source"] for r in by if r["place"] == 0]
    small = 300 // BLOCK_DOCS
    for t in range(1, min(4 * small, len(blocks)) - 4):
        if blocks[:t].count("big") < 600 // BLOCK_DOCS:  # until a source ends
            assert abs(blocks[:t].count("small") - t / 4) < 1


def test_edges(spark):
    df = frame(spark, edge_rows())
    out = mix(df).collect()
    assert len(out) == len(edge_rows()) and len({(r["slot"], r["place"]) for r in out}) == len(out)
    assert {r["source"] for r in out} == {"a", "b", "c", None}
    assert "score" in mix(df).columns and mix(df).columns.count("slot") == 1
    assert mix(frame(spark, [])).count() == 0


def test_many_sources_of_one_block(spark):
    """The same as scheduling every source, and twenty thousand of them in seconds."""
    weights = {"m1": 6, "b": 3, "x": 2, **{f"{c}{i}": 0.01 for i in range(5) for c in "anz"}}
    rows = schedule_frame(given_weights(frame(spark, [(i, "x", "en", s) for i, s in enumerate(weights)]), weights, slots=20)).collect()
    order = earliest_deadline_first({r["_ll_src"]: r["_ll_quota"] for r in rows})
    assert {r["_ll_src"]: r["_ll_slots"] for r in rows} == {
        r["_ll_src"]: [t for t, s in enumerate(order) if s == r["_ll_src"]] for r in rows}
    many = spark.range(20_000).selectExpr("concat('s', id) as _ll_src", "if(id % 2000 = 7, 25, 1) as _ll_quota")
    began = time.time()
    slots = sorted(t for r in schedule_frame(many).collect() for t in r["_ll_slots"])
    assert slots == list(range(20_000 + 24 * 10)) and time.time() - began < 60


def test_many_weights(spark):
    df = spark.range(700).selectExpr("concat('w', id) as source")
    got = given_weights(df, {f"w{i}": 1.0 for i in range(600)}, slots=1200).collect()
    assert len(got) == 700 and sum(r["_ll_quota"] for r in got) == 1300
