import random
import re

import pytest

from depotline.llm import decontamination as dc
from depotline.llm.terms import positions, words
from tests.llm.data import edge_rows, frame

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, n_words string, items string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window):
    ws, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        q = WORD.findall(lower(t))
        if item is None:
            continue
        for k in range(max(1, len(q) - window + 1) if q else 0):
            part = q[k:k + window]
            for a in range(len(ws) - len(part) + 1):
                if ws[a:a + len(part)] == part:
                    hit.update(range(a, a + len(part)))
                    found.add(str(item))
    return len(ws), len(hit), sorted(found)


def check(spark, rows, items, window=4):
    docs = frame(spark, rows)
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    out = dc.find_leaks(docs, asked, window=window)
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=repr)
    want = sorted(((r[0], r[1], *brute(r[1], items, window)) for r in rows), key=repr)
    assert got == want
    for r in out.where("n_hit > 0").collect():  # the spans hold the hit words and begin and end with words
        inside = [r.text[s.start:s.end] for s in r.spans]
        assert sum(len(words(x)) for x in inside) == r.n_hit
        starts, ends = zip(*positions(r.text))
        assert all(s.start in starts and s.end in ends for s in r.spans)
    return out


def planted(seed, n_docs=60):
    r = random.Random(seed)
    vocabulary = ["a", "b", "Ä", "c9", "naïve", "x"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randrange(0, 12)))) for k in range(12)]
    rows = []
    for d in range(n_docs):
        parts = [r.choice(vocabulary + ["other", "A", "B!"]) for _ in range(r.randrange(0, 60))]
        parts.insert(len(parts) // 2, r.choice(items)[1].upper().replace(" ", r.choice([" ", "\n", " - ", "._"])))
        rows.append((d, " ".join(parts)))
    return rows, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, *planted(seed))


def test_many_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 20)
    monkeypatch.setattr(dc, "PIECE_WORDS", 6)
    monkeypatch.setattr(dc, "DIGIT", 2)
    check(spark, *planted(3))


def test_edges(spark):
    items = [(1, "the cat THE cat the"), (1, "short"), (2, None), (3, ""), (4, "...!?"), (None, "same row"),
             (5, "words again here"), (5, "words again here"), (10, "你好")]
    check(spark, edge_rows(), items)
    check(spark, edge_rows(), [])
    assert check(spark, [], items).count() == 0


def test_long_text_is_read_to_its_end(spark):
    q = " ".join(f"q{k}" for k in range(12))
    out = check(spark, [(1, "w " * 300_000 + q), (2, q + " w" * 10)], [(7, q)], window=10)
    assert [r.n_hit for r in out.orderBy("doc_id").collect()] == [12, 12]


def test_query_columns(spark):
    from tests.conftest import SF_SMALL
    df = dc.op12_leak_windows(spark, SF_SMALL)
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert df.where("contaminated != (n_items > 0)").count() == 0
