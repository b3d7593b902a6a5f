import hashlib
import re

from pyspark.sql import functions as F

from depotline.llm.spotsigs import (ANCHORS, CHAIN, SPAN, edited_likeness, fingerprint, op1_spotsigs, signatures,
                                    similar_pairs)
from tests.llm.data import edge_rows, frame, words


def brute(text):
    """The signature set, word by word."""
    if not text:
        return []
    plain = " ".join(re.findall(r"[^\W_]+", text.lower()))
    w, out = plain.split(" "), set()
    for i, a in enumerate(w):
        if a in ANCHORS:
            chain = [x for x in w[i + 1:i + 1 + SPAN] if x not in ANCHORS][:CHAIN]
            if len(chain) == CHAIN:
                out.add(":".join([a, *chain]))
    return sorted(hashlib.md5(s.encode()).hexdigest()[:8] for s in out or {plain or text})


def jaccard(a, b):
    return 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))


def prose(seed, n=60):
    out = []
    for k, w in enumerate(words(seed, n)):
        out += [("the", "of", "and", "to the", "a")[k % 5]] * (k % 2) + [w]
    return " ".join(out)


def rows():
    base = [(d, t) for d, t, *_ in edge_rows()]
    return base + [(100 + i, prose(i)) for i in range(8)] + [(200, prose(1)), (201, prose(2)[:-9] + "the end of it all")]


def test_signatures(spark):
    df = frame(spark, rows())
    got = df.selectExpr("coalesce(text, '') as t").select("t", fingerprint(signatures(F.col("t"))).alias("f")).collect()
    for r in got:
        assert r["f"] == " ".join(sorted(set(brute(r["t"]))))


def test_edited_texts(spark):
    given = {d: t or "" for d, t in rows() if d is not None and d != 9}
    got = {r["doc_id"]: r for r in edited_likeness(frame(spark, list(given.items()))).collect()}
    ids = sorted(given, reverse=True)
    for k, d in enumerate(ids):
        text, after = given[d], given[ids[(k + 1) % len(ids)]]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r, a, b = got[d], brute(text), brute(edited)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(a) and r["edited_fingerprint"] == " ".join(b)
        assert abs(r["near_edited"] - jaccard(a, b)) < 1e-12 and abs(r["near_next"] - jaccard(a, brute(after))) < 1e-12


def test_edges(spark):
    out = edited_likeness(frame(spark, rows())).collect()
    assert len(out) == len(rows())
    lone = [r for r in out if r["doc_id"] is None]
    assert len(lone) == 2 and all(r["near_next"] == 0 for r in lone)
    twice = [r for r in out if r["doc_id"] == 9]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert edited_likeness(frame(spark, [])).count() == 0
    one = edited_likeness(frame(spark, [(5, "the cat sat on the mat")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert all(0 <= r["near_edited"] <= 1 for r in op1_spotsigs(spark, "/root/testdata/sf0.001").collect())


def test_similar_pairs(spark):
    docs = [(i, prose(i % 20)) for i in range(30)]
    docs += [(100 + i, prose(i) + " " + " ".join(words(900 + i, i))) for i in range(20)] + [(300, ""), (301, None)]
    pairs, members = similar_pairs(frame(spark, docs), threshold=0.7)
    of = {}
    for r in members.collect():
        of.setdefault(r["class"], set()).add(r["doc_id"])
    text = dict(docs)
    reps = {c: brute(text[min(m)]) for c, m in of.items()}
    assert all(brute(text[d]) == reps[c] for c, m in of.items() for d in m) and sum(map(len, of.values())) == 50
    want = {(min(a, b), max(a, b)) for a in reps for b in reps if a < b and jaccard(reps[a], reps[b]) >= 0.7}
    got = {(r["a"], r["b"]): r["likeness"] for r in pairs.collect()}
    assert set(got) == want and all(abs(v - jaccard(reps[a], reps[b])) < 1e-12 for (a, b), v in got.items())
