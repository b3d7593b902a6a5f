import hashlib
from collections import defaultdict

from depotline.llm.line_dedup import drop_common_lines, op2_line_dedup
from tests.llm.data import edge_rows, frame

WHITE = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least):
    docs = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            docs[x.strip(WHITE).translate(LOW)].add((d, t))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (k := x.strip(WHITE).translate(LOW)) or len(docs[k]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(i, f"Head {i % 3}\n  COMMON É line\t\nown {i}\n\ncommon É LINE") for i in range(12)]
    rows += [(100, "common é line"), (101, None), (102, "head 0"), (None, "common É line\n\n"), (103, "\n\n"),
             (104, "common É line")]
    got = drop_common_lines(frame(spark, rows), min_docs=5).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, 5)


def test_edges_and_extra_columns(spark):
    rows = [r[:2] for r in edge_rows()]
    out = drop_common_lines(frame(spark, edge_rows()), min_docs=2)
    assert {"score", "slot", "h"} <= set(out.columns)
    got = sorted([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str)
    assert got == brute(rows, 2)


def test_many_dropped_lines_in_one_document(spark):
    rows = [(i, "\n".join(f"l{k}" for k in range(20_000))) for i in range(2)]
    got = drop_common_lines(frame(spark, rows), min_docs=2).collect()
    assert all(r["n_dropped"] == 20_000 and r["text"] == "" for r in got)


def test_empty_table(spark):
    assert drop_common_lines(frame(spark, [])).count() == 0


def test_query_columns(spark):
    out = op2_line_dedup(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert all(len(r[3]) == len(hashlib.sha256().hexdigest()) for r in out.limit(3).collect())
