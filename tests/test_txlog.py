"""Transaction-log parsing: record fields per letter, errors, blank-line end."""

import os

from depotline.sources.txlog import client_interleave, read_txlog


def _write(root, name, text):
    p = os.path.join(root, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_parse_each_letter(spark, tmpdir_path):
    _write(tmpdir_path, "0.txt", "\n".join([
        "N,1,2,3,2", "1,1,1", "1,1,1",
        "P,1,5,2817,3849.58",
        "D,1,2",
        "O,1,2,3",
        "S,1,2,3,4",
        "I,1,2,3",
        "T",
        "R,1,2,3"]))
    recs, errs = read_txlog(spark, tmpdir_path)
    rows = {r.txn_type: r for r in recs.collect()}
    assert errs.count() == 0
    n = rows["N"]
    assert (n.c_id, n.w_id, n.d_id, n.n_lines) == (1, 2, 3, 2)
    assert [(x.i_id, x.supply_w_id, x.qty) for x in n.lines] == [(1, 1, 1), (1, 1, 1)]
    p = rows["P"]
    assert (p.w_id, p.d_id, p.c_id, str(p.amount)) == (1, 5, 2817, "3849.58")
    assert (rows["D"].w_id, rows["D"].carrier_id) == (1, 2)
    assert (rows["O"].w_id, rows["O"].d_id, rows["O"].c_id) == (1, 2, 3)
    s = rows["S"]
    assert (s.w_id, s.d_id, s.threshold, s.last_l) == (1, 2, 3, 4)
    assert (rows["I"].w_id, rows["I"].d_id, rows["I"].last_l) == (1, 2, 3)
    assert "T" in rows
    assert (rows["R"].w_id, rows["R"].d_id, rows["R"].c_id) == (1, 2, 3)
    assert [r.record_no for r in sorted(rows.values(), key=lambda r: r.record_no)] == list(range(1, 9))


def test_errors_and_blank_line(spark, tmpdir_path):
    _write(tmpdir_path, "1.txt", "\n".join([
        "1,1,1",            # line before any header
        "P,1,5,2817",       # wrong arity
        "X,1,2",            # unknown letter
        "D,1,",             # empty field
        "N,1,1,1,2", "5,1,3",  # declares 2 lines, has 1
        "N,1,1,1,0",        # m = 0 is fine
        "O,1,1,1",
        "",                 # blank line ends the file
        "O,9,9,9"]))
    recs, errs = read_txlog(spark, tmpdir_path)
    reasons = sorted(r.reason for r in errs.collect())
    assert reasons == sorted(["line before first header", "wrong number of fields", "unknown record type",
                              "empty or non-numeric field", "wrong number of order lines"])
    ok = sorted((r.txn_type, r.w_id) for r in recs.collect())
    assert ok == [("N", 1), ("O", 1)]


def test_skip_and_interleave(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", "D,1,2\nO,1,1,1\nD,1,3")
    _write(tmpdir_path, "b.txt", "O,2,1,1\nO,2,1,2")
    recs, _ = read_txlog(spark, tmpdir_path, skip={"D"})
    assert sorted(r.txn_type for r in recs.collect()) == ["O", "O", "O"]
    recs, _ = read_txlog(spark, tmpdir_path)
    ords = sorted((r.ord, r.txn_type, r.w_id) for r in client_interleave(recs).collect())
    assert [o[0] for o in ords] == [2, 3, 4, 5, 6]


def test_order_survives_many_splits(spark, tmpdir_path):
    """One file read as many input splits: records are still numbered in file
    order and N lines stay with their header."""
    lines = []
    for k in range(300):
        lines += [f"N,{k},1,1,2", f"{k},1,1", f"{k + 1},1,2", f"P,1,1,{k},1.00"]
    _write(tmpdir_path, "big.txt", "\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        recs, errs = read_txlog(spark, tmpdir_path)
        rows = sorted(recs.collect(), key=lambda r: r.record_no)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert errs.count() == 0
    assert len(rows) == 600
    for k in range(300):
        n, p = rows[2 * k], rows[2 * k + 1]
        assert (n.txn_type, n.c_id, n.record_no) == ("N", k, 2 * k + 1)
        assert [(x.i_id, x.qty) for x in n.lines] == [(k, 1), (k + 1, 2)]
        assert (p.txn_type, p.c_id) == ("P", k)
