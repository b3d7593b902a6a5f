import struct
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from depotline.llm.common import scratch_dir, table
from depotline.llm.packing import default_tokenizer, op6_sum_of_squares_packing, pack_documents, sum_of_squares
from depotline.llm.token_files import read_dictionary, read_documents, scan_token_files, write_token_files
from depotline.llm.tokens import PieceIds, word_ids
from tests.llm.data import edge_rows, frame, words


def library(text):
    return word_ids(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


def as_bytes(ids):
    return np.asarray(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tabcXYZéÉß's.,!|0123́Σİ\x1c\x85  <|>你\U0001f600")), max_size=60))
def test_word_cache_equals_library(text):
    ids = word_ids(default_tokenizer())
    assert ids.by_pieces and ids.text(text) == as_bytes(library(text))
    assert of_batch(ids, [text, None, text]) == [as_bytes(library(text)), b"", as_bytes(library(text))]


def of_batch(ids, texts):
    return [flat[a:b].tobytes() for flat, ends in ids.texts(pa.array(texts, pa.string())) for a, b in zip(ends[:-1], ends[1:])]


def test_word_cache_on_given_texts_and_when_full(spark, monkeypatch):
    monkeypatch.setattr("depotline.llm.tokens.GENERATION", 100)
    monkeypatch.setattr("depotline.llm.tokens.CHUNK_BYTES", 5_000)
    ids = PieceIds(default_tokenizer())
    texts = [r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents", "text").collect()] + ["<|endoftext|> x"]
    assert of_batch(ids, texts) == [as_bytes(library(t)) for t in texts]
    assert [ids.text(t) for t in texts] == [as_bytes(library(t)) for t in texts]


def test_vocabulary_with_another_pre_tokeniser():
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = PieceIds(path)
    texts = ["It's  a Test, 123 days", "naïve\nwords", ""]
    assert not ids.by_pieces
    assert of_batch(ids, texts) == [as_bytes(ids.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(0, 1))
def test_sum_of_squares_choice(lengths, desc):
    """Every placement is the one that brute force finds best."""
    capacity = 30
    lengths = sorted(lengths, reverse=True) if desc else lengths
    seq, off = sum_of_squares(np.array(lengths, np.int64), capacity)
    fill = {}

    def squares(f):
        gaps = [capacity - x for x in f.values() if 0 < x < capacity]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for size, s, o in zip(lengths, seq.tolist(), off.tolist()):
        options = [squares({**fill, k: v + size}) for k, v in fill.items() if v + size <= capacity]
        options.append(squares({**fill, max(fill, default=-1) + 1: size}))
        assert fill.get(s, 0) == o
        fill[s] = o + size
        assert fill[s] <= capacity and squares(fill) == min(options)


def check_packing(rows, docs, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, t in docs.items():
        raw = as_bytes([*library(t), 1])
        got = sorted(by_doc.pop(d), key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(raw) // (4 * capacity))))
        for r in got:
            part = raw[4 * r["start"]:4 * (r["start"] + r["length"])]
            assert r["start"] == r["piece"] * capacity and zlib.crc32(part) == r["ids_crc32"]
        assert sum(r["length"] for r in got) == len(raw) // 4
    assert not by_doc
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), sum(r["length"] for r in rows)


def test_packing_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    n, total = check_packing(op6_sum_of_squares_packing(spark, "/root/testdata/sf0.001").collect(), docs, 4096)
    assert n <= 1.02 * -(-total // 4096) + 1


def test_packing_edges_and_groups(spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(edge_rows())]
    out = pack_documents(frame(spark, rows), default_tokenizer(), capacity=64)
    check_packing(out.collect(), dict(rows), 64)
    assert pack_documents(frame(spark, edge_rows()), default_tokenizer()).where("doc_id is null").count() == 2
    assert pack_documents(frame(spark, []), default_tokenizer()).count() == 0


def test_token_files_round_trip(spark):
    path = scratch_dir(spark, "token-test")
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    manifest = write_token_files(table(spark, "/root/testdata/sf0.001", "documents"), path, default_tokenizer(), shards=3)
    rows = {r["doc_id"]: r for r in scan_token_files(spark, path).collect()}
    at = 0
    for d in sorted(docs):
        raw = as_bytes([*library(docs[d]), 2])
        assert (rows[d]["start"], rows[d]["n_tokens"], rows[d]["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    some = read_documents(path, [5, 17], manifest)
    assert {d: some[d].tobytes() for d in some} == {d: as_bytes([*library(docs[d]), 2]) for d in (5, 17)}


def test_token_files_edges(spark):
    path = scratch_dir(spark, "token-edges")
    write_token_files(frame(spark, edge_rows()), path, default_tokenizer(), shards=2)
    rows = scan_token_files(spark, path).collect()
    assert len(rows) == len(edge_rows()) and sum(r["doc_id"] is None for r in rows) == 2
    by_start = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start[2:]] == sorted(d for d, *_ in edge_rows() if d is not None)
    empty = next(r for r in rows if r["doc_id"] == 2)
    assert (empty["n_tokens"], empty["ids_crc32"]) == (1, zlib.crc32(struct.pack("<I", 2)))
    path = scratch_dir(spark, "token-none")
    write_token_files(frame(spark, []), path, default_tokenizer())
    assert scan_token_files(spark, path).count() == 0


def test_dictionary_of_long_texts_only(spark):
    path = scratch_dir(spark, "token-long")
    docs = {i: " ".join(words(i, 6_000, 400)) for i in range(40)}
    manifest = write_token_files(frame(spark, list(docs.items())), path, default_tokenizer(), shards=2, sample_chars=2_000)
    assert read_dictionary(path)
    got = read_documents(path, [3, 39], manifest)
    assert {d: got[d].tobytes() for d in got} == {d: as_bytes([*library(docs[d]), 2]) for d in (3, 39)}


def test_one_id_in_many_shards(spark):
    path = scratch_dir(spark, "token-one-id")
    rows = [(5, "the same row")] * 300 + [(5, f"row {i}") for i in range(100)] + [(4, "a"), (6, "b")]
    manifest = write_token_files(frame(spark, rows), path, default_tokenizer(), shards=6).collect()
    assert sum(r.docs for r in manifest) == len(rows) and max(r.docs for r in manifest) < 200
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in scan_token_files(spark, path).collect())
    assert [d for _, d, _ in got] == [4] + [5] * 400 + [6]
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(len(got))]
