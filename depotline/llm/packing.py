"""Best-fit packing by sums of squares.

A document's ids (with its end id) are cut into pieces of at most ``capacity``
ids; only longer documents are cut.  Pieces then go, one by one, where the sum
over all gaps of (open sequences with that gap) squared becomes smallest: into
an open sequence or a new one.

Tokens are counted where the text is read; only narrow piece rows (28 bytes)
are kept and dealt, evenly and without a key, into groups of ``group_pieces``.
Each group is packed on its own, largest pieces first, so its few unfilled
sequences are a fixed small share at any input size.

Documents in an order of their own (a ``position``) keep it as far as packing lets
them: a group holds the pieces of one range of positions, groups and the sequences
of a group are numbered by the first position they hold, and a sequence holds its
pieces by position.

* null or empty text: one piece, the end id alone
* repeated rows: packed each on its own; null ids are kept
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotline.llm.common import table, write_table
from depotline.llm.tokens import word_ids

CAPACITY = 4096
END_ID = 1
GROUP_PIECES = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pieces(df: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id",
           position: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: ``PIECE_SCHEMA``, and its ``position`` if there is one."""
    ordered = position is not None

    def cut(batches):
        ids = word_ids(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            docs = iter(zip(*(batch.column(i).to_pylist() for i in (0, 2)[:1 + ordered])))
            for flat, ends in ids.texts(batch.column(1)):
                rows, flat, ends = [], flat.tobytes(), (4 * ends).tolist()
                for a, b in zip(ends[:-1], ends[1:]):
                    d, raw = next(docs), flat[a:b] + end
                    n = len(raw) // 4
                    for p in range(-(-n // capacity)):
                        part = raw[p * capacity * 4:(p + 1) * capacity * 4]
                        rows.append((d[0], p, p * capacity, len(part) // 4, zlib.crc32(part), *d[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [*PIECE_TYPES, pa.int64()])],
                    [*PIECE_COLUMNS, "position"][:len(PIECE_COLUMNS) + ordered])

    cols = [F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")]
    if ordered:
        cols.append(F.col(position).cast("long").alias("p"))
    return df.select(*cols).mapInArrow(cut, PIECE_SCHEMA + (", position long" if ordered else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the given order."""
    open_by_gap = np.zeros(capacity + 1, np.int64)  # full and empty sequences don't count
    stacks: dict[int, list[int]] = {}
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for k, size in enumerate(lengths.tolist()):
        # change of the sum of squares: a gap g (n sequences) becomes g - size (m sequences):
        # 2 (m - n + 1); a gap that closes: 1 - 2 n; a new sequence: 2 m + 1, or 0 if full at once
        n, m = open_by_gap[size:capacity], open_by_gap[:capacity - size]
        cost = np.where(n > 0, 2 * (m - n + 1), np.iinfo(np.int64).max)
        if len(cost) and n[0] > 0:
            cost[0] = 1 - 2 * n[0]
        new = 2 * open_by_gap[capacity - size] + 1 if size < capacity else 0
        # among equal costs the tightest gap, and an open sequence before a new one
        best = int(cost.argmin()) if len(cost) else -1
        if best >= 0 and n[best] > 0 and cost[best] <= new:
            gap = size + best
            s = stacks[gap].pop()
            open_by_gap[gap] -= 1
        else:
            gap, s, made = capacity, made, made + 1
        seq[k], off[k] = s, capacity - gap
        if gap > size:
            open_by_gap[gap - size] += 1
            stacks.setdefault(gap - size, []).append(s)
    return seq, off


def by_position(seq: np.ndarray, lengths: np.ndarray, positions: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) with the sequences numbered by their first position and the pieces
    of each laid out by position; what shares a sequence stays the same."""
    first = np.full(seq.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, seq, positions)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((np.arange(len(first)), first))] = np.arange(len(first))
    seq = rank[seq]
    order = np.lexsort((piece, positions, seq))
    ends, starts = np.cumsum(lengths[order]), np.flatnonzero(np.diff(seq[order], prepend=-1))
    begun = ends - lengths[order]
    off = np.empty(len(seq), np.int64)
    off[order] = begun - np.repeat(begun[starts], np.diff(np.append(starts, len(seq))))
    return seq, off


def pack(piece_rows: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``piece_rows`` with ``sequence_id`` and ``offset`` (long)."""
    groups = max(1, -(-piece_rows.count() // group_pieces))
    ordered = "position" in piece_rows.columns
    dealt = piece_rows.repartitionByRange(groups, "position") if ordered else piece_rows.repartition(groups)

    def place(batches):
        got = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if not got:
            return
        got = got.sort_by([("length", "descending"), *[("position", "ascending")][:ordered], ("doc_id", "ascending"),
                           ("piece", "ascending"), ("ids_crc32", "ascending")])
        seq, off = sum_of_squares(got["length"].to_numpy(), capacity)
        if ordered:
            seq, off = by_position(seq, *(got[c].to_numpy() for c in ("length", "position", "piece")))
            got = got.drop_columns(["position"])
        base = TaskContext.get().partitionId() << 32
        yield from got.append_column("sequence_id", pa.array(base + seq)) \
                      .append_column("offset", pa.array(off)).to_batches()

    return dealt.mapInArrow(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer: str, *, capacity: int = CAPACITY,
                   group_pieces: int = GROUP_PIECES, **kw) -> DataFrame:
    rows = write_table(pieces(df, tokenizer, capacity=capacity, **kw), "pieces")
    return pack(rows, capacity=capacity, group_pieces=group_pieces)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_sum_of_squares_packing(spark, sf_dir) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
