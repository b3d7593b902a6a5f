"""Benchmark decontamination: one Aho-Corasick automaton over test questions.

Texts become words (``terms``).  Every ``window`` consecutive words of an item
are a window; an item of fewer words, but not none, is one.  The words of the
items get short codes of a fixed width (each place has letters of its own, so
that codes can only match in step), a window is the chain of its codes, and
one automaton holds the windows of all items.  A document is coded the same
way and goes through the automaton once; its matches are ranges of words,
which are mapped back to code points of the original text.

An automaton holds at most about ``BLOCK_WORDS`` words of items, so that its
size does not grow with the benchmark; larger benchmarks are dealt to several,
and the documents go through one after the other.  Very long items are cut
into pieces that overlap by ``window - 1`` words.

* null or empty text: no words, no hits; a null document id is as any other
* repeated documents: a row each; rows of items with one id are one item
* an item without an id, or without words, takes no part
* no items or no documents: no hits, no rows
* columns of the same names as the new ones are replaced
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotline.llm.common import drop_table, table, write_table
from depotline.llm.terms import SQL_WORDS, positions, words

WINDOW = 10
BLOCK_WORDS = 50_000
PIECE_WORDS = 5_000
DIGIT = 64  # letters for each place of a code
MADE = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RANGES, ITEMS = "_ll_ranges", "_ll_items"


class Windows:
    """The automaton of one block of items: (item id, words) pairs."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        import ahocorasick
        known = {w: n for n, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.width = 1
        while DIGIT ** self.width < len(known):
            self.width += 1
        self.codes = {w: self._code(n) for w, n in known.items()}
        self.unknown = "\x00" * self.width
        self.found: list[tuple[int, set[str]]] = []  # of each window: its length in words and its items
        number: dict[str, int] = {}
        for item, ws in items:
            codes = [self.codes[w] for w in ws]
            for k in range(max(1, len(ws) - window + 1)):
                part = codes[k:k + window]
                at = number.setdefault("".join(part), len(number))
                if at == len(self.found):
                    self.found.append((len(part), set()))
                self.found[at][1].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, at in number.items():
            self.automaton.add_word(text, at)
        self.automaton.make_automaton()

    def _code(self, n: int) -> str:
        places = []
        for place in range(self.width):
            n, digit = divmod(n, DIGIT)
            places.append(chr(1 + place * DIGIT + digit))
        return "".join(places)

    def search(self, ws: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Ranges [first, end) of hit words, in order and apart, and the items."""
        ranges, items, seen = [], set(), set()
        if not self.found:
            return ranges, items
        get, unknown, width = self.codes.get, self.unknown, self.width
        for last, at in self.automaton.iter("".join([get(w, unknown) for w in ws])):
            end = (last + 1) // width
            start = end - self.found[at][0]
            while ranges and ranges[-1][1] >= start:  # the longest match at an end comes first
                start, end = min(start, ranges[-1][0]), max(end, ranges[-1][1])
                ranges.pop()
            ranges.append([start, end])
            if at not in seen:
                seen.add(at)
                items |= self.found[at][1]
        return ranges, items


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_BUILT: dict = {}


def _built(name: str, shared, window: int) -> Windows:
    """One automaton per Python worker, the last one asked for."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(shared.value, window)
    return _BUILT[name]


def item_pieces(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words, n): the words of each item, joined by spaces, in pieces."""
    step = max(1, PIECE_WORDS - window + 1)

    def cut(batches):
        for b in batches:
            rows = []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                for k in range(0, max(1, len(ws) - window + 1) if ws else 0, step):
                    piece = ws[k:k + PIECE_WORDS]
                    rows.append((item, b" ".join(piece).decode("utf-8", "replace"), len(piece)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()))], ["item", "words", "n"])

    asked = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("t"))
    return asked.where("item is not null and t is not null").mapInArrow(cut, "item string, words string, n long").distinct()


def _scan(docs: DataFrame, text: str, shared, window: int, last: bool) -> DataFrame:
    """One pass: ranges and items found so far, and with the ``last`` one the columns of ``MADE``."""
    name, old = uuid.uuid4().hex, [c for c in docs.columns if c not in (RANGES, ITEMS)]
    new = T.StructType.fromDDL(MADE if last else f"{RANGES} array<int>, {ITEMS} array<string>")
    kept = [c for c in old if not last or c not in new.names]

    def scan(batches):
        windows = _built(name, shared, window)
        for b in batches:
            at = {c: b.column(n) for n, c in enumerate(source)}
            rows = []
            for t, r, i in zip(at["_ll_text"].to_pylist(), at[RANGES].to_pylist(), at[ITEMS].to_pylist()):
                ws = words(t)
                ranges, items = windows.search(ws)
                if r:
                    ranges = merged(ranges + [r[k:k + 2] for k in range(0, len(r), 2)])
                items = sorted(items.union(i))
                if not last:
                    rows.append(([x for p in ranges for x in p], items))
                    continue
                place = positions(t) if ranges else []
                rows.append((len(ws), sum(y - x for x, y in ranges), items,
                             [{"start": place[x][0], "end": place[y - 1][1]} for x, y in ranges]))
            types = (pa.int64(), pa.int64(), pa.list_(pa.string()), SPANS) if last else (pa.list_(pa.int32()), pa.list_(pa.string()))
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*[at[c] for c in kept], *made], [*kept, *new.names])

    source = [*kept, "_ll_text", RANGES, ITEMS]
    schema = T.StructType([*[docs.schema[c] for c in kept], *new.fields])
    return docs.select(*kept, F.col(text).cast("string").alias("_ll_text"), RANGES, ITEMS).mapInArrow(scan, schema)


def find_leaks(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window), items (the
    sorted ids, as text, of the items with such windows) and spans (the hit runs
    of words in code points of the original, end exclusive)."""
    spark = docs.sparkSession
    pieces = write_table(item_pieces(items, item_id, item_text, window), "leak-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    out = docs.select("*", F.lit(None).cast("array<int>").alias(RANGES), F.array().cast("array<string>").alias(ITEMS))
    before = None
    for k in range(blocks):
        block = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        rows = sorted((r["item"], r["words"]) for r in block.collect())  # about BLOCK_WORDS words
        shared = spark.sparkContext.broadcast([(i, w.encode().split()) for i, w in rows])
        out = _scan(out, text, shared, window, k == blocks - 1)
        if k < blocks - 1:
            out = write_table(out, "leak-pass")
            if before is not None:
                drop_table(before)
            before = out
    return out


def op12_leak_windows(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n,
             array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS win
      FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS s FROM i WHERE len(w) > 0)),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
      FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
m AS (SELECT r, s, p.n, item FROM p JOIN k ON k.n = p.n AND k.win = array_to_string(w[s:s + p.n - 1], ' ')),
h AS (SELECT r, count(DISTINCT hit) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS hit FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""
