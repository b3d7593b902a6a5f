"""Ranked lexical search over posting lists in geometric blocks.

The score of a document is the sum of w(t) * impact(t) over the terms t of the
query, in whole numbers.  An index covers the documents in shards of bounded
size, each a unit of work that no other shard is needed for, so that the list
of a term that every document holds is spread like any other:

* forward rows hold a document's terms that the queries ask for, with counts;
* the posting list of a term is clustered by document similarity (documents go
  to the most similar of evenly drawn members, by random projections of their
  impacts) into blocks of about ``BLOCK_DOCS`` documents;
* each block has a summary: for each coordinate the largest impact of its documents.

Terms are ordered by falling weight.  A query visits its lists in that order,
so a document is met first in the list of its heaviest term, and only terms
from there on count towards a block's bound.  A block is skipped only when the
exact sum of weight times summary is below the score that the k-th document
already has; blocks that may hold better documents are evaluated, the highest
bounds first, on the forward rows.  The search ends when the remaining lists
together can't reach that score.  Nothing is approximated: the results are
those of scoring every document.

Summaries hold the coordinates that a bound may ask for: the terms from the
list's own on that share a query with it, at most ``COORDS``; for a
coordinate beyond, a bound takes the shard's largest impact.

The queries are dealt into blocks of about ``QUERY_BYTES`` of text.  Words and
their numbers of one block go to every task; documents meet them in passes.

* null or empty text: no terms; such a document counts nowhere and is never found
* a null document id is as any other, after all ids in ties; repeated documents
  are a document each and take a rank each
* repeated queries (same id and text) are one; queries of one id with unlike
  texts are a query each, listed under that id; a query without terms finds nothing
* fewer documents above zero than asked for: all of them; no documents: no rows
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depotline.llm.common import drop_table, scratch_dir, table, write_table
from depotline.llm.terms import SQL_WORDS, words

K = 20
# Fixed values of the weights.
LENGTH_PART, PERCENT, SATURATION, IMPACT_SCALE = 25, 100, 12, 1_000_000_000
SHARD_DOCS = 4_096
SHARD_CELLS = 1 << 24  # documents times terms of a shard's matrix: 64 MB
BLOCK_DOCS = 64
COORDS = 512
SKETCH_DIMS = 16
SEED = 20_240_611
QUERY_BYTES = 1 << 17
FORWARD = "shard long, doc_id long, n long, terms array<int>, counts array<int>"
LISTS = "shard long, term int, docs array<int>, starts array<int>, coords array<int>, maxima array<int>"
FOUND = "query long, doc_id long, score long"
LONGS = pa.int64()


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = PERCENT - LENGTH_PART + LENGTH_PART * lengths * documents // max(1, total)
    return IMPACT_SCALE * counts // (1000 * counts + SATURATION * m)


class Queries:
    """One block of queries over the terms they ask for, numbered by falling weight."""

    def __init__(self, asked: list[Counter], vocabulary: list[bytes], df: np.ndarray, documents: int, total: int):
        self.documents, self.total = documents, total
        weight = weights(df, documents)
        order = np.array(sorted(range(len(vocabulary)), key=lambda i: (-weight[i], vocabulary[i])), np.int64)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        number = {w: int(self.rank[i]) for i, w in enumerate(vocabulary)}
        weight = weight[order]
        self.terms, self.weights = [], []  # of each query: numbers in order, and their weight times their count
        for q in asked:
            some = sorted((number[w], c) for w, c in q.items() if df[order[number[w]]] and weight[number[w]])
            self.terms.append(np.array([t for t, _ in some], np.int64))
            self.weights.append(np.array([c * int(weight[t]) for t, c in some], np.int64))
        near: dict[int, list] = {}
        for terms in self.terms:
            for j, t in enumerate(terms.tolist()):
                near.setdefault(t, []).append(terms[j:j + COORDS])
        self.coords = {t: np.unique(np.concatenate(x))[:COORDS] for t, x in near.items()}

    def matrix(self, shard: pa.Table) -> np.ndarray:
        """Impacts, a row for each document of the shard and a column for each term."""
        lists, counts = (_flat(shard, c) for c in ("terms", "counts"))
        rows = np.repeat(np.arange(len(shard)), np.diff(lists[0]))
        lengths = shard.column("n").to_numpy()
        x = np.zeros((len(shard), len(self.rank)), np.int32)
        x[rows, self.rank[lists[1]]] = impacts(counts[1].astype(np.int64), lengths[rows], self.documents, self.total)
        return x


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column."""
    c = t.column(name).combine_chunks()
    c = c if isinstance(c, pa.ListArray) else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
    offsets = c.offsets.to_numpy()
    return offsets - offsets[0], c.flatten().to_numpy(zero_copy_only=False)


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.astype(np.int32)))


def geometric_blocks(members: np.ndarray, sketch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of a list in blocks of similar ones: (members in order, starts of the blocks)."""
    if len(members) <= size:
        return members, np.zeros(1, np.int64)
    centres = sketch[members[::size]]
    near = (sketch[members] @ centres.T).argmax(axis=1)
    order = np.argsort(near, kind="stable")
    near = near[order]
    first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
    at = np.arange(len(members)) - np.repeat(first, np.diff(np.r_[first, len(near)]))
    return members[order], np.flatnonzero(at % (2 * size) == 0)


def build_lists(shard: int, x: np.ndarray, queries: Queries) -> pa.Table:
    """The blocked posting lists of a shard with their summaries."""
    plane = np.random.default_rng(SEED).standard_normal((x.shape[1], SKETCH_DIMS)).astype(np.float32)
    sketch = x.astype(np.float32) @ plane
    sketch /= np.maximum(np.sqrt((sketch * sketch).sum(axis=1, keepdims=True)), 1e-9)
    terms, docs, starts, coords, maxima = [], [], [], [], []
    for t in sorted(queries.coords):
        members = np.flatnonzero(x[:, t])
        if not len(members):
            continue
        members, first = geometric_blocks(members, sketch, BLOCK_DOCS)
        columns = queries.coords[t]
        terms.append(t)
        docs.append(members)
        starts.append(first)
        coords.append(columns)
        maxima.append(np.maximum.reduceat(x[members[:, None], columns], first, axis=0).ravel())
    return pa.table([pa.array(np.full(len(terms), shard), LONGS), pa.array(terms, pa.int32()),
                     *map(_list_array, (docs, starts, coords, maxima))],
                    ["shard", "term", "docs", "starts", "coords", "maxima"])


class Lists:
    def __init__(self, t: pa.Table):
        self.at = {term: k for k, term in enumerate(t.column("term").to_pylist())}
        self.docs, self.starts, self.coords, self.maxima = (_flat(t, c) for c in ("docs", "starts", "coords", "maxima"))

    def blocks(self, term: int):
        """(documents, starts and ends of the blocks, coordinates, summaries: a row for each block)."""
        docs, starts, coords, maxima = ((v[o[self.at[term]]:o[self.at[term] + 1]]) for o, v in (
            self.docs, self.starts, self.coords, self.maxima))
        return docs, starts, np.r_[starts[1:], len(docs)], coords, maxima.reshape(len(starts), len(coords))


def search_shard(x: np.ndarray, ids: np.ndarray, lists: Lists, terms: np.ndarray, weight: np.ndarray, k: int,
                 largest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, number of documents scored): the k best rows of a shard for a query.
    ``ids`` gives the order among equal scores, ``largest`` the largest impact of each term."""
    seen = np.zeros(len(x), bool)
    best_doc, best, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    reach = np.cumsum((weight * largest[terms])[::-1])[::-1]  # what this and all later lists can add up to
    for j, t in enumerate(terms.tolist()):
        if reach[j] < least:
            break
        if t not in lists.at:
            continue
        docs, first, end, coords, maxima = lists.blocks(t)
        at = np.minimum(np.searchsorted(coords, terms[j:]), len(coords) - 1)
        held = coords[at] == terms[j:]
        bound = maxima[:, at[held]] @ weight[j:][held] + int((weight[j:] * largest[terms[j:]])[~held].sum())
        order, step, done = np.argsort(-bound, kind="stable"), 4, 0
        while done < len(order) and bound[order[done]] >= least:
            some = order[done:done + step]
            some = some[bound[some] >= least]
            done, step = done + step, 2 * step
            rows = np.concatenate([docs[first[b]:end[b]] for b in some])
            rows = rows[~seen[rows]]
            seen[rows] = True
            score = x[rows[:, None], terms] @ weight
            rows, score = rows[score >= least], score[score >= least]
            best_doc, best = np.r_[best_doc, rows], np.r_[best, score]
            keep = np.lexsort((ids[best_doc], -best))[:k]
            best_doc, best = best_doc[keep], best[keep]
            if len(best) == k:
                least = max(1, int(best[-1]))
    return best_doc, best, int(seen.sum())


def read_queries(queries: DataFrame, query_id: str, text: str) -> tuple[DataFrame, int]:
    """(id, t, block) of the distinct queries, and the number of blocks."""
    asked = queries.select(F.col(query_id).alias("id"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    return asked.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(max(1, blocks)))), blocks


def forward_rows(docs: DataFrame, doc_id: str, text: str, vocabulary, shard_docs: int) -> DataFrame:
    """``FORWARD``: each document with terms, its length and its counts of the words of
    ``vocabulary`` (a broadcast word -> number); a shard is a run of documents of one task."""
    def read(batches):
        known, task, at = vocabulary.value, TaskContext.get().partitionId(), 0
        for b in batches:
            ids, shards, lengths, terms, counts, keep = b.column(0), [], [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ws = words(t)
                if not ws:
                    continue
                count = Counter(ws)
                some = count.keys() & known.keys()
                keep.append(k)
                shards.append((task << 32) + at // shard_docs)
                at += 1
                lengths.append(len(ws))
                terms.append(np.fromiter((known[w] for w in some), np.int32, len(some)))
                counts.append(np.fromiter((count[w] for w in some), np.int32, len(some)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, LONGS), ids.take(pa.array(keep, LONGS)), pa.array(lengths, LONGS), _list_array(terms),
                 _list_array(counts)], ["shard", "doc_id", "n", "terms", "counts"])

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(read, FORWARD)


def statistics(forward: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Documents of each term, number of documents and of all their terms."""
    def count(batches):
        df, documents, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=size)
            documents, total = documents + len(b), total + int(b.column(0).to_numpy().sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, size)), pa.array(np.r_[documents, total, df])], ["term", "c"])

    parts = forward.select("n", "terms").mapInArrow(count, "term long, c long")
    df, documents, total = np.zeros(size, np.int64), 0, 0
    for r in parts.where("c > 0").groupBy("term").agg(F.sum("c").alias("c")).collect():  # one row for each term
        if r["term"] >= 0:
            df[r["term"]] = r["c"]
        elif r["term"] == -2:
            documents = r["c"]
        else:
            total = r["c"]
    return df, documents, total


_READ: dict = {}


def _queries(name: str, shared) -> Queries:
    """One block of queries per Python worker, the last one asked for."""
    if name not in _READ:
        _READ.clear()
        _READ[name] = Queries(*shared.value)
    return _READ[name]


def search_block(docs: DataFrame, asked: list[str], doc_id: str, text: str, k: int) -> DataFrame:
    """``FOUND`` for the texts of one block of queries (``query``: the place in ``asked``)."""
    spark = docs.sparkSession
    counts = [Counter(words(t)) for t in asked]
    vocabulary = sorted({w for c in counts for w in c})
    numbers = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})
    shard_docs = max(64, min(SHARD_DOCS, SHARD_CELLS // max(1, len(vocabulary))))
    forward = write_table(forward_rows(docs, doc_id, text, numbers, shard_docs), "search-forward")
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((counts, vocabulary, *statistics(forward, len(vocabulary))))

    def build(key, shard):
        queries = _queries(name, shared)
        return build_lists(key[0].as_py(), queries.matrix(shard), queries)

    def search(key, shard, blocked):
        queries, lists, found = _queries(name, shared), Lists(blocked), []
        x, largest = queries.matrix(shard), None
        largest = x.max(axis=0, initial=0).astype(np.int64)
        ids = shard.column("doc_id").combine_chunks()
        order = np.empty(len(x), np.int64)  # the place of each id, nulls last
        order[pa.compute.array_sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(x))
        for q, (terms, weight) in enumerate(zip(queries.terms, queries.weights)):
            if len(terms):
                rows, score, _ = search_shard(x, order, lists, terms, weight, k, largest)
                found.append((np.full(len(rows), q), rows, score))
        query, rows, score = (np.concatenate(c).astype(np.int64) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(query), ids.take(pa.array(rows)), pa.array(score)], ["query", "doc_id", "score"])

    forward = forward.where(F.size("terms") > 0)
    lists = write_table(forward.groupBy("shard").applyInArrow(build, LISTS), "search-lists")
    hits = forward.groupBy("shard").cogroup(lists.groupBy("shard")).applyInArrow(search, FOUND)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = write_table(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "search-best")
    drop_table(lists)
    drop_table(forward)
    return best


def search(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id",
           query_text: str = "text", k: int = K) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` documents with the highest score above 0 of each query."""
    spark = docs.sparkSession
    asked, blocks = read_queries(queries, query_id, query_text)
    kind = asked.schema["id"].dataType.simpleString()
    schema, paths = f"`{query_id}` {kind}, rank int, doc_id long, score long", []
    for b in range(blocks):
        rows = sorted(asked.where(F.col("block") == b).collect(), key=lambda r: (str(r["id"]), r["t"]))  # about QUERY_BYTES
        if not rows:
            continue
        best = search_block(docs, [r["t"] for r in rows], doc_id, text, k)
        named = spark.createDataFrame([(n, r["id"]) for n, r in enumerate(rows)], f"query long, `{query_id}` {kind}")
        out = best.join(named, "query").select(query_id, "rank", "doc_id", "score")
        if blocks == 1:
            return out
        paths.append(scratch_dir(spark, "search"))
        out.write.parquet(paths[-1])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def op11_block_max_search(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


ORACLE = f"""
WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS.format('text')} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d),
i AS (SELECT item_id, unnest({SQL_WORDS.format('text')}) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY item_id, term),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
t AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
      FROM p, s GROUP BY term),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * n_docs) // total AS m FROM d, s),
x AS (SELECT item_id, doc_id, r, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= {K}"""
