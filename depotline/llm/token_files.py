"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A shard holds the documents of one range of doc_id in ascending order::

    magic "DLTK", format 1, id width (2 or 4 bytes)     6 bytes
    sha256 of the dictionary                            32 bytes
    one zstandard frame per document (its ids, little-endian)
    index: doc_id int64[n], offset uint64[n + 1], tokens uint32[n], null flag uint8[n]
    footer: n uint64, index position uint64, magic

A reader takes footer and index and then only the frames it wants.  The
dictionary is trained once, on a bounded sample (``SAMPLE_DOCS`` documents of
all sizes, those with the smallest hashes; of a text longer than
``SAMPLE_CHARS`` code points, that many from a place that the hash draws), and
written beside the shards; readers check its hash.

A shard takes about ``SHARD_BYTES`` of text, or less where there is less than
that for each shuffle partition.  Documents are dealt by ranges of doc_id, and
those of one id by the hash of their text and a number of their row, so an id
that is repeated very often fills several shards.

A task writes its shard under a name of its own and then moves it into
place, so a repeated task leaves the same file.  Files are written through
``pyarrow.fs`` (local and shared folders, object stores, HDFS).

* null or empty text: the end id alone; null ids come first
* repeated rows: one document each, side by side
* empty table: no shards, no rows
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotline.llm.common import scratch_dir, shuffle_partitions, table, write_table
from depotline.llm.packing import default_tokenizer
from depotline.llm.tokens import word_ids

END_ID = 2
MAGIC = b"DLTK"
SAMPLE_DOCS = 1_000
SAMPLE_CHARS = 16_384
SHARD_BYTES = 128 << 20
LEAST_SHARD_BYTES = 1 << 20
ROW_BYTES = 64  # what a document counts beside its text
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
MANIFEST_SCHEMA = "shard int, file string, docs long, tokens long, bytes long, first_id long, last_id long"
DOCUMENT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def id_width(tokenizer: str) -> int:
    return 2 if word_ids(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4


def encoded(ids, texts: pa.Array, end_id: int, width: int):
    """The ids of each text and the end id, as bytes."""
    for flat, ends in ids.texts(texts):
        raw = np.insert(flat.astype(f"<u{width}"), ends[1:], end_id).tobytes()
        stops = (width * (ends[1:] + np.arange(1, len(ends)))).tolist()
        yield from (raw[a:b] for a, b in zip([0, *stops], stops))


def train_dictionary(df: DataFrame, rows: int, tokenizer: str, *, text: str, doc_id: str, end_id: int,
                     sample_docs: int, sample_chars: int) -> bytes:
    """The dictionary's bytes; empty if there is too little text to train on."""
    import zstandard
    if not rows:
        return b""
    width = id_width(tokenizer)
    bound = int(-(1 << 63) + min(1.0, 1.2 * sample_docs / rows) * ((1 << 64) - 1))
    t, h = F.col(text).cast("string"), F.col("h")
    some = df.select(F.xxhash64(F.col(doc_id), t).alias("h"), t.alias("t")).where(F.col("t") != "") \
             .where(h <= min(bound, (1 << 63) - 1))
    room = F.greatest(F.char_length("t") - sample_chars, F.lit(0))
    some = some.select("h", F.col("t").substr((F.pmod(h, room + 1) + 1).cast("int"), F.lit(sample_chars)).alias("t"))

    def serialise(batches):
        ids = word_ids(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoded(ids, b.column(1), end_id, width), pa.binary())],
                                             ["h", "raw"])

    found = some.mapInArrow(serialise, "h long, raw binary").orderBy("h").limit(sample_docs).collect()
    samples = [bytes(r["raw"]) for r in found]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # the trainer asks for a few varied samples
        return b""


@functools.lru_cache(maxsize=4)
def compression(dictionary: bytes):
    import zstandard
    if not dictionary:
        return None
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)  # digested once per worker, not once per document
    return shared


def write_token_files(df: DataFrame, path: str, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id",
                      end_id: int = END_ID, sample_docs: int = SAMPLE_DOCS,
                      sample_chars: int = SAMPLE_CHARS, shards: int | None = None) -> DataFrame:
    """Write the shards and the dictionary below ``path``; return the manifest
    (``MANIFEST_SCHEMA``), which is also written there as Parquet."""
    import zstandard
    spark = df.sparkSession
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.col(text).cast("string"))).alias("bytes")).first()
    dictionary = train_dictionary(df, size["rows"], tokenizer, text=text, doc_id=doc_id, end_id=end_id,
                                  sample_docs=sample_docs, sample_chars=sample_chars)
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zstd") as f:
        f.write(dictionary)
    digest, width = hashlib.sha256(dictionary).digest(), id_width(tokenizer)

    def write(batches):
        task = TaskContext.get()
        out_fs, folder = filesystem(path)
        name = f"shard-{task.partitionId():06d}.bin"
        own = f"{folder}/.{name}-{task.taskAttemptId()}"
        ids, press = word_ids(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=compression(dictionary))
        docs, offsets, tokens, nulls, at = array("q"), array("Q", [38]), array("I"), bytearray(), 38
        stream = None
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), encoded(ids, b.column(1), end_id, width)):
                if stream is None:
                    stream = out_fs.open_output_stream(own)
                    stream.write(MAGIC + bytes([1, width]) + digest)
                frame = press.compress(raw)
                stream.write(frame)
                at += len(frame)
                docs.append(d or 0)
                nulls.append(d is None)
                offsets.append(at)
                tokens.append(len(raw) // width)
        if stream is None:
            return
        parts = [np.asarray(docs, "<i8"), np.asarray(offsets, "<u8"), np.asarray(tokens, "<u4"), np.frombuffer(nulls, "u1")]
        for part in parts:
            stream.write(part.tobytes())
        stream.write(struct.pack("<QQ", len(docs), at) + MAGIC)
        stream.close()
        out_fs.move(own, f"{folder}/{name}")
        named = parts[0][parts[3] == 0]
        first, last = (int(named[0]), int(named[-1])) if len(named) else (None, None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([len(docs)]),
             pa.array([int(parts[2].sum(dtype=np.int64))]), pa.array([at + sum(x.nbytes for x in parts) + 20]),
             pa.array([first], pa.int64()), pa.array([last], pa.int64())],
            ["shard", "file", "docs", "tokens", "bytes", "first_id", "last_id"])

    total = (size["bytes"] or 0) + ROW_BYTES * size["rows"]
    n = shards or max(1, -(-total // SHARD_BYTES), min(shuffle_partitions(spark), -(-total // LEAST_SHARD_BYTES)))
    by = ["i", "h", "row"]
    rows = df.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")) \
             .withColumns({"h": F.xxhash64("t"), "row": F.monotonically_increasing_id()}) \
             .repartitionByRange(n, *by).sortWithinPartitions(*by)
    manifest = rows.select("i", "t").mapInArrow(write, MANIFEST_SCHEMA)
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, path: str, name: str, dictionary: bytes):
        import zstandard
        fs, root = filesystem(path)
        self.file = fs.open_input_file(f"{root}/{name}")
        head = self.file.read_at(38, 0)
        if head[:4] != MAGIC or head[6:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name}: not a shard of this dictionary")
        self.width = head[5]
        size = self.file.size()
        n, at = struct.unpack("<QQ", self.file.read_at(16, size - 20))
        index = self.file.read_at(size - 20 - at, at)
        self.docs = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.tokens = np.frombuffer(index, "<u4", n, 16 * n + 8)
        self.nulls = np.frombuffer(index, "u1", n, 20 * n + 8).astype(bool)
        self.press = zstandard.ZstdDecompressor(dict_data=compression(dictionary))

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's k-th document, as little-endian unsigned 32-bit."""
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        raw = self.press.decompress(self.file.read_at(b - a, a), int(self.tokens[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def read_dictionary(path: str) -> bytes:
    fs, root = filesystem(path)
    with fs.open_input_file(f"{root}/dictionary.zstd") as f:
        return f.read()


def read_documents(path: str, doc_ids: list[int], manifest: DataFrame) -> dict[int, np.ndarray]:
    """The ids of a few documents, by index and offset only, from the shards that may hold them."""
    dictionary, out = read_dictionary(path), {}
    wanted = F.lit(np.array(sorted(doc_ids), np.int64))
    for row in manifest.where(F.exists(wanted, lambda i: i.between(F.col("first_id"), F.col("last_id")))).collect():
        s = Shard(path, row["file"], dictionary)
        for k in np.flatnonzero(np.isin(s.docs, doc_ids) & ~s.nulls):
            out[int(s.docs[k])] = s.ids(int(k))
    return out


def scan_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Every document as the files hold it: ``DOCUMENT_SCHEMA``."""
    dictionary = read_dictionary(path)
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    # one row per shard: the window sees the manifest, not the documents
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    manifest = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("before"))

    def read(batches):
        for b in batches:
            for name, start in zip(b["file"].to_pylist(), b["before"].to_pylist()):
                s = Shard(path, name, dictionary)
                crc = [zlib.crc32(s.ids(k).tobytes()) for k in range(len(s.docs))]
                n = s.tokens.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.docs, pa.int64(), mask=s.nulls), pa.array(start + np.cumsum(n) - n),
                     pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, DOCUMENT_SCHEMA)


def op10_zstd_token_files(spark, sf_dir) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, default_tokenizer())
    return scan_token_files(spark, path)
