from pyspark.sql import functions as F

import corpus_pipeline
from depotline.llm import langid, ngram_join
from depotline.llm.common import DOCUMENT_COLUMNS, write_table
from tests.llm.data import edge_rows, frame
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_near
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = list(texts)
    stay = [d for d, lang in zip(ids, model.predict([texts[d] for d in ids])[0]) if lang != langid.UNKNOWN]
    want = {d: t for d, _, _, t in brute_lines([(d, texts[d]) for d in stay], 10)}
    want = {d: want[d] for d, _, c in brute_near(list(want.items())) if d == c}

    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = write_table(stage(spark, got, SF), "test-stage")
        assert got.columns == DOCUMENT_COLUMNS
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    check_packing(corpus_pipeline.run(spark, SF).collect(), want, 4096)


def test_language_stage_without_labels(spark):
    rows = [(1, "a clean text"), (2, None), (3, "..."), (4, ""), (5, "你好"), (6, "123")]
    out = corpus_pipeline.language(spark, frame(spark, rows), SF)
    assert out.columns == DOCUMENT_COLUMNS and sorted(r["doc_id"] for r in out.collect()) == [1, 5]


def test_mix_stage_writes_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from depotline.llm.mixing import mix
    order = [r["doc_id"] for r in mix(docs).orderBy("slot", "place").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, SF).collect()] == order


def test_stages_on_edges(spark):
    for rows in (edge_rows(), []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = write_table(stage(spark, docs, SF), "test-stage")
            docs.collect()


def test_near_duplicates_stage_keeps_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(DOCUMENT_COLUMNS)
    n = ngram_join.near_duplicates(docs).where("doc_id = component_id").count()
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == n


def test_packing_follows_the_order_of_the_mix(spark):
    """The same documents in two orders: sequences and the pieces in them follow each."""
    from depotline.llm.packing import default_tokenizer, pack, pieces
    docs = frame(spark, [(i, f"word{i} " * (1 + i * 37 % 90)) for i in range(400)])
    for order in (F.col("doc_id"), F.col("doc_id").desc(), F.xxhash64("doc_id")):
        mixed = write_table(docs.repartitionByRange(3, order).sortWithinPartitions(order), "test-mix")
        place = {r["doc_id"]: i for i, r in enumerate(docs.select("doc_id").orderBy(order).collect())}
        numbered = corpus_pipeline.in_file_order(mixed)
        assert {r["doc_id"]: r["position"] for r in numbered.collect()} == place
        one = corpus_pipeline.pack(spark, mixed, SF).collect()
        rows = pack(pieces(numbered, default_tokenizer(), position="position", capacity=300), capacity=300, group_pieces=90).collect()
        for got in (one, rows):
            seqs = {}
            for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
                seqs.setdefault(r["sequence_id"], []).append(place[r["doc_id"]])
            assert all(s == sorted(s) for s in seqs.values())
            assert [s[0] for s in seqs.values()] == sorted(s[0] for s in seqs.values())
        check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 300)
        groups = {}
        for r in rows:
            groups.setdefault(r["sequence_id"] >> 32, []).append(place[r["doc_id"]])
        ranges = [(min(g), max(g)) for _, g in sorted(groups.items())]
        assert len(ranges) > 3 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
