"""The pipeline's stages, each on its own input, against brute-force decisions."""

import collections

import corpus_pipeline
from mnemo.llm import mixing, near_join, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    lex = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    one = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in docs.collect() if lex.score(r.text or "") < 0.5}
    two = corpus_pipeline.drop_exact_copies(spark, one, SF).cache()
    last = {}
    for r in one.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in two.collect()) == sorted(last.values()) and two.columns == docs.columns
    three = corpus_pipeline.drop_near_copies(spark, two, SF).cache()
    classes = {r.doc_id: r.class_id for r in near_join.near_links(two).collect()}
    assert {r.doc_id for r in three.collect()} == set(classes.values())
    four = corpus_pipeline.mix_sources(spark, three, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(three).collect() if r.copies}
    assert collections.Counter(r.doc_id for r in four.collect()) == collections.Counter(copies) and four.columns == docs.columns
    five = corpus_pipeline.encode_pieces(spark, four, SF).collect()
    assert len(five) == sum(copies.values()) and all(r.lossless for r in five)
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("lossless").count() > 0


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty, long and repeated texts, null ids and clashing columns go through all stages; so does no row at all."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "SentencePiece encoding and decoding":
            assert all(r.lossless for r in out.collect())
        else:
            assert out.columns == odd.columns
        if name == "exact dedup":  # of the three rows with one text, and of those without text, one stays
            assert ids[1] == 0 and ids[2] == 1 and ids[3] + ids[4] == 1 and ids[None] == 1
        if name == "n-gram Jaccard join":  # two long texts that differ in a word
            assert ids[6] == 1 and ids[7] == 0 and ids[9] == 1
        docs = out
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
