"""The language stage decides by the classifier, keeps clean documents and needs no labels."""

import corpus_pipeline
from quillgrid.llm import langid

JUNK = ["qxz jvkq wzzx qqkj xvbn zxcq", "aaaaaaaaaaaaaaa", "ᚠᚢᚦ ᚨᚱᚲ ᚷᚹᚺ"]


def test_stage_drops_what_no_language_claims_and_keeps_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = spark.createDataFrame([(10**6 + i, t, None, "junk", len(t)) for i, t in enumerate(JUNK)], docs.schema)
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.unionByName(junk), "").collect()}
    letters = {r["doc_id"] for r in docs.collect() if langid.has_letter(r["text"])}
    assert got & letters == letters
    assert not got & {10**6 + i for i in range(len(JUNK))}


def test_documents_with_letters_stay_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "123", None), (3, None, None), (4, "x", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {1, 4}


def test_repeated_rows_stay_within_the_sample(spark, monkeypatch):
    seen = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda texts, labels: seen.append(len(texts)) or fit(texts, labels))
    rows = [(1, f"repeated text {i}", "en") for i in range(1000)] + [(i, f"ein anderer Text {i}", "de") for i in range(2, 30)]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20)
    assert seen == [21]
