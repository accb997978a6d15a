"""The pipeline against a plain version of its stages."""

from collections import defaultdict

import pytest

import corpus_pipeline
from quillgrid.llm import langid, packing
from quillgrid.llm.queries import tokenizer_path

from test_jaccard import kept_by_brute_force


def test_stages_call_the_dealt_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_pipeline_equals_a_plain_version(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = langid.learn(df, calibrate=True)
    left = {}
    for i, t in docs.items():
        data = langid.normalised(t or "")
        if langid.has_letter(t) and (len(data) < langid.JUDGED_BYTES or (float(model.scores([data]).max()) + 1) / 2 >= model.min_score - 1e-6):
            left[i] = t
    groups = defaultdict(list)
    for i, t in left.items():
        groups[t.encode().lower()].append(i)
    left = {max(g): left[max(g)] for g in groups.values()}
    keep = kept_by_brute_force(list(left.items()))
    left = {i: t for i, t in left.items() if i in keep and not any(x in t for x in items)}
    encode = packing.tokenizer(tokenizer_path())
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == {i: len(encode(t)) + 1 for i, t in left.items()}


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert docs.count() > 0


ROWS = [(1, None, "en"), (2, "", "en"), (3, "12 34", None), (None, "a text without an id, but with words", "en"), (None, "another text without an id", None)]
ROWS += [(5, "the same words twice", "en"), (5, "the same words twice", "en"), (6, "THE same words twice", "en"), (7, "long " * 40000, "en")]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_edge_cases(spark, sf, name):
    """Nulls, empty, repeated and long texts, null and repeated ids, no rows, no labels."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in stage(spark, docs, sf).collect()]
    expect = {"language_id": [5, 5, 6, 7, None, None], "exact_dedup": [2, 3, 6, 7, None, None], "near_dedup": [1, 3, 5, 5, 7, None, None], "decontaminate": [1, 2, 3, 5, 5, 6, 7, None, None]}
    if name == "pack":
        assert set(got) == {r[0] for r in ROWS}
    else:
        assert sorted(got, key=str) == sorted(expect[name], key=str)
    assert stage(spark, docs.limit(0), sf).count() == 0
