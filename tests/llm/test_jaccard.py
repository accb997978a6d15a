"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from quillgrid.llm import jaccard, simhash
from quillgrid.llm.bitslice import pairs_within

from test_operators import components_of, words


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def kept_by_brute_force(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = components_of(sets, near)
    return {i for i in sets if root[i] == i}


def test_stage_equals_brute_force_jaccard(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").select("doc_id").collect()}
    assert got == kept_by_brute_force([(r["doc_id"], r["text"]) for r in df.collect()])


def test_edited_copies_and_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 8)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]

    def edited(text, share):
        return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in text.split())

    bases = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 400))) for _ in range(60)]
    texts = bases + [edited(t, share) for t in bases for share in (0.005, 0.01, 0.02, 0.05)] + [edited(bases[0], 0.01) for _ in range(80)]
    docs = list(enumerate(texts)) + [(1000, "few words"), (1001, "Few  WORDS"), (1002, ""), (1003, " ")]
    extra = [(None, texts[0]), (None, "no id"), (1001, "another text of the same id")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string")
    got = jaccard.near_dedup(df).collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] != 1001} == kept_by_brute_force(docs)
    assert sum(r["doc_id"] is None for r in got) == 2
    assert [r["text"] for r in got if r["doc_id"] == 1001] == ["another text of the same id"]
    assert jaccard.near_dedup(df.limit(0)).count() == 0


def test_bit_sliced_pairs():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 999).astype(np.uint64)
    y = x ^ (rng.integers(0, 1 << 63, 999) & rng.integers(0, 1 << 63, 999)).astype(np.uint64)
    y[:5] = x[:5]
    for radius in (0, 2, 13, 28):
        expect = [(int(a) ^ int(b)).bit_count() <= radius for a, b in zip(x, y)]
        assert pairs_within(x, y, radius, block=100).tolist() == expect
    assert pairs_within(x[:0], y[:0], 2).tolist() == []


def test_similar_sets_lie_within_the_radius():
    """Sets at the threshold, of 5 to 500 shingles: their SimHashes by majority of the bits are never further apart."""
    rng = np.random.default_rng(3)
    for size in (5, 10, 50, 500):
        sets = [rng.integers(0, 1 << 63, size).astype(np.uint64) for _ in range(300)]
        pairs = [s for a in sets for s in (np.sort(a), np.sort(a[: int(np.ceil(size * 0.8))]))]
        starts = np.cumsum([0, *map(len, pairs[:-1])])
        _, fp, _ = jaccard.signatures(np.concatenate(pairs), starts)
        plain = [sum(1 << k for k in range(64) if 2 * sum(int(v) >> k & 1 for v in s) > len(s)) for s in pairs[:8]]
        assert fp[:8].tolist() == plain
        assert pairs_within(fp[::2], fp[1::2], jaccard.RADIUS).all()


def test_radius_form_judges_each_row_of_a_repeated_id(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (2, text), (2, "other words than those"), (3, "other  words than those"), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in simhash.near_dedup(df).where("text IS NOT NULL").collect())
    assert got == [(1, text), (2, "other words than those")]


def test_hot_keys_of_unlike_copies_are_tiled(spark, monkeypatch):
    """Copies that are near to some others only: large keys are compared in tiles, with the links of all pairs."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(140)]
    texts = []
    for _ in range(160):
        text, edits = list(base), rng.randint(1, 9)
        for at in rng.sample(range(140), edits):
            text[at] = rng.choice(vocabulary)
        texts.append(" ".join(text))
    docs = list(enumerate(texts)) + [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(50))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    expect = kept_by_brute_force(docs)
    assert 25 < len(expect) < 170
    for few, chunk in ((4, 1024), (4, 30), (1, 7)):
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        assert {r["doc_id"] for r in jaccard.near_dedup(df).select("doc_id").collect()} == expect
