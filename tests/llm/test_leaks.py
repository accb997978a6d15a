"""Leaks that a cosine over weighted words cannot reach."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgrid.llm import decontam, tokens

RNG = random.Random(21)
VOCABULARY = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(3000)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def pairs(spark, docs, items):
    found = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["id"], r["item_id"]) for r in found.collect()}


def test_a_widespread_item_is_found_in_every_copy(spark):
    items = [(0, prose(36)), (1, "one two")]
    docs = [(i, prose(120) + (" " + items[0][1] if i % 3 == 0 else "") + " " + prose(60)) for i in range(300)]
    docs += [(1000, prose(90) + " One, two " + prose(90))]
    assert pairs(spark, docs, items) == {(i, 0) for i in range(0, 300, 3)} | {(1000, 1)}


def test_short_items_with_words_replaced_are_found(spark):
    items = [(i, prose(n)) for i, n in enumerate((10, 11, 13, 14, 16, 17, 18, 20, 21, 23))]
    docs = [(100 + i, prose(80)) for i in range(100)]
    for i, text in items:
        w = text.split()
        for k in range(len(w) - -(-7 * len(w) // 10)):
            w[min(3 * k + 2, len(w) - 1)] = RNG.choice(VOCABULARY)
        docs.append((i, prose(50) + " " + " ".join(w) + " " + prose(50)))
    assert {(i, i) for i, _ in items} <= pairs(spark, docs, items)


def test_a_long_item_with_words_put_in_between_is_found(spark):
    items = [(0, prose(800))]
    docs = [(i, prose(200)) for i in range(100)]
    docs.append((1000, prose(50) + " " + " ".join(f"{w} {RNG.choice(VOCABULARY)}" for w in items[0][1].split()) + " " + prose(50)))
    assert pairs(spark, docs, items) == {(1000, 0)}


def test_norms_equal_those_of_the_summed_words():
    texts = [" ".join(RNG.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 30, 48, 49, 200)] + ["a " * 300]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    w = tokens.words(data, bounds, decontam.word_table())
    weight = (w.hashes % np.uint64(7)).astype(float)
    known = w.hashes % np.uint64(2) == 0
    p = decontam.passages(w, weight, known)
    for k in range(len(p.doc)):
        sums = Counter()
        for i in range(p.start[k], p.end[k]):
            sums[int(w.hashes[i])] += weight[i]
        whole = max(sum(v * v for v in sums.values()), 1e-12)
        assert p.norm[k] ** 2 == pytest.approx(whole)
        assert p.share[k] == pytest.approx(sum(v * v for h, v in sums.items() if h % 2 == 0) / whole)


@pytest.mark.parametrize("kept", [0.62, 0.55])
def test_paraphrases_are_found_in_the_latent_space_only(spark, monkeypatch, kept):
    """Words replaced all over, the answer too: too few are left in a row or in order, but the vectors are close."""
    rng = random.Random(kept)
    wide = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(60000)]
    text = lambda n: " ".join(rng.choice(wide) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([24, 30, 36, 40, 45, 50] * 10)]
    docs = [(100 + i, text(rng.randint(20, 300))) for i in range(400)]
    for i, x in items:
        w = x.split()
        lost = set(range(1, len(w), 3)) | {len(w) - 2}
        lost |= set(rng.sample(sorted(set(range(len(w))) - lost), max(0, round((1 - kept) * len(w)) - len(lost))))
        docs.append((i, text(60) + " " + " ".join(rng.choice(wide) if k in lost else v for k, v in enumerate(w)) + " " + text(60)))
    got = pairs(spark, docs, items)
    assert not {p for p in got if p[0] != p[1]}
    assert len(got) >= 0.9 * len(items)
    monkeypatch.setattr(decontam, "latent_basis", lambda matrix, width, rank: np.zeros((width, rank)))
    assert len(pairs(spark, docs, items)) < 0.2 * len(got)


@pytest.mark.parametrize("length", [3, 5, 8, 12, 40, 120, 450, 1000])
def test_verbatim_items_of_any_length_are_found(spark, length):
    items = [(i, prose(length)) for i in range(5)]
    docs = [(100 + i, prose(150)) for i in range(60)] + [(i, prose(90) + " " + x + " " + prose(90)) for i, x in items]
    assert pairs(spark, docs, items) == {(i, i) for i, _ in items}


def test_rows_go_by_their_own_text(spark):
    item = prose(30)
    rows = [(None, prose(50)), (None, item), (1, item), (1, prose(40)), (2, None), (3, "")] + [(10 + i, prose(60)) for i in range(40)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, item_id int")
    kept = decontam.decontaminate(df, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == df.columns and {r["item_id"] for r in kept.collect()} == set(range(len(rows))) - {1, 2}
    assert decontam.decontaminate(df.limit(0), spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 0
    assert decontam.decontaminate(df, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)


def test_only_passages_with_enough_words_of_an_item_are_compared(monkeypatch):
    """A passage with two or three words of an item in a row, but under half of them, needs no common subsequence."""
    compared = []
    longest = decontam.longest_shared
    monkeypatch.setattr(decontam, "longest_shared", lambda length, shared: compared.append(length) or longest(length, shared))
    item = [f"i{k}" for k in range(20)]
    items = decontam.Items.of([(0, " ".join(item))])
    weights = decontam.Weights(np.ones(len(items.vocabulary)), np.ones(decontam.BUCKETS))
    owner, rows = decontam.item_passages(items, weights)
    basis = np.eye(len(items.vocabulary), dtype=np.float32)
    search = decontam.Search(items, weights, basis, owner, rows.times(basis), items.grams(), 0.3)
    noise = [f"n{k}" for k in range(30)]
    few, many = noise + item[:9] + noise, noise + item + noise
    assert set(search.leaks(pa.array([" ".join(few), " ".join(many)]))) == {(1, 0)}
    assert compared and len(compared) == len(decontam.passages(*words_of(many)).start)


def words_of(text):
    data = np.frombuffer(" ".join(text).encode(), np.uint8)
    w = decontam.T.words(data, np.array([0, len(data)]), decontam.word_table())
    return w, np.ones(len(w.hashes)), np.zeros(len(w.hashes), bool)


def test_sums_of_rows_and_terms_equal_plain_ones():
    rng = np.random.default_rng(2)
    sizes = np.r_[rng.integers(1, 9, 700), 5000, 65, 64]
    index, values, dense = rng.integers(0, 90, sizes.sum()), rng.random(sizes.sum()).astype(np.float32), rng.random((90, 7)).astype(np.float32)
    m = decontam.Sparse(index, values, sizes)
    plain = np.zeros((len(sizes), 90))
    np.add.at(plain, (np.repeat(np.arange(len(sizes)), sizes), index), values)
    assert np.allclose(m.times(dense), plain @ dense, rtol=1e-4)
    other = rng.random((len(sizes), 7)).astype(np.float32)
    assert np.allclose(m.transposed_times(other, 95)[:90], plain.T @ other, rtol=1e-4) and not m.transposed_times(other, 95)[90:].any()
    items = decontam.Items.of([(0, "a b c"), (1, "c d")])
    asked = np.r_[items.vocabulary, items.vocabulary ^ np.uint64(1), rng.integers(0, 1 << 63, 1000).astype(np.uint64)]
    assert items.terms(asked).tolist() == [items.vocabulary.tolist().index(h) if h in items.vocabulary.tolist() else -1 for h in asked.tolist()]
