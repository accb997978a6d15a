"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
import xxhash

from quillgrid.llm import chat, components, decontam, exact, langid, packing, pitman_yor, sharding, simhash, suffix, tokens, warc
from quillgrid.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

EDGE = [
    (1, "Hello there, hello world. This is a text."),
    (2, None),
    (3, ""),
    (4, "hello THERE, hello world. this is a text."),
    (5, "12345 !!!"),
    (6, "word " * 30000),
    (7, "Hello there, hello world. This is a text."),
    (None, "a text without an id"),
    (8, "É è 漢字 <|endoftext|> end"),
    (8, "É è 漢字 <|endoftext|> end"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "x", 1, "kept", 2.0) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, count int, keep_id string, score double")


def words(text):
    return (text or "").encode().lower().split()


# --- sharding --------------------------------------------------------------------------------------------------------
def test_shards_are_even_gapless_and_independent_of_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert sum(r["size"] for r in members) <= total / 8 * 1.002 + 2 * largest
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs.repartition(7)).collect()}
    assert again == {r["id"]: (r["shard"], r["slot"]) for r in rows}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["id"]].encode()) and r["size"] == len(texts[r["id"]].encode()) + 1 for r in rows)


def test_a_full_shard_passes_keys_on_clockwise():
    ring = sharding.Ring(4, 8, 64)
    loads = {c: 10 for c in range(64)}
    pieces = sharding.fill(ring, loads, slack=0.01)
    got = Counter()
    for (cell, start, s), nxt in zip(pieces, [*pieces[1:], (None, 0, 0)]):
        got[s] += (nxt[1] if nxt[0] == cell else 10) - start
    assert sum(got.values()) == 640 and max(got.values()) <= 640 * 1.01 / 4 + 1
    free = sharding.fill(ring, loads, slack=10)
    order = ring.clockwise()
    assert all(s == order[cell][0] for cell, _, s in free)


def test_sharding_edge_cases(edge, spark):
    rows = sharding.shard(edge).collect()
    assert len(rows) == len(EDGE)
    assert sharding.shard(edge.limit(0)).count() == 0


# --- language ID -----------------------------------------------------------------------------------------------------
def test_language_accuracy_on_held_out(spark, sf):
    out = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = [r for r in out.join(truth, "doc_id").collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_presence_kernel_equals_sets():
    texts = [langid.normalised(t) for t in ("the cat sat", "der hund lief", "the dog ran", "la maison")]
    model = langid.fit(texts * 3, ["en", "de", "en", "fr"] * 3, landmarks_per_language=2)

    def grams(t):
        return {(n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    vocabulary = set().union(*map(grams, texts))
    x = langid.presence(texts, model.vocabulary)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert x[i] @ x[j] == len(grams(a) & grams(b) & vocabulary)


def test_language_edge_cases(edge):
    model = langid.fit([langid.normalised(t) for t in ("hello there world", "guten tag welt")], ["en", "de"])
    rows = {r["id"]: r for r in langid.predict(edge, model).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[5]["lang_pred"] == "und" and rows[2]["score"] == 0
    assert rows[1]["lang_pred"] == "en"
    assert langid.predict(edge, None).where("lang_pred <> 'und'").count() == 0
    kept = langid.filter_language(edge, model)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 3
    assert langid.learn(edge.selectExpr("doc_id", "text", "cast(null as string) as lang")) is None


# --- SimHash ---------------------------------------------------------------------------------------------------------
def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(fps)
    expect = components_of(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {i: (f"{fps[i]:016x}", expect[i]) for i in ids}


def test_bit_sliced_links_on_random_bits():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        v = rng.choice(values)
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    near = [(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= 2]
    expect = components_of(range(len(values)), near)
    at = {v: i for i, v in enumerate(values)}
    got = components_of(range(len(values)), [(at[a], at[b]) for a, b in simhash.spanning_links(values, 2, block=37)])
    assert got == expect
    masks = simhash.key_masks(2)
    assert all(any(not ((values[i] ^ values[j]) & m) for m in masks) for i, j in near)


def test_hot_groups_are_tiled_without_losing_links(spark):
    rng = random.Random(5)
    base = rng.getrandbits(63)
    values = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 40)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    whole = components.connected_components(simhash.links(df)).select("component").distinct().count()
    tiled = components.connected_components(simhash.links(df, chunk=50)).select("component").distinct().count()
    assert whole == tiled == 1


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert set(got[i] for i in range(201)) == {0} and got[1001] == 1000
    assert components.connected_components(links.limit(0)).count() == 0


def test_near_duplicate_edge_cases(edge):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    by = {r["id"]: r for r in rows}
    assert by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component_id"] == 2
    assert by[7]["component_id"] == by[4]["component_id"] == 1
    kept = simhash.near_dedup(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 6, 8, None}
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


# --- repeated substrings ---------------------------------------------------------------------------------------------
def plain_repeats(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        out[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeats(df):
    return {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(df, with_text=False).collect()}


def test_repeats_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_suffix_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == plain_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("most", [suffix.CHUNK_CONTEXTS, 2])
def test_repeats_in_hard_texts(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "CHUNK_CONTEXTS", most)  # small: anchor groups are cut into families
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    docs = [(1, "x" * 500), (2, "x" * 99), (3, "x" * 100), (4, "ab" * 300), (5, None), (6, "")]
    for i in range(7, 60):
        cut, end = rng.randrange(0, 70), rng.randrange(110, 180)
        left, right = ("".join(rng.choice("mnopq") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        docs.append((i, left + passage[cut:end] + right + (passage[:120] if i % 5 == 0 else "") + "é" * (i % 3)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert repeats(df) == plain_repeats(docs)


def test_merged_transforms_sort_all_suffixes():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 99, rng.integers(30, 80)).astype(np.uint8) for _ in range(30)]
    data, bounds = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    key = np.arange(30) << 40
    text, place = suffix.repeated_starts(data, bounds, key, length=10, symbol=5, shards=4)
    first, expect = {}, set()
    for i, t in enumerate(texts):
        for k in range(len(t) - 9):
            s = t[k : k + 10].tobytes()
            if s in first:
                expect.add((i, k))
            first.setdefault(s, (i, k))
    assert set(zip(text.tolist(), place.tolist())) == expect


def test_repeats_edge_cases(edge):
    rows = suffix.remove_repeats(edge).collect()
    assert len(rows) == len(EDGE)
    by = {r["id"]: r for r in rows}
    assert by[2]["n_bytes"] == by[3]["n_bytes"] == 0 and by[6]["n_removed"] == 150000 - 5 and by[8]["n_removed"] == 0
    assert bytes(by[6]["kept"]) == b"word "
    assert suffix.remove_repeats(edge.limit(0)).count() == 0


# --- Pitman-Yor ------------------------------------------------------------------------------------------------------
def test_words_equal_split(spark):
    texts = ["", "a", " b", "c ", "Ab\tcD\x0b\x0c\r\né É  x", "漢字 b"]
    data = "".join(texts).encode()
    bounds = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    found = tokens.words(np.frombuffer(data, np.uint8), bounds, tokens.translation())
    assert [found.data[a:z].tobytes() for a, z in zip(found.starts, found.ends)] == [w for t in texts for w in words(t)]
    assert found.per_doc.tolist() == [len(words(t)) for t in texts]
    assert int(found.hashes[0]) == tokens.hash_word(b"a")


def test_base_scores_equal_brute_force_and_model_is_better(spark, sf):
    rows = {r["doc_id"]: r for r in QUERIES["op5_pitman_yor"](spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        ts = [*words(t), None]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(ts), n, sum(counts[w] > 0 for w in ts))
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in ts), rel=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def fitted_counts(spark, texts):
    """A fitted model with its pairs and words as dictionaries: counts and, for each kept sweep, tables."""
    df = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "id long, text string, held boolean")
    fitted = pitman_yor.fit(pitman_yor.stored(pitman_yor.blocks_of(df, "bigint"), "blocks"))
    kept = len(fitted.model.tables)
    pairs, words_ = {}, {}
    for r in fitted.pairs.where("kind = 0").collect():
        v, u, w, c = (pitman_yor._one(r[k], t) for k, t in (("vocabulary", "<u8"), ("u", "<i4"), ("w", "<i4"), ("counts", "<i8")))
        t = np.frombuffer(pitman_yor._bytes(r["history"]), "<i8").reshape(kept, -1)
        pairs |= {(int(v[u[i]]), int(v[w[i]])): (int(c[i]), t[:, i].tolist()) for i in range(len(c))}
        sizes, tables = pitman_yor._one(r["sizes"], "<i8"), pitman_yor._one(r["tables"], "<i8")
        dish = np.repeat(np.arange(len(c)), tables)
        assert (sizes >= 1).all() and (np.bincount(dish, sizes, len(c)) == c).all()
    for r in fitted.words.where("kind = 0").collect():
        v, n, h, k = *(pitman_yor._one(r[x], y) for x, y in (("words", "<u8"), ("counts", "<i8"), ("history", "u1"))), 12 * r["n_words"]
        for i in range(len(v)):
            words_[int(v[i])] = (int(n[i]), [float(np.frombuffer(h[k * j :], "<f4", len(v))[i]) for j in range(kept)], [int(np.frombuffer(h[k * j + 4 * len(v) :], "<i8", len(v))[i]) for j in range(kept)])
    return fitted, pairs, words_


@pytest.mark.parametrize("block", [pitman_yor.BLOCK_TOKENS, 50])
def test_model_equals_a_plain_version(spark, monkeypatch, block):
    """Given the sampled tables, counts, totals and every token's probability are those of a plain dictionary version."""
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", block)
    monkeypatch.setattr(pitman_yor.T, "SLICE_BYTES", 256)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = ["the " + " ".join(rng.choice(vocabulary[: rng.randint(2, 40)]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + ["", "unique words only here"]
    fitted, pairs, words_ = fitted_counts(spark, texts)
    m, end = fitted.model, int(pitman_yor.END)
    tokens_of = lambda t: [*(tokens.hash_word(w) for w in words(t)), end]
    bigrams = Counter(p for t in texts for p in zip([end, *tokens_of(t)], tokens_of(t)))
    counts = Counter(x for t in texts for x in tokens_of(t))
    assert {k: v[0] for k, v in words_.items()} == counts and m.vocabulary == len(counts) and m.train_tokens == sum(counts.values())
    assert {k: v[0] for k, v in pairs.items()} == {k: n for k, n in bigrams.items() if n >= 2}
    d, d0, s = m.discount, m.root_discount, m.strength

    def root(w, k):
        return ((words_[w][1][k] if w in words_ else 0) + (s + d0 * m.tables[k]) / (m.vocabulary + 1)) / (m.customers[k] + s)

    def probability(u, w):
        total = 0
        for k in range(len(m.tables)):
            c, t = bigrams[u, w], pairs[u, w][1][k] if (u, w) in pairs else min(bigrams[u, w], 1)
            served = sum(pairs[p][1][k] if p in pairs else 1 for p in bigrams if p[0] == u)
            total += (c - d * t + (s + d * served) * root(w, k)) / (counts[u] + s)
        return total / len(m.tables)

    for k in range(len(m.tables)):
        customers = {w: sum(pairs[p][1][k] if p in pairs else 1 for p in bigrams if p[1] == w) for w in counts}
        assert m.customers[k] == sum(customers.values())
        assert sum(root(w, k) for w in counts) + root(-1, k) == pytest.approx(1, abs=1e-6)
    for u in [end, *list(counts)[:5]]:
        assert sum(probability(u, w) for w in [*counts, -1]) == pytest.approx(1, abs=1e-6)
    held = ["the w1 w2 w2 never w3", "w39 w38", ""]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(held))], "doc_id long, text string")
    got = {r["id"]: r for r in pitman_yor.score(rows, F.col("doc_id") >= 1000).collect()}
    for i, t in [*enumerate(texts), *((1000 + i, t) for i, t in enumerate(held))]:
        expect = sum(log10(probability(u, w)) for u, w in zip([end, *tokens_of(t)], tokens_of(t)))
        # the fit draws by hashes: the same texts give the same seats
        assert got[i]["score"] == pytest.approx(expect, rel=1e-5), t
        assert got[i]["perplexity"] == pytest.approx(10 ** (-got[i]["score"] / got[i]["n_tokens"]))


def test_gibbs_moves_reach_the_distribution_of_seats():
    """Three customers of one dish: the chain's seatings have the frequencies of the Chinese restaurant."""
    d, new, n = 0.5, 0.7, 60000
    # weights of 1, 2 and 3 tables: products of what each customer meets
    weight = {1: (1 - d) * (2 - d), 2: new * (1 - d) + (1 - d) * new + new * (1 - d), 3: new * new}
    customers, tables, sizes = np.full(n, 3), np.ones(n, np.int64), np.full(n, 3)
    for sweep in range(12):
        tables, sizes = pitman_yor.gibbs(customers, tables, sizes, d, np.full(n, new), tokens.mix(np.arange(n, dtype=np.uint64) + np.uint64(sweep * 1000003)))
    for t in (1, 2, 3):
        assert (tables == t).mean() == pytest.approx(weight[t] / sum(weight.values()), abs=0.01)


@pytest.mark.parametrize("at_once, together", [(2048, 192), (1, 1), (1, 1 << 30)])
def test_a_sweep_moves_every_customer(monkeypatch, at_once, together):
    """200 customers of one table are soon at as many as the Chinese restaurant has, drawn at once or moved in turn."""
    monkeypatch.setattr(pitman_yor, "AT_ONCE", at_once)
    monkeypatch.setattr(pitman_yor, "TOGETHER", together)
    c, d, new, n = 200, 0.5, 200.0, 400
    share = np.array([1.0])
    for seated in range(1, c):
        t = np.arange(1, seated + 1)
        share = np.r_[share * (seated - d * t), 0] + np.r_[0, share * new]
        share /= share.sum()
    mean = share @ np.arange(1, c + 1)
    customers, tables, sizes = np.full(n, c), np.ones(n, np.int64), np.full(n, c)
    for sweep in range(12):
        seed = tokens.mix(np.arange(n, dtype=np.uint64) + np.uint64(sweep * 1000003))
        tables, sizes = pitman_yor.gibbs(customers, tables, sizes, d, np.full(n, new), seed)
        assert (sizes >= 1).all() and (np.bincount(np.repeat(np.arange(n), tables), sizes, n) == c).all()
        assert sweep or tables.mean() > mean / 2
    assert tables.mean() == pytest.approx(mean, rel=0.02)
    assert tables.std() == pytest.approx((share @ (np.arange(1, c + 1) - mean) ** 2) ** 0.5, rel=0.15)


def test_a_document_that_occurs_twice_scores_apart(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    docs = [" ".join(word() for _ in range(40)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate([*docs, *docs[:20]])]
    got = {r["id"]: r["score"] / r["n_tokens"] for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 200))


def test_scoring_edge_cases(edge, spark):
    from pyspark.sql import functions as F

    rows = pitman_yor.score(edge, F.col("doc_id") == 1).collect()
    assert len(rows) == len(EDGE)
    by = {r["id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 1 and by[6]["n_tokens"] == 30001
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert pitman_yor.score(edge.limit(0), F.lit(False)).count() == 0
    nothing = pitman_yor.score(edge, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


# --- exact dedup -----------------------------------------------------------------------------------------------------
def test_exact_edge_cases(edge):
    by = {(r["id"], r["kept"]): r for r in exact.exact_groups(edge, digest_all=True).collect()}
    assert by[7, True]["group_size"] == 3 and by[1, False]["keep_id"] == by[4, False]["keep_id"] == 7
    assert by[3, True]["group_size"] == 2 and by[2, False]["keep_id"] == 3
    assert by[7, True]["text_sha256"] == hashlib.sha256(EDGE[0][1].encode().lower()).hexdigest()
    kept = exact.exact_dedup(edge)
    assert kept.columns == edge.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([7, 3, 5, 6, 8, None])
    assert exact.exact_groups(edge.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    expect = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(key, expect))


# --- packing ---------------------------------------------------------------------------------------------------------
def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    encode = packing.tokenizer(tokenizer_path())
    rng = random.Random(9)
    texts = [x[1] or "" for x in EDGE] + ["".join(rng.choice("aB é漢\t\n'’s12|  ") for _ in range(80)) for _ in range(200)] + ["don't  stop\n\n 's 've", "  ", " x  y"]
    assert all(encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)


@pytest.mark.parametrize("text", ["a" + " " * 5_000_000 + "b", "\n" * 1_000_000, "x\r\n" * 300_000, "ab" * 2_500_000, "!" * 500_000, "7" * 500_000], ids=["blanks", "lines", "breaks", "letters", "marks", "digits"])
def test_long_runs_are_tokenized(text):
    from tokenizers import Tokenizer

    expect = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.tokenizer(tokenizer_path())(text) == expect


def test_packing_places_every_id_once(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_packing"](spark, sf).collect()
    encode = packing.tokenizer(tokenizer_path())
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in docs.items():
        ids = np.array([*encode(t or ""), 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    used = sum(r["length"] for r in rows)
    assert used / (2048 * len(bins)) > 0.95


def test_first_fit_equals_a_plain_scan():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 2049, 500)
    bins, offsets = packing.first_fit_decreasing(lengths)
    room, expect = [], {}
    for k in sorted(range(500), key=lambda k: -lengths[k]):
        b = next((i for i, r in enumerate(room) if r >= lengths[k]), len(room))
        if b == len(room):
            room.append(2048)
        expect[k] = (b, 2048 - room[b])
        room[b] -= lengths[k]
    assert {k: (int(bins[k]), int(offsets[k])) for k in range(500)} == expect


def test_packing_edge_cases(edge):
    rows = packing.pack_documents(edge, tokenizer_path()).collect()
    assert sum(len(r["pieces"]) for r in rows) >= len(EDGE)
    assert all(len(r["ids"]) == sum(p["length"] for p in r["pieces"]) <= 2048 for r in rows)
    assert packing.pack_documents(edge.limit(0), tokenizer_path()).count() == 0


# --- WARC ------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(1001, None, None), (1002, "http://a.b/c\nd", ""), (1003, "no host", "x"), (1004, "http://[bad", "x"), (None, "http://u/", "x")], "page_id long, url string, html string")
    first = pages.limit(3).selectExpr("page_id + 2000 as page_id", "url", "html")
    both = pages.unionByName(extra).unionByName(first)
    got = {r["page_id"]: r for r in warc.archive_round_trip(both).collect()}
    source = {r["page_id"]: (r["html"] or "").encode() for r in both.collect()}
    assert set(got) == set(source)
    first_of = {}
    for i in sorted((i for i in source if i is not None)):
        first_of.setdefault(source[i], i)
    for i, data in source.items():
        r = got[i]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == warc.digest_of(data)
        expect = None if first_of[data] == i else first_of[data]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if expect is None else ("revisit", expect))


def test_warc_index_lookup(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    hot = spark.range(5000, 5040).selectExpr("id as page_id", "'http://hot.example/x' as url", "'p' || id as html")
    captures = warc.write_archives(pages.select("page_id", "url", "html").unionByName(hot), f"file://{tmp_path}/archive")
    files = warc.build_index(captures.repartition(3), f"file://{tmp_path}/index", block_lines=7)
    assert files.agg({"n_lines": "sum"}).first()[0] == pages.count() + 40
    for r in pages.limit(5).collect():
        hit = [x for x in warc.lookup(files, r["url"]) if x["page_id"] == r["page_id"]]
        assert len(hit) == 1 and hit[0]["payload"] == r["html"].encode()
    assert [x["page_id"] for x in warc.lookup(files, "http://hot.example/x")] == list(range(5000, 5040))
    assert warc.lookup(files, "http://nowhere.example/none") == []
    wanted = captures.where("page_id % 10 = 3")
    got = warc.read_captures(files, wanted, with_payload=True).collect()
    assert {r["page_id"] for r in got} == {r["page_id"] for r in wanted.collect()}
    assert all(r["record_type"] == "revisit" or warc.digest_of(bytes(r["payload"])) == r["payload_digest"] for r in got)
    assert not list(tmp_path.rglob("*.tmp"))
    member = warc.build_record(1, "http://x/", b"abc", warc.digest_of(b"abc"))
    assert gzip.decompress(member).startswith(b"WARC/1.0\r\n") and warc.parse_record(member)[1] == b"abc"
    assert warc.url_key("http://www.Example.com:80/a?b=c") == "com,example,www:80)/a?b=c"
    assert warc.write_archives(pages.limit(0), f"file://{tmp_path}/none").count() == 0


# --- chat ------------------------------------------------------------------------------------------------------------
def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "sure")]
    rows = [(1, i, *t) for i, t in enumerate(a[:2])] + [(2, i, *t) for i, t in enumerate(a)] + [(3, i, *t) for i, t in enumerate(a)] + [(4, 0, "user", "hi")]
    rows += [(5, 0, "user", None), (6, 0, "user", "")] + [(7, i, *t) for i, t in enumerate([*a[:2], ("user", "other")])] + [(None, 0, "user", "null id"), (8, None, None, "x"), (8, None, None, "x")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, kept string, pos int")
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert {i for i, r in got.items() if r["kept"]} == {2, 5, 6, 7, 8, None}
    assert got[1]["keeper_id"] == 2 and got[3]["keeper_id"] == 2 and got[4]["keeper_id"] == 1 and got[8]["n_turns"] == 1
    assert got[1]["rendered"] is None
    assert got[2]["rendered"] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in a)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversations_cross_stretches(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(2500)] + [(2, i, "user", f"t{i}") for i in range(1500)] + [(3, i, "user", f"t{i}" if i < 1499 else "no") for i in range(1500)]
    got = {r["conv_id"]: r["kept"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: True, 2: False, 3: True}


# --- decontamination -------------------------------------------------------------------------------------------------
def test_leaks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op10_decontaminate"](spark, sf).collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == {(d, i) for d, t in docs for i, x in items if x in t}


def test_paraphrases_and_clean_documents(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(36)) for i in range(20)]

    def reworded(text, share):
        return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in text.split())

    docs = [(i, prose(rng.randint(5, 400))) for i in range(300)]
    docs += [(1000 + i, prose(150) + " " + reworded(x, 0.12) + " " + prose(90)) for i, x in items]
    docs += [(2000 + i, prose(30) + " " + x.upper().replace(" ", ", ")) for i, x in items]
    docs += [(3000, None), (3001, ""), (3002, prose(50000))]
    benchmark = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    found = decontam.find_leaks(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), benchmark).collect()
    pairs = {(r["id"], r["item_id"]) for r in found}
    assert {(2000 + i, i) for i, _ in items} <= pairs
    assert len({(1000 + i, i) for i, _ in items} & pairs) >= 18
    assert all(d >= 1000 and d % 1000 == i for d, i in pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert decontam.find_leaks(df.limit(0), benchmark).count() == 0
    assert decontam.find_leaks(df, benchmark.limit(0)).count() == 0


def test_common_subsequence_equals_the_table():
    rng = random.Random(6)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last, row = row, [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        assert decontam.common_subsequence(a, b) == row[-1]


# --- shared folder ---------------------------------------------------------------------------------------------------
def test_stored_tables_can_be_forgotten(spark):
    from quillgrid.llm import util

    path = util.shared_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(util.shared_dir(spark))
    util.forget(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
