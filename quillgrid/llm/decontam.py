"""Benchmark decontamination by latent semantic retrieval.

A distributed randomised SVD of the corpus's TF-IDF passages over the benchmark's words gives a latent space.  Passages and
items meet there: those with a high cosine, and those that hold two or three consecutive words of an item, are compared
with it by longest common subsequence, by its answer (its last words) and, where words were replaced or moved, by the cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import tokens as T
from quillgrid.llm.util import bound_batches, discard, stored

#: Words of a passage and from one passage to the next.
WINDOW, STRIDE = 48, 24
#: Buckets in which document frequencies of words outside the benchmark are kept; those of its words are exact.
BUCKETS = 1 << 18
#: The latent space has a dimension for each item passage, at most RANK; the SVD draws OVERSAMPLE more and iterates.
RANK, OVERSAMPLE, ITERATIONS = 256, 16, 2
#: A word held by more than one document in so many is a stop word.
COMMON = 10.0
#: Latent cosine from which a passage is a candidate, and from which the lower share of words is enough.
MIN_COSINE = 0.3
#: A candidate is a leak if this share of the item's words is a common subsequence, or the lower share with the answer or
#: with that cosine.
MIN_LCS, MIN_LCS_WITH_ANSWER = 0.7, 0.5
ANSWER_WORDS = 5
#: The cosine replaces the answer only for items of this length: half of a few words is found anywhere.
SURE_WORDS = 12
#: Passages and item passages compared in one matrix product.
ITEM_BLOCK = 512
#: ASCII punctuation parts words, so that it does not hide a paraphrase.
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def word_table() -> np.ndarray:
    return T.translation(PUNCTUATION)


def places_of(a: list[int]) -> dict[int, int]:
    """The places of each word as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    return places


def longest_shared(length: int, shared: list[int]) -> int:
    """Length of the longest common subsequence with a list of ``length`` words, a bit vector over it at a time; ``shared``:
    the places there of the other list's words (those without any change nothing)."""
    full = (1 << length) - 1
    v = full
    for places in shared:
        u = v & places
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence."""
    places = places_of(a)
    return longest_shared(len(a), [places[x] for x in b if x in places])


def gram_size(length: int) -> int:
    """Consecutive words that any copy of an item of ``length`` words keeps if it drops or replaces as much as a leak may.

    Without three kept words in a row at most length - length // 3 are kept; where that is a leak, two in a row must do.
    The lower share needs the whole answer, which is longer.
    """
    return min(length, 3 if length - length // 3 < MIN_LCS * length else 2)


def gram_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.full(len(at), size, np.uint64)
    for k in range(size):
        out = T.mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[at + k])
    return out


@dataclass
class Items:
    """Benchmark items as word hashes, and their vocabulary (sorted)."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        table, out = word_table(), []
        for _, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            out.append(T.words(data, np.array([0, len(data)]), table).hashes)
        keep = [i for i, w in enumerate(out) if len(w)]
        found = [out[i] for i in keep]
        return cls([rows[i][0] for i in keep], found, np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.vocabulary >> np.uint64(44)] = True

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Index in the vocabulary, or -1.  Only words whose first bits are those of one of its words are searched."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.sieve[(hashes >> np.uint64(44)).astype(np.int64)])
        wanted = hashes[some]
        at = np.minimum(np.searchsorted(self.vocabulary, wanted), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == wanted, at, -1)
        return out

    def grams(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(size, hashes, item indexes) of the items' runs of words of each size, sorted by hash."""
        found: dict[int, list[np.ndarray]] = {}
        for i, w in enumerate(self.words):
            size = gram_size(len(w))
            hashes = np.unique(gram_hashes(w, np.arange(len(w) - size + 1), size))
            found.setdefault(size, []).append(np.stack([hashes, np.full(len(hashes), i, np.uint64)]))
        out = []
        for size, parts in sorted(found.items()):
            hashes, item = np.concatenate(parts, axis=1)
            order = np.argsort(hashes, kind="stable")
            out.append((size, hashes[order], item[order].astype(np.int64)))
        return out


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Weights:
    """Squared inverse document frequencies, so that rare words decide: of benchmark words by term, of others by bucket."""

    of_term: np.ndarray
    of_bucket: np.ndarray

    def __call__(self, hashes: np.ndarray, term: np.ndarray) -> np.ndarray:
        return np.where(term >= 0, self.of_term[term], self.of_bucket[bucket(hashes)])


def document_frequencies(docs: DataFrame, text_col: str, items: Items) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket's other words (BUCKETS numbers) or each benchmark word, and the number of documents."""
    width = BUCKETS + len(items.vocabulary)

    def count(batches):
        table, total, n = word_table(), np.zeros(width, np.int64), 0
        for b in batches:
            for _, data, bounds in T.slices(b.column(0)):
                w = T.words(data, bounds, table)
                term = items.terms(w.hashes)
                key = np.where(term >= 0, BUCKETS + term, bucket(w.hashes))
                pairs = np.sort(w.doc.astype(np.int64) * width + key)
                pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
                total += np.bincount(pairs % width, minlength=width)
                n += w.n_docs
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int64()), pa.array(np.r_[total[some], n], pa.int64())], ["key", "n"])

    rows = docs.select(text_col).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    df, key = np.zeros(width, np.int64), rows["key"].to_numpy()
    df[key[key >= 0]] = rows["n"].to_numpy()[key >= 0]
    return df, int(rows["n"].to_numpy()[key < 0].sum())


def inverse_frequencies(df: np.ndarray, n: int) -> Weights:
    """log(n / df) squared; stop words weigh nothing."""
    idf = np.log((n + 1) / (df + 1))
    squared = np.where(idf > np.log(COMMON), idf**2, 0)
    return Weights(squared[BUCKETS:], squared[:BUCKETS])


@dataclass
class Passages:
    """Passages of a slice: words ``start`` to ``end`` of the slice, each inside one text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    #: share of the squared weight that lies on benchmark words
    share: np.ndarray
    norm: np.ndarray


def passages(w: T.Words, weight: np.ndarray, known: np.ndarray) -> Passages:
    """Windows over whole texts.  A passage's norm is that of its vector, in which a word's occurrences are summed."""
    n = w.per_doc
    first = np.cumsum(n) - n
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(w.n_docs), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + k * STRIDE
    end = np.minimum(start + WINDOW, first[doc] + n[doc])
    square = weight.astype(np.float64) ** 2
    total = np.r_[0, np.cumsum(square)]
    ours = np.r_[0, np.cumsum(np.where(known, square, 0))]
    base = np.cumsum(count) - count
    # the square of a sum: each pair of equal words adds twice their product to the passages that hold both
    twice, twice_ours = np.zeros(len(doc)), np.zeros(len(doc))
    weighed = np.flatnonzero(square)
    places = np.uint64((1 << len(square).bit_length()) - 1)
    at = (np.sort((w.hashes[weighed] & ~places) | weighed.astype(np.uint64)) & places).astype(np.int64)
    here = np.arange(len(at))
    for lag in range(1, WINDOW):
        here = here[here + lag < len(at)]
        i, j = at[here], at[here + lag]
        near = (w.hashes[i] == w.hashes[j]) & (j - i < WINDOW) & (w.doc[i] == w.doc[j])
        here, i, j = here[near], i[near], j[near]
        if not len(here):
            break
        d = w.doc[i]
        lo = base[d] + np.maximum(0, (j - first[d] - WINDOW) // STRIDE + 1)
        hi = base[d] + np.minimum((i - first[d]) // STRIDE, count[d] - 1)
        for k in range(-(-WINDOW // STRIDE)):
            both = np.flatnonzero(lo + k <= hi)
            passage, add = lo[both] + k, 2 * square[i[both]]
            twice += np.bincount(passage, add, len(doc))
            twice_ours += np.bincount(passage, np.where(known[i[both]], add, 0), len(doc))
    whole = np.maximum(total[end] - total[start] + twice, 1e-12)
    return Passages(start, end, doc, (ours[end] - ours[start] + twice_ours) / whole, np.sqrt(whole))


@dataclass
class Sparse:
    """Rows of a sparse matrix over the benchmark's words."""

    terms: np.ndarray
    values: np.ndarray
    sizes: np.ndarray

    def __getitem__(self, rows: slice) -> Sparse:
        ends = np.r_[0, np.cumsum(self.sizes)]
        a, z = ends[rows.start], ends[min(rows.stop, len(self.sizes))]
        return Sparse(self.terms[a:z], self.values[a:z], self.sizes[rows])

    def times(self, dense: np.ndarray) -> np.ndarray:
        return sums_of_rows(dense.astype(np.float32, copy=False), self.terms, self.values, self.sizes)

    def transposed_times(self, dense: np.ndarray, width: int) -> np.ndarray:
        out, row = np.zeros((width, dense.shape[1])), np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(self.terms, kind="stable")
        term = self.terms[order]
        cut = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else order
        out[term[cut]] = sums_of_rows(dense, row[order], self.values[order], np.diff(np.r_[cut, len(term)]))
        return out


def sums_of_rows(dense: np.ndarray, index: np.ndarray, values: np.ndarray, sizes: np.ndarray, block: int = 256, long: int = 64) -> np.ndarray:
    """For each stretch of ``sizes`` entries the sum of the rows ``index`` of a dense matrix, times ``values``.

    The k-th entries of a block of stretches are added in one step, which stays in a core's cache; a long stretch is a
    product of its own.
    """
    out = np.zeros((len(sizes), dense.shape[1]), np.float32)
    start = np.cumsum(sizes) - sizes
    for r in np.flatnonzero(sizes > long).tolist():
        for a in range(start[r], start[r] + sizes[r], 1 << 12):
            z = min(a + (1 << 12), start[r] + sizes[r])
            out[r] += values[a:z] @ dense[index[a:z]]
    short = np.flatnonzero(sizes <= long)
    short = short[np.argsort(-sizes[short], kind="stable")]
    for b in range(0, len(short), block):
        rows = short[b : b + block]
        n, first = sizes[rows], start[rows]
        total = np.zeros((len(rows), dense.shape[1]), np.float32)
        for k in range(int(n[0])):
            at = first[: int(np.searchsorted(-n, -k, "left"))] + k
            total[: len(at)] += dense[index[at]] * values[at, None]
        out[rows] = total
    return out


def able(w: T.Words, term: np.ndarray, weight: np.ndarray, p: Passages, min_cosine: float) -> tuple[np.ndarray, Sparse]:
    """Passages that can reach the cosine, by the share of their weight that lies on benchmark words, and their rows."""
    some = np.flatnonzero((p.share >= min_cosine**2) & (p.norm > 1e-6))
    ours = np.flatnonzero((term >= 0) & (weight > 0))
    lo, hi = np.searchsorted(ours, p.start[some]), np.searchsorted(ours, p.end[some])
    some, lo, hi = some[hi > lo], lo[hi > lo], hi[hi > lo]
    sizes = hi - lo
    at = ours[np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    return some, Sparse(term[at], (weight[at] / np.repeat(p.norm[some], sizes)).astype(np.float32), sizes)


def able_rows(docs: DataFrame, text_col: str, items: Items, weights: Weights, min_cosine: float) -> DataFrame:
    """The passage matrix of the whole corpus without rows that cannot reach the cosine, as (terms, data, sizes) a slice."""

    def run(batches):
        table = word_table()
        for b in batches:
            for _, data, bounds in T.slices(b.column(0)):
                w = T.words(data, bounds, table)
                term = items.terms(w.hashes)
                weight = weights(w.hashes, term)
                _, m = able(w, term, weight, passages(w, weight, term >= 0), min_cosine)
                if len(m.sizes):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.terms.astype("<i4"), m.values.astype("<f4"), m.sizes.astype("<i4"))], ["terms", "data", "sizes"])

    return docs.select(text_col).mapInArrow(run, "terms binary, data binary, sizes binary")


def latent_basis(matrix: DataFrame, width: int, rank: int, oversample: int = OVERSAMPLE, iterations: int = ITERATIONS, seed: int = 5) -> np.ndarray:
    """Orthonormal columns (width x rank) that span the leading right singular space of the passage matrix.

    Randomised subspace iteration: each task multiplies its rows A with the current directions and the result with A
    transposed; Spark adds the products by word.  What reaches the driver is (benchmark words) x (rank + oversample).
    """
    directions = np.random.default_rng(seed).standard_normal((width, min(width, rank + oversample)))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.groupby("term")["row"].agg(lambda rows: sum(np.frombuffer(r) for r in rows).tobytes()).reset_index()

    for _ in range(1 + iterations):
        q = directions.astype(np.float32)

        def multiply(batches, q=q):
            out = np.zeros(q.shape)
            for b in batches:
                for r in range(b.num_rows):
                    m = Sparse(*(np.frombuffer(b.column(c)[r].as_buffer(), k) for c, k in (("terms", "<i4"), ("data", "<f4"), ("sizes", "<i4"))))
                    out += m.transposed_times(m.times(q), width)
            some = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([r.tobytes() for r in out[some]], pa.binary())], ["term", "row"])

        products = matrix.mapInArrow(multiply, "term long, row binary")
        got = products.groupBy((F.col("term") % 64).alias("__g")).applyInPandas(lambda pdf: add(pdf[["term", "row"]]), "term long, row binary").toPandas()
        image = np.zeros(q.shape)
        for term, row in zip(got["term"], got["row"]):
            image[term] = np.frombuffer(row)
        u, s, _ = np.linalg.svd(image, full_matrices=False)
        directions = u[:, s > 1e-9 * max(s[:1].tolist() or [1])]
        if not directions.shape[1]:
            break
    return directions[:, :rank]


def item_passages(items: Items, weights: Weights) -> tuple[np.ndarray, Sparse]:
    """Item of each passage of the items and the passages' unit rows: items of more than a window are cut like documents, so
    that no copy is too long for a passage."""
    owner, rows = [], []
    for i, w in enumerate(items.words):
        for k in range(1 + max(0, -(-(len(w) - WINDOW) // STRIDE))):
            term, n = np.unique(items.terms(w[k * STRIDE : k * STRIDE + WINDOW]), return_counts=True)
            value = weights.of_term[term] * n
            owner.append(i)
            rows.append((term, value / max(float(np.linalg.norm(value)), 1e-12)))
    terms, values = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    return np.array(owner), Sparse(terms, values.astype(np.float32), np.array([len(r[0]) for r in rows]))


def gram_candidates(w: T.Words, term: np.ndarray, p: Passages, grams: list[tuple[int, np.ndarray, np.ndarray]]) -> set[tuple[int, int]]:
    """(passage, item) for the passages in which a run of an item's words begins, however common its words are."""
    found: set[tuple[int, int]] = set()
    known = term >= 0
    n = w.per_doc
    first, passage = np.cumsum(n) - n, np.searchsorted(p.doc, np.arange(w.n_docs))
    last = np.searchsorted(p.doc, np.arange(w.n_docs), "right") - 1
    for size, hashes, item in grams:
        ok = known[: max(0, len(known) - size + 1)].copy()
        for k in range(1, size):
            ok &= known[k : k + len(ok)] & (w.doc[k : k + len(ok)] == w.doc[: len(ok)])
        at = np.flatnonzero(ok)
        h = gram_hashes(w.hashes, at, size)
        lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
        hit = np.flatnonzero(hi > lo)
        at, lo, sizes = at[hit], lo[hit], (hi - lo)[hit]
        where = np.repeat(at, sizes)
        which = item[np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(where))]
        doc = w.doc[where]
        k = np.minimum(passage[doc] + (where - first[doc]) // STRIDE, last[doc])
        pairs = np.unique(k.astype(np.int64) * (int(item.max()) + 1) + which)
        found.update(zip((pairs // (int(item.max()) + 1)).tolist(), (pairs % (int(item.max()) + 1)).tolist()))
    return found


SCHEMA = "item_id {item}, first_word long, cosine double, lcs double, answer boolean"


@dataclass
class Search:
    """What a task needs to find the leaks in a column of texts."""

    items: Items
    weights: Weights
    basis: np.ndarray
    owner: np.ndarray
    latent_items: np.ndarray
    grams: list[tuple[int, np.ndarray, np.ndarray]]
    min_cosine: float

    @classmethod
    def of(cls, docs: DataFrame, text_col: str, rows: list[tuple], min_cosine: float) -> Search | None:
        """Documents are read twice: for their frequencies, and for the passages that the SVD is taken of."""
        items = Items.of(rows)
        if not items.ids:
            return None
        weights = inverse_frequencies(*document_frequencies(docs, text_col, items))
        owner, sparse = item_passages(items, weights)
        matrix = stored(able_rows(docs, text_col, items, weights, min_cosine), "passages")
        basis = latent_basis(matrix, len(items.vocabulary), min(RANK, len(owner))).astype(np.float32)
        discard(matrix)
        return cls(items, weights, basis, owner, sparse.times(basis), items.grams(), min_cosine)

    def leaks(self, column: pa.Array) -> dict[tuple[int, int], tuple[float, bool, float, int]]:
        """(row, item index) -> (LCS share, answer, cosine, minus first word) of the best passage."""
        table, best, places = word_table(), {}, {}
        rows_of = np.searchsorted(self.owner, np.arange(len(self.items.ids) + 1))
        for at, data, bounds in T.slices(column):
            w = T.words(data, bounds, table)
            term = self.items.terms(w.hashes)
            weight = self.weights(w.hashes, term)
            p = passages(w, weight, term >= 0)
            candidates = dict.fromkeys(gram_candidates(w, term, p, self.grams), 0.0)
            some, m = able(w, term, weight, p, self.min_cosine)
            for a in range(0, len(some), ITEM_BLOCK):
                latent = m[a : a + ITEM_BLOCK].times(self.basis)
                for b in range(0, len(self.owner), ITEM_BLOCK):
                    cosine = latent @ self.latent_items[b : b + ITEM_BLOCK].T
                    for i, j in np.argwhere(cosine >= self.min_cosine).tolist():
                        key = int(some[a + i]), int(self.owner[b + j])
                        candidates[key] = max(candidates.get(key, 0.0), float(cosine[i, j]))
            n_words = w.per_doc
            first = np.cumsum(n_words) - n_words
            for (passage, item), cosine in candidates.items():
                doc, reach = int(p.doc[passage]), len(self.items.words[item])
                a, z = max(first[doc], p.start[passage] - reach), min(first[doc] + n_words[doc], p.end[passage] + reach)
                if item not in places:
                    places[item] = places_of(self.items.words[item].tolist())
                here = places[item]
                shared = [here[x] for x in w.hashes[a:z][term[a:z] >= 0].tolist() if x in here]
                # no common subsequence is longer than the words that the item has at all
                if len(shared) / reach < MIN_LCS_WITH_ANSWER:
                    continue
                share = longest_shared(reach, shared) / reach
                if share < MIN_LCS_WITH_ANSWER:
                    continue
                wanted, region = self.items.words[item].tolist(), w.hashes[a:z].tolist()
                tail = wanted[-ANSWER_WORDS:]
                answer = any(region[k : k + len(tail)] == tail for k in range(len(region) - len(tail) + 1))
                if share >= MIN_LCS or answer or cosine >= self.min_cosine and reach >= SURE_WORDS:
                    if not cosine:
                        here = np.arange(p.start[passage], p.end[passage])
                        here = here[(term[here] >= 0) & (weight[here] > 0)]
                        vector = weight[here] @ self.basis[term[here]] / max(p.norm[passage], 1e-6)
                        cosine = float((self.latent_items[rows_of[item] : rows_of[item + 1]] @ vector).max())
                    row = (share, answer, cosine, -int(p.start[passage] - first[doc]))
                    best[at + doc, item] = max(best.get((at + doc, item), row), row)
        return best


def _collected(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> list[tuple]:
    rows = benchmark.select(item_id_col, item_text_col).where(F.col(item_text_col).isNotNull()).distinct().orderBy(item_id_col, item_text_col)
    return [tuple(r) for r in rows.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, item_id, first_word, cosine, lcs, answer): a row for each document and benchmark item that it leaks.

    The benchmark is a stated set of items (collected; it is the query set; tasks hold its words, a rank a word and a rank a
    passage of it).  Documents are read in three passes over all of them: document frequencies, the passages of the SVD, the
    search.  A passage cannot reach a cosine above the root of its weight's share on benchmark words, so those below are
    rows of nothing: a bound, not a sample.  A passage in which a run of an item's words begins (see ``gram_size``) is a
    candidate whatever its cosine: stop words weigh nothing, but hide no item.  Null and empty texts and items leak nothing;
    very long texts are searched whole; repeated rows give one row a copy; ties keep the best passage that comes first; other
    columns are ignored; an empty table or benchmark gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    id_type, item_type = rows.schema["id"].dataType, benchmark.schema[item_id_col].dataType
    schema = f"id {id_type.simpleString()}, " + SCHEMA.format(item=item_type.simpleString())
    search = Search.of(rows, "text", _collected(benchmark, item_id_col, item_text_col), min_cosine)
    if search is None:
        return spark.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            best = search.leaks(b.column("text"))
            keys = sorted(best)
            arrays = [
                b.column("id").take(pa.array([d for d, _ in keys], pa.int64())),
                pa.array([search.items.ids[i] for _, i in keys]),
                pa.array([-best[k][3] for k in keys], pa.int64()),
                pa.array([best[k][2] for k in keys], pa.float64()),
                pa.array([best[k][0] for k in keys], pa.float64()),
                pa.array([best[k][1] for k in keys], pa.bool_()),
            ]
            if keys:
                yield pa.RecordBatch.from_arrays(arrays, ["id", "item_id", "first_word", "cosine", "lcs", "answer"])

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """``docs`` (all columns) without the rows that leak a benchmark item.

    Each row goes by its own text where it is read: ids do not matter, and nothing is joined.  Null and empty texts stay; an
    empty benchmark takes nothing; other cases are those of :func:`find_leaks`.
    """
    bound_batches(docs.sparkSession)
    search = Search.of(docs.where(F.col(text_col).isNotNull()), text_col, _collected(benchmark, item_id_col, item_text_col), min_cosine)
    if search is None:
        return docs

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, _ in search.leaks(b.column(text_col))]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
