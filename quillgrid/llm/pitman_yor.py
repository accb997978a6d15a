"""Language-model scoring with a hierarchical Pitman-Yor model over word contexts.

Every word that occurs as the word before is a restaurant of its own; its tables are the customers of the root, whose
base is uniform over the vocabulary and one unknown word.  Seating is sampled by Gibbs sweeps, and predictive
probabilities are averaged over the sweeps that are kept.

A dish (a word pair) with one customer has one table whatever is drawn.  So only pairs that repeat have seats to sample,
and all other totals follow from the counts of words: a restaurant has as many customers as its word has occurrences, and
as many tables less what its repeated pairs save; a word has as many customers in the root as it has occurrences less
what its repeated pairs save.  The state is a table of words and one of repeated pairs, both dealt by hash; they grow with
the corpus, and of neither does anything but totals reach the driver.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import tokens as T
from quillgrid.llm.util import bound_batches, discard, number_of_partitions, stored

#: The hash that stands for the end of a text; it is a token like any word, and the context of the first word.
END = np.uint64(0x6C62272E07BB0142)
#: Gibbs sweeps after the customers have arrived, and how many of them are not kept.
SWEEPS, BURN_IN = 3, 1
#: A sweep draws the seats of dishes of at most this many customers at once, those of larger ones customer by customer:
#: a customer of each dish in one step where there are at least TOGETHER.
AT_ONCE, TOGETHER = 2048, 192
STRENGTH = 1.0
#: Tokens of a block of texts, and of a part of the pair table on average.
BLOCK_TOKENS, PART_TOKENS = 1 << 20, 3 << 20
#: A context with more than one of this many training tokens is dealt over all parts by the word that follows it.
FREQUENT = 10_000
_ODD = np.uint64(0x9FB21C651E98DF25)


# --- bytes of arrays -------------------------------------------------------------------------------------------------
def _squeeze(data: bytes) -> bytes:
    """The length and the compressed bytes: arrays of small counts are moved and stored as a few bits each."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _bytes(value) -> memoryview:
    """What :func:`_squeeze` was given, from a binary value of Arrow or Python."""
    data = pa.py_buffer(value) if isinstance(value, (bytes, bytearray)) else value.as_buffer()
    return memoryview(pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd"))


def _raw(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _pack(x: np.ndarray, kind: str) -> bytes:
    """Squeezed by byte planes: all lowest bytes, then all next ones, since those of indexes and counts are alike."""
    planes = np.frombuffer(_raw(x, kind), np.uint8).reshape(-1, np.dtype(kind).itemsize)
    return _squeeze(planes.T.tobytes())


def _one(value, kind: str) -> np.ndarray:
    planes = np.frombuffer(_bytes(value), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.frombuffer(planes.T.tobytes(), kind)


def _unpack(column, kind: str) -> list[np.ndarray]:
    return [_one(v, kind) for v in column]


def _joined(arrays: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of a schema of ``name type`` pairs (int, long, double or binary)."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, rows)])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def part_of(word: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so rows sorted by word are sorted by part."""
    return (((word >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _cuts(words: np.ndarray, parts: int):
    """(part, first, last) of the stretches of sorted words."""
    part = part_of(words, parts)
    first = _runs(part)
    return zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(words)])


# --- seating ---------------------------------------------------------------------------------------------------------
def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    return (T.mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)) * 2.0**-53


def arrive(customers: np.ndarray, discount: float, new: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Tables after each dish's customers came one after another into an otherwise settled restaurant.

    ``new``: (strength + discount * tables) * parent probability, the weight of a new table.  From the 33rd customer on
    those arrive in parties of an eighth of those seated, and a party's new tables are its expected number rounded up or
    down at random, so a count of a million takes about 120 steps.  It is where the Gibbs sweeps begin.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    at, seated, step = np.flatnonzero(customers > 1), 1, 1
    while len(at):
        party = np.minimum(max(1, seated // 8) if seated >= 32 else 1, customers[at] - seated)
        # a party meets on average what half of it leaves
        q = new[at] / (seated + (party - 1) / 2 - discount * tables[at] + new[at])
        tables[at] += np.floor(party * q + _uniform(seed[at], step))
        seated += max(1, seated // 8) if seated >= 32 else 1
        step += 1
        at = at[customers[at] > seated]
    return np.minimum(tables, customers).astype(np.int64)


def first_sizes(customers: np.ndarray, tables: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Sizes of each dish's tables: one customer each, the others in random proportions."""
    dish = np.repeat(np.arange(len(tables)), tables)
    first = np.cumsum(tables) - tables
    weight = -np.log(1 - _uniform(T.mix(seed[dish] + (np.arange(len(dish)) - first[dish]).astype(np.uint64)), 77))
    total = np.bincount(dish, weight, len(tables))
    sizes = 1 + np.floor((customers - tables)[dish] * weight / np.maximum(total[dish], 1e-300)).astype(np.int64)
    some = tables > 0
    sizes[first[some]] += (customers - np.bincount(dish, sizes, len(tables)).astype(np.int64))[some]
    return sizes


def _at_once(customers: np.ndarray, discount: float, new: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Tables of dishes whose customers are all removed and seated again together, drawn from their joint conditional.

    c customers sit at t tables with a probability in proportion to new ** t times a generalised Stirling number, the sum
    over seatings of the products of what each customer meets.  Numbers of one c give those of the next.
    """
    tables, log_new = np.ones(len(customers), np.int64), np.log(np.maximum(new, 1e-300))
    order = np.argsort(customers, kind="stable")
    first = _runs(customers[order])
    dishes = dict(zip(customers[order[first]].tolist(), np.split(order, first[1:])))
    row, u = np.zeros(1), _uniform(seed, 1)
    for c in range(2, max(dishes, default=0) + 1):
        t = np.arange(1, c)
        opened, joined = np.r_[-np.inf, row], np.r_[row + np.log(c - 1 - discount * t), -np.inf]
        most = np.maximum(opened, joined)
        row = most + np.log1p(np.exp(np.minimum(opened, joined) - most))
        mine, t = dishes.get(c, order[:0]), np.arange(1, c + 1)
        for k in range(0, len(mine), step := max(1, (1 << 16) // c)):
            some = mine[k : k + step]
            weight = row + log_new[some, None] * t
            reach = np.cumsum(np.exp(weight - weight.max(1)[:, None]), 1)
            tables[some] += (reach[:, :-1] <= (u[some] * reach[:, -1])[:, None]).sum(1)
    return tables


def _one_by_one(at: np.ndarray, i: int, new: float, discount: float, seed: int) -> list[int]:
    """Sizes of a dish's tables after customers ``i`` and later have moved; ``at``: the table of each customer.

    The steps of :func:`_in_turn` for a dish that only few others match in size: linear in its customers.
    """
    _, table, sizes = np.unique(at, return_inverse=True, return_counts=True)
    n, sizes, draws = len(at), sizes.tolist(), np.random.default_rng(seed)
    at = table.tolist() if n < 1 << 20 else array("q", table.astype(np.int64).tobytes())
    others = n - 1
    left = at[i]
    sizes[left] -= 1
    while i < n:
        x = draws.random(min(n - i, 1 << 14) + 16) * (others + new)
        whole = x.astype(np.int64)
        for j, part in zip(whole.tolist(), (x - whole).tolist()):
            if j < others:
                joins = at[j] if j < i else at[j + 1]
                if part * sizes[joins] < discount:
                    continue
                sizes[joins] += 1
                at[i] = joins
            elif sizes[left]:
                at[i] = len(sizes)
                sizes.append(1)
            else:
                sizes[left] = 1
            i += 1
            if i == n:
                break
            left = at[i]
            sizes[left] -= 1
    return [k for k in sizes if k]


def _in_turn(c: np.ndarray, sizes: np.ndarray, discount: float, new: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tables, sizes) after each customer was removed and seated again, one after another, in a random order.

    A removed customer's table goes if nobody is left at it.  The customer then sits down at a table of n customers with
    weight n - discount, or at a new one with weight ``new``: the Gibbs conditional, given the restaurant's other totals.
    It follows another customer of the dish, drawn at random, to a table of n with probability 1 - discount / n, and draws
    again if not, so a move looks at no other table.  The k-th customers of all dishes move in one step; when fewer than
    TOGETHER dishes have that many, each goes on by itself.  ``c``: falling.
    """
    total, start = int(c.sum()), np.cumsum(c) - c
    kind = np.int32 if 2 * total < 1 << 31 else np.int64
    # customer g calls its table 2g if it sits there first now, 2g + 1 if it opens it; tables of a dish stay side by side
    label = 2 * (np.cumsum(sizes) - sizes)
    at, seated = np.repeat(label, sizes).astype(kind), np.zeros(2 * total, kind)
    seated[label] = sizes
    dish = np.repeat(np.arange(len(c)), c)
    at = at[np.argsort(dish + _uniform(T.mix(seed[dish] + (np.arange(total) - start[dish]).astype(np.uint64)), 2))]
    others, all_weight = c - 1, c - 1 + new
    step, m = 0, len(c)
    while m >= TOGETHER:
        here = start[:m] + step
        seated[at[here]] -= 1
        wait, tried = np.arange(m), 0
        while len(wait):
            x = _uniform(seed[wait], 3 + step * 0x10001 + tried) * all_weight[wait]
            j = x.astype(np.int64)
            opens = j >= others[wait]
            joins = np.where(opens, 2 * here[wait] + 1, at[start[wait] + np.where(opens, 0, j + (j >= step))])
            sits = opens | ((x - j) * seated[joins] >= discount)
            done = wait[sits]
            at[here[done]] = joins[sits]
            seated[joins[sits]] += 1
            wait, tried = wait[~sits], tried + 1
        step += 1
        m = int(np.searchsorted(-c, -step, "left"))
    for r in range(m):
        a, z = int(start[r]), int(start[r] + c[r])
        left = _one_by_one(at[a:z], step, float(new[r]), discount, int(seed[r]))
        seated[2 * a : 2 * z] = 0
        seated[2 * a : 2 * a + len(left)] = left
    live = np.flatnonzero(seated)
    return np.diff(np.searchsorted(live, 2 * np.r_[start, total])), seated[live].astype(np.int64)


def gibbs(customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, discount: float, new: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tables, sizes) after every customer of each dish has been removed and seated again.

    Dishes of at most AT_ONCE customers are drawn as a whole, whatever their seats were; since only their number of tables
    is used then, the first table is given all whom the others do not need.  Customers of larger dishes move in turn.
    """
    seed = T.mix(seed ^ _ODD)
    few = (customers > 1) & (customers <= AT_ONCE)
    many = np.flatnonzero(customers > AT_ONCE)
    many = many[np.argsort(-customers[many], kind="stable")]
    t = tables[many].astype(np.int64)
    slots = np.repeat((np.cumsum(tables) - tables)[many] - (np.cumsum(t) - t), t) + np.arange(t.sum())
    t, moved = _in_turn(customers[many].astype(np.int64), sizes[slots].astype(np.int64), discount, new[many], seed[many])
    tables = np.minimum(customers, 1).astype(np.int64)
    tables[few] = _at_once(customers[few], discount, new[few], seed[few])
    tables[many] = t
    out, first = np.ones(int(tables.sum()), np.int64), np.cumsum(tables) - tables
    out[first[few]] = (customers - tables + 1)[few]
    out[np.repeat(first[many] - (np.cumsum(t) - t), t) + np.arange(len(moved))] = moved
    return tables, out


def _chosen(first: np.ndarray, tables_a: np.ndarray, sizes_a: np.ndarray, tables_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables and sizes of ``a`` for dishes where ``first`` holds, of ``b`` for the others."""
    dish_a, dish_b = (np.repeat(np.arange(len(t)), t) for t in (tables_a, tables_b))
    keep_a, keep_b = first[dish_a], ~first[dish_b]
    order = np.argsort(np.r_[dish_a[keep_a], dish_b[keep_b]], kind="stable")
    return np.where(first, tables_a, tables_b), np.r_[sizes_a[keep_a], sizes_b[keep_b]][order]


# --- blocks of texts -------------------------------------------------------------------------------------------------
def token_hashes(w: T.Words) -> np.ndarray:
    """Hashes of all tokens, the end of each text included."""
    counts = w.per_doc
    out = np.empty(len(w.hashes) + w.n_docs, np.uint64)
    out[np.arange(len(w.hashes)) + w.doc] = w.hashes
    out[np.cumsum(counts) + np.arange(w.n_docs)] = END
    return out


def blocks_of(rows: DataFrame, id_type: str) -> DataFrame:
    """(block, ids, held, lengths, words, token): texts in blocks of about BLOCK_TOKENS tokens, as indexes of sorted words."""
    schema = f"block long, ids array<{id_type}>, held binary, lengths binary, words binary, token binary"

    def run(batches):
        from pyspark import TaskContext

        block, table = TaskContext.get().partitionId() << 32, T.translation()

        def made(ids: pa.Array, held: np.ndarray, got: list) -> pa.RecordBatch:
            words, token = np.unique(np.concatenate([h for h, _ in got]), return_inverse=True)
            lengths = np.concatenate([n for _, n in got])
            columns = [_pack(held, "u1"), _pack(lengths, "<i8"), _pack(words, "<u8"), _pack(token, "<i4")]
            offsets = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(offsets, ids), *(pa.array([c], pa.binary()) for c in columns)], ["block", "ids", "held", "lengths", "words", "token"])

        for b in batches:
            held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            begin, got, size, end = 0, [], 0, 0
            for at, data, bounds in T.slices(b.column("text")):
                if size >= BLOCK_TOKENS:
                    yield made(b.column("id").slice(begin, at - begin), held[begin:at], got)
                    begin, got, size, block = at, [], 0, block + 1
                w = T.words(data, bounds, table)
                got.append((token_hashes(w), w.per_doc + 1))
                size += len(got[-1][0])
                end = at + w.n_docs
            if got:
                yield made(b.column("id").slice(begin, end - begin), held[begin:end], got)
                block += 1

    return rows.mapInArrow(run, schema)


@dataclass
class Block:
    """One row of :func:`blocks_of`."""

    held: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, table, r: int) -> Block:
        held, lengths, words, token = (_one(table.column(c)[r], k) for c, k in (("held", "u1"), ("lengths", "<i8"), ("words", "<u8"), ("token", "<i4")))
        return cls(held.astype(bool), lengths, words, token.astype(np.int64))

    @property
    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def counts(self) -> np.ndarray:
        """Training occurrences of each word of the block."""
        return np.bincount(self.token[self.trained], minlength=len(self.words)).astype(np.int64)

    def pairs(self, frequent: np.ndarray, parts: int) -> Pairs:
        before = np.r_[np.searchsorted(self.words, END), self.token[:-1]]
        unique, of_token = np.unique((before << 32) | self.token, return_inverse=True)
        u, w = unique >> 32, unique & 0xFFFFFFFF
        trained = np.bincount(of_token[self.trained], minlength=len(u)).astype(np.int64)
        own = part_of(self.words, parts)[u]
        spread = part_of(T.mix(self.words[w] ^ (self.words[u] * _ODD)), parts)
        part = np.where(np.isin(self.words, frequent)[u], spread, own)
        return Pairs(u, w, trained, part, np.argsort(part, kind="stable"), of_token)


@dataclass
class Pairs:
    """Distinct (context, word) of a block as indexes of its words; ``order`` deals them to parts."""

    u: np.ndarray
    w: np.ndarray
    trained: np.ndarray
    part: np.ndarray
    order: np.ndarray
    of_token: np.ndarray

    def dealt(self):
        """(part, indexes of its pairs)."""
        part = self.part[self.order]
        first = _runs(part)
        return zip(part[first].tolist(), np.split(self.order, first[1:]))


ASK = "wpart long, owner long, words binary, counts binary"
WORDS = "kind int, wpart long, part long, words binary, counts binary, customers binary, tables binary, seats binary, sizes binary, history binary, n_words long, n_customers long, n_tables long, one long, two long"
SENT = "part long, block long, contexts binary, runs binary, words binary, n binary"
PAIRS = "kind int, part long, block long, wpart long, vocabulary binary, u binary, w binary, counts binary, tables binary, sizes binary, history binary, one long, two long"


def _asks(blocks: DataFrame, parts: int, with_counts: bool) -> DataFrame:
    """What each block asks of each part of the words: all its words there (and how often it trains them)."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = Block.of(b, r)
                n = x.counts() if with_counts else np.zeros(0, np.int64)
                block = b.column("block")[r].as_py()
                yield _batch(ASK, [(part, block, _pack(x.words[a:z], "<u8"), _pack(n[a:z], "<i8")) for part, a, z in _cuts(x.words, parts)])

    return blocks.select("block", "held", "lengths", "words", "token").mapInArrow(run, ASK)


def count_words(blocks: DataFrame, parts: int) -> DataFrame:
    """One row a part: its words that are trained, sorted, with their exact counts."""

    def merge(table: pa.Table) -> pa.Table:
        words, n = _joined(_unpack(table.column("words"), "<u8"), "<u8"), _joined(_unpack(table.column("counts"), "<i8"), "<i8")
        words, n = words[n > 0], n[n > 0]
        order = np.argsort(words)
        words, n = words[order], n[order]
        first = _runs(words)
        words, n = words[first], np.add.reduceat(n, first) if len(first) else n
        c, none = _pack(n, "<i8"), _squeeze(b"")
        return _table(WORDS, [(0, table.column("wpart")[0].as_py(), None, _pack(words, "<u8"), c, c, c, none, none, none, len(words), int(n.sum()), 0, 0, 0)])

    return _asks(blocks, parts, True).groupBy("wpart").applyInArrow(merge, WORDS)


def frequent_words(words: DataFrame, total: int, share: int = FREQUENT) -> np.ndarray:
    """Sorted words with more than 1/share of all training tokens: at most ``share``."""

    def run(batches):
        for b in batches:
            for w, n in zip(_unpack(b.column("words"), "<u8"), _unpack(b.column("counts"), "<i8")):
                yield pa.RecordBatch.from_arrays([pa.array(w[n * share > total].view(np.int64))], ["word"])

    rows = words.select("words", "counts").mapInArrow(run, "word long").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def repeated_pairs(blocks: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """kind 0: a part's pairs that are trained twice or more; kind 1: for each block, which of the pairs it sent are such.

    A pair that a block trains and that is not named in the answer occurs once; a pair it does not train and that is not
    named was never trained.
    """

    def send(batches):
        for b in batches:
            for r in range(b.num_rows):
                x, block = Block.of(b, r), b.column("block")[r].as_py()
                p = x.pairs(frequent, parts)
                rows = []
                for part, at in p.dealt():
                    u = p.u[at]
                    first = _runs(u)
                    runs = np.diff(np.r_[first, len(u)])
                    rows.append((part, block, _pack(x.words[u[first]], "<u8"), _pack(runs, "<u4"), _pack(x.words[p.w[at]], "<u8"), _pack(p.trained[at], "<u4")))
                yield _batch(SENT, rows)

    def merge(table: pa.Table) -> pa.Table:
        part, blocks_ = table.column("part")[0].as_py(), table.column("block").to_pylist()
        u = np.concatenate([np.repeat(c, n) for c, n in zip(_unpack(table.column("contexts"), "<u8"), _unpack(table.column("runs"), "<u4"))])
        each = _unpack(table.column("words"), "<u8")
        bounds = np.cumsum([0, *map(len, each)])
        w, n = np.concatenate(each), np.concatenate(_unpack(table.column("n"), "<u4")).astype(np.int64)
        order = np.lexsort((w, u))
        su, sw = u[order], w[order]
        first = _runs(su, sw)
        count = np.add.reduceat(n[order], first)
        many = count >= 2
        number = np.where(many, np.cumsum(many) - 1, -1)
        size = np.diff(np.r_[first, len(order)])
        dish, total = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        dish[order], total[order] = np.repeat(number, size), np.repeat(count, size)
        once = (n == 0) & (total == 1)
        rows = []
        for k, block in enumerate(blocks_):
            here, single = dish[bounds[k] : bounds[k + 1]], once[bounds[k] : bounds[k + 1]]
            # pairs are sorted in a block and in a part alike, so places and dishes grow
            at, one = np.flatnonzero(here >= 0), np.flatnonzero(single)
            if len(at) + len(one):
                rows.append((1, part, block, None, None, *(_pack(np.diff(x, prepend=0), "<i4") for x in (at, here[at], one)), None, None, None, 0, 0))
        du, dw, c = su[first][many], sw[first][many], count[many]
        vocabulary = np.unique(np.r_[du, dw])
        # everybody at one table until the customers arrive
        places = [_pack(np.searchsorted(vocabulary, x), "<i4") for x in (du, dw)]
        rows.append((0, part, None, None, _pack(vocabulary, "<u8"), *places, _pack(c, "<i8"), _pack(np.ones(len(c)), "<i8"), _pack(c, "<i8"), _squeeze(b""), int(c.sum()), int((c == 2).sum())))
        return _table(PAIRS, rows)

    return blocks.select("block", "held", "lengths", "words", "token").mapInArrow(send, SENT).groupBy("part").applyInArrow(merge, PAIRS)


@dataclass
class Model:
    """Totals that tasks need; tables of words and pairs hold the rest."""

    parts: int
    vocabulary: int
    train_tokens: int
    root_discount: float = 0.8
    discount: float = 0.8
    strength: float = STRENGTH
    #: customers and tables of the root after each kept sweep and, last, now
    customers: tuple[float, ...] = ()
    tables: tuple[float, ...] = ()
    kept_last: bool = False

    def root(self, x: np.ndarray, k: int = -1) -> np.ndarray:
        """Root probabilities of words whose customers less discounted tables are ``x``."""
        base = (self.strength + self.root_discount * self.tables[k]) / (self.vocabulary + 1)
        return (x + base) / (self.customers[k] + self.strength)


def update_words(words: DataFrame, saved: DataFrame, m: Model, sweep: int, keep: bool) -> DataFrame:
    """A sweep over the root: kind 0 are the words' new rows, kind 1 the answers to the parts of the pairs.

    Before the first sweep (below zero) nobody is seated.  ``saved`` (wpart, part, vocabulary, u, w): what the repeated pairs of a part save in customers, as contexts and as words.
    """
    d = m.root_discount

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table(WORDS, [])
        word, count, old, tables, sizes = (_unpack(left.column(c), k)[0] for c, k in (("words", "<u8"), ("counts", "<i8"), ("customers", "<i8"), ("seats", "<i8"), ("sizes", "<i8")))
        asked = [np.searchsorted(word, v) for v in _unpack(right.column("vocabulary"), "<u8")]
        saves = []
        for name in ("w", "u"):
            got = _unpack(right.column(name), "<i8")
            at, amount = _joined(asked, "<i8").astype(np.int64), _joined(got, "<i8")
            saves.append(np.bincount(at, amount, len(word)).astype(np.int64))
        customers, served = count - saves[0], count - saves[1]
        if sweep < 0:
            tables, sizes = np.minimum(customers, 1), customers
        else:
            new = np.full(len(word), (m.strength + d * m.tables[-1]) / (m.vocabulary + 1))
            seed = T.mix(word + np.uint64(sweep + 1) * _ODD)
            again = customers != old
            drawn = arrive(np.where(again, customers, 0), d, new, seed)
            fresh = first_sizes(np.where(again, customers, 0), drawn, seed)
            tables, sizes = _chosen(again, drawn, fresh, tables, sizes)
            tables, sizes = gibbs(customers, tables, sizes, d, new, seed)
        x = (customers - d * tables).astype(np.float32)
        history = bytes(_bytes(left.column("history")[0]))
        if keep:
            history += _raw(x, "<f4") + _raw(served, "<i8")
        rows = [(0, left.column("wpart")[0].as_py(), None, _pack(word, "<u8"), _pack(count, "<i8"), _pack(customers, "<i8"), _pack(served, "<i8"), _pack(tables, "<i8"), _pack(sizes, "<i8"), _squeeze(history), len(word), int(customers.sum()), int(tables.sum()), int((customers == 1).sum()), int((customers == 2).sum()))]
        for part, at in zip(right.column("part").to_pylist(), asked):
            rows.append((1, left.column("wpart")[0].as_py(), part, None, _pack(count[at], "<i8"), _pack(x[at], "<f4"), _pack(served[at], "<i8"), *[None] * 3, *[0] * 5))
        return _table(WORDS, rows)

    return words.groupBy("wpart").cogroup(saved.groupBy("wpart")).applyInArrow(run, WORDS)


def update_pairs(pairs: DataFrame, answers: DataFrame | None, m: Model, sweep: int, keep: bool) -> DataFrame:
    """A sweep over the restaurants of contexts: kind 0 are the pairs' new rows, kind 2 what they save, to the words.

    Without ``answers`` nobody moves.  The first sweep lets the customers arrive, those after are Gibbs sweeps.
    """

    def moved(row: pa.Table, told: pa.Table | None) -> list[tuple]:
        vocabulary, u, w, c, tables, sizes = (_unpack(row.column(x), k)[0] for x, k in (("vocabulary", "<u8"), ("u", "<i4"), ("w", "<i4"), ("counts", "<i8"), ("tables", "<i8"), ("sizes", "<i8")))
        if told is not None and len(c):
            told = told.sort_by("wpart")
            x, served = _joined(_unpack(told.column("customers"), "<f4"), "<f4").astype(np.float64), _joined(_unpack(told.column("tables"), "<i8"), "<i8")
            new = (m.strength + m.discount * served[u]) * m.root(x)[w]
            seed = T.mix(vocabulary[u] * _ODD + T.mix(vocabulary[w] + np.uint64(sweep)))
            if sweep == 0:
                tables = arrive(c, m.discount, new, seed)
                sizes = first_sizes(c, tables, seed)
            else:
                tables, sizes = gibbs(c, tables, sizes, m.discount, new, seed)
        part = row.column("part")[0].as_py()
        history = _squeeze(bytes(_bytes(row.column("history")[0])) + (_raw(tables, "<i8") if keep else b""))
        out = [(0, part, None, None, _pack(vocabulary, "<u8"), _pack(u, "<i4"), _pack(w, "<i4"), _pack(c, "<i8"), _pack(tables, "<i8"), _pack(sizes, "<i8"), history, 0, 0)]
        saves = [np.bincount(i, c - tables, len(vocabulary)).astype(np.int64) for i in (u, w)]
        for wpart, a, z in _cuts(vocabulary, m.parts):
            out.append((2, part, None, wpart, _pack(vocabulary[a:z], "<u8"), *(_pack(s[a:z], "<i8") for s in saves), *[None] * 4, 0, 0))
        return out

    if answers is None:
        return pairs.where("kind = 0").groupBy("part").applyInArrow(lambda row: _table(PAIRS, moved(row, None)), PAIRS)

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        return _table(PAIRS, moved(row, told) if row.num_rows else [])

    return pairs.where("kind = 0").groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, PAIRS)


@dataclass
class Fitted:
    """A model with its tables; :func:`predict` deletes them."""

    model: Model
    blocks: DataFrame
    words: DataFrame
    pairs: DataFrame
    sent: DataFrame
    frequent: np.ndarray


def _discount(one: int, two: int) -> float:
    return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5


def fit(blocks: DataFrame, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> Fitted:
    """Gibbs sweeps; discounts come from how many dishes have one and two customers at each level.

    All customers of a task's dishes move given the totals of the sweep before, as in samplers that are distributed by
    documents; each sweep is two joins of a few arrays a part.
    """
    spark = blocks.sparkSession
    n_tokens = blocks.agg(F.sum(F.octet_length("token"))).first()[0] or 0
    parts = max(number_of_partitions(spark), -(-n_tokens // 4 // PART_TOKENS))
    words = stored(count_words(blocks, parts), "words")
    v, n = words.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_customers"), F.lit(0))).first()
    m = Model(parts, v, n)
    frequent = frequent_words(words, n)
    sent = stored(repeated_pairs(blocks, frequent, parts), "pairs")
    repeated, twice = sent.agg(F.coalesce(F.sum("one"), F.lit(0)), F.coalesce(F.sum("two"), F.lit(0))).first()
    m.discount = _discount(n - repeated, twice)
    pairs = stored(update_pairs(sent, None, m, -1, False), "seats")

    def at_root(sweep: int, keep: bool) -> None:
        nonlocal words
        saved = pairs.where("kind = 2").select("wpart", "part", "vocabulary", "u", "w")
        new = stored(update_words(words.where("kind = 0"), saved, m, sweep, keep), "words")
        discard(words)
        words = new
        customers, tables, one, two = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_customers", "n_tables", "one", "two")]).first()
        if sweep < 0:
            m.root_discount = _discount(one, two)
        before = (m.customers, m.tables) if m.kept_last else (m.customers[:-1], m.tables[:-1])
        m.customers, m.tables, m.kept_last = (*before[0], float(customers)), (*before[1], float(tables)), keep

    at_root(-1, False)
    for sweep in range(sweeps + 1):
        keep = sweep > burn_in
        new = stored(update_pairs(pairs, words.where("kind = 1"), m, sweep, keep), "seats")
        discard(pairs)
        pairs = new
        at_root(sweep, keep)
    return Fitted(m, blocks, words, pairs, sent, frequent)


ANSWER = "block long, part long, kind int, counts binary, history binary, places binary"


def predict(fitted: Fitted, id_type: str) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every text of the blocks."""
    m, frequent = fitted.model, fitted.frequent
    parts, d = m.parts, m.discount
    kept = len(m.tables)

    def words_told(asked: pa.Table, own: pa.Table) -> pa.Table:
        """Counts and history of the words that a block asks for; a word that was not trained has none."""
        rows = []
        if own.num_rows:
            word, count, history = _unpack(own.column("words"), "<u8")[0], _unpack(own.column("counts"), "<i8")[0], _unpack(own.column("history"), "u1")[0]
        for block, wanted in zip(asked.column("owner").to_pylist(), _unpack(asked.column("words"), "<u8")):
            n, out = np.zeros(len(wanted), np.int64), []
            if own.num_rows and len(word):
                at = np.minimum(np.searchsorted(word, wanted), len(word) - 1)
                known = word[at] == wanted
                n = np.where(known, count[at], 0)
                for k in range(kept):
                    x, served = np.frombuffer(history[12 * len(word) * k :], "<f4", len(word)), np.frombuffer(history[12 * len(word) * k + 4 * len(word) :], "<i8", len(word))
                    out += [_raw(np.where(known, x[at], 0), "<f4"), _raw(np.where(known, served[at], 0), "<i8")]
            else:
                out = [_raw(np.zeros(len(wanted)), t) for _ in range(kept) for t in ("<f4", "<i8")]
            rows.append((block, asked.column("wpart")[0].as_py(), 0, _pack(n, "<i8"), _squeeze(b"".join(out)), None))
        return _table(ANSWER, rows)

    def pairs_told(asked: pa.Table, own: pa.Table) -> pa.Table:
        """Counts and tables of the pairs that a block sent and that the model names."""
        rows = []
        if own.num_rows:
            count, history = _unpack(own.column("counts"), "<i8")[0], np.frombuffer(_bytes(own.column("history")[0]), "<i8").reshape(kept, -1)
        for r in range(asked.num_rows):
            at, dish, one = (np.cumsum(_one(asked.column(c)[r], "<i4")) for c in ("u", "w", "counts"))
            n, t = (np.concatenate([known, np.ones((*known.shape[:-1], len(one)), np.int64)], -1) for known in ((count[dish], history[:, dish]) if len(dish) else (np.zeros(0, np.int64), np.zeros((kept, 0), np.int64))))
            rows.append((asked.column("block")[r].as_py(), asked.column("part")[r].as_py(), 1, _pack(n, "<i8"), _pack(t, "<i8"), _pack(np.r_[at, one], "<i4")))
        return _table(ANSWER, rows)

    of_words = _asks(fitted.blocks, parts, False).groupBy("wpart").cogroup(fitted.words.where("kind = 0").select("wpart", "words", "counts", "history").groupBy("wpart")).applyInArrow(words_told, ANSWER)
    sent = fitted.sent.where("kind = 1").select("part", "block", "u", "w", "counts")
    of_pairs = sent.groupBy("part").cogroup(fitted.pairs.where("kind = 0").select("part", "counts", "history").groupBy("part")).applyInArrow(pairs_told, ANSWER)
    told = stored(of_words.unionByName(of_pairs), "answers")
    for df in (fitted.words, fitted.pairs, fitted.sent):
        discard(df)

    def score_block(block: pa.Table, answers: pa.Table) -> pa.Table:
        x = Block.of(block, 0)
        p = x.pairs(frequent, parts)
        kind = answers.column("kind").to_numpy()
        words_ = answers.filter(pa.array(kind == 0)).sort_by("part")
        count = _joined(_unpack(words_.column("counts"), "<i8"), "<i8")
        root, served = np.zeros((kept, len(x.words))), np.zeros((kept, len(x.words)))
        at = 0
        for n, h in zip(_unpack(words_.column("counts"), "<i8"), _unpack(words_.column("history"), "u1")):
            for k in range(kept):
                root[k, at : at + len(n)] = np.frombuffer(h[12 * len(n) * k :], "<f4", len(n))
                served[k, at : at + len(n)] = np.frombuffer(h[12 * len(n) * k + 4 * len(n) :], "<i8", len(n))
            at += len(n)
        # a pair that is not named was trained here and nowhere else, or never
        once = (p.trained > 0).astype(np.int64)
        c, t = once.copy(), np.repeat(once[None, :], kept, 0)
        dealt = dict(p.dealt())
        named = answers.filter(pa.array(kind == 1))
        for part, n, h, place in zip(named.column("part").to_pylist(), *(_unpack(named.column(x), k) for x, k in (("counts", "<i8"), ("history", "<i8"), ("places", "<i4")))):
            where = dealt[part][place]
            c[where], t[:, where] = n, h.reshape(kept, -1)
        total = np.zeros(len(c))
        for k in range(kept):
            total += (c - d * t[k] + (m.strength + d * served[k][p.u]) * m.root(root[k], k)[p.w]) / (count[p.u] + m.strength)
        log_p = np.log10(total / kept)
        doc = np.repeat(np.arange(len(x.lengths)), x.lengths)
        score_ = np.bincount(doc, log_p[p.of_token], len(x.lengths))
        base = np.bincount(doc, np.log10((count + 1) / (m.train_tokens + m.vocabulary + 1))[x.token], len(x.lengths))
        known = np.bincount(doc, (count > 0)[x.token], len(x.lengths))
        ids = block.column("ids").combine_chunks().flatten()
        columns = {"n_tokens": x.lengths, "n_known": known.astype(np.int64), "train_tokens": np.full(len(x.lengths), m.train_tokens), "base_score": base, "score": score_, "perplexity": 10 ** (-score_ / x.lengths)}
        return pa.table({"id": ids, **{k: pa.array(v) for k, v in columns.items()}})

    schema = f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    scored = stored(fitted.blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score_block, schema), "scores")
    discard(told)
    discard(fitted.blocks)
    return scored


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text, learned from rows where not ``held_out``.

    Tokens are words after lower-casing A-Z, then one end; a word is known by its 64-bit hash.  base_score: log10 of the
    add-one unigram probability; score: log10 of the model's probability, averaged over kept sweeps token by token;
    perplexity: 10 to the power of minus the score a token.  Texts are blocks of arrays; a block asks the tables of words
    and of pairs for what it holds and scores its texts itself, so no word, pair or text gathers anywhere.  Null and empty
    texts are one end; repeated rows are scored each; a null ``held_out`` counts as false; without training rows every
    token has probability 1, as in the base; other columns are ignored; an empty table gives no rows.  A very long text must fit in
    a task (about 30 bytes a byte of text).  All tables but the result are deleted.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    id_type = rows.schema["id"].dataType.simpleString()
    fitted = fit(stored(blocks_of(rows, id_type), "blocks"), sweeps, burn_in)
    return predict(fitted, id_type)
