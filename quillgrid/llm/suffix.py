"""Repeated-substring removal by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts earlier.  Candidates are found by winnowing:
every window of ``length`` bytes selects its smallest k-gram as anchor, so both copies of a repeated window select the
same anchor at the same place.  Only contexts of anchors that occur with different surroundings need their bytes
compared; equal surroundings are settled by their hash.  The contexts that share anchors are split into shards, each
shard gets a Burrows-Wheeler transform, and the transforms are merged by refining the interleave of the shards symbol by
symbol; the refinement also yields how far neighbours agree, hence the repeated intervals, without sorting all suffixes
again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import tokens as T
from quillgrid.llm.util import BATCH_BYTES, bound_batches, number_of_partitions, stored

LENGTH = 100
#: Bytes of an anchor; a window of LENGTH bytes holds LENGTH - GRAM + 1 of them.
GRAM = 36
#: Bytes of a symbol of the transform; it divides LENGTH.
SYMBOL = 25
SHARDS = 8
#: Contexts merged at once; larger anchor groups are cut by :func:`families`.
CHUNK_CONTEXTS = 2048


class PrefixHash:
    """64-bit hashes of any stretch of a byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power, self.inverse = T._powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(T._byte_values()[data] * power[:n], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return T.mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` bytes."""
        m = len(self.total) - size
        return T.mix((self.total[size:] - self.total[:m]) * self.inverse[:m]) if m > 0 else np.zeros(0, np.uint64)


def _sliding(f, x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (size - span)], x[size - span :]) if span < size else x


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM, hashes: PrefixHash | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, text) of the k-grams that are smallest in some window inside a text; all of equal ones."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = hashes or PrefixHash(data)
    full = hashes.all(gram)
    width = length - gram + 1
    if len(full) < width:
        return none
    short = (full >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    least = _sliding(np.minimum, short, width)
    #: windows that leave their text select nothing
    sizes = np.diff(bounds)
    inside = np.zeros(len(data) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, (bounds[1:] - length + 1)[long], -1)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint32(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    chosen = np.flatnonzero(short == _sliding(np.maximum, padded, width)[: len(short)])
    return chosen, full[chosen], np.searchsorted(bounds, chosen, "right") - 1


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable argsort of small non-negative integers: radix sort by 16 bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and int(values.max()) >> 16:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def symbol_ranks(data: np.ndarray, bounds: np.ndarray, symbol: int = SYMBOL) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all texts: (rank of the symbol that starts there, or 0 for an end; index of the row ``symbol`` bytes before, or -1).

    A text of n bytes has n + 1 rows: a suffix for each place with a whole symbol, and ends for the chains of the
    other places.  Ranks need only tell symbols apart, so they are ranks of hashes.
    """
    sizes = np.diff(bounds)
    n_rows = sizes + symbol
    first = np.cumsum(n_rows) - n_rows
    text = np.repeat(np.arange(len(sizes)), n_rows)
    place = np.arange(len(text)) - first[text]
    whole = place + symbol <= sizes[text]
    rank = np.zeros(len(text), np.int64)
    if whole.any():
        start = bounds[text[whole]] + place[whole]
        hashes = PrefixHash(data).of(start, start + symbol)
        _, inverse = np.unique(hashes, return_inverse=True)
        rank[whole] = inverse + 1
    before = np.where(place >= symbol, np.arange(len(text)) - symbol, -1)
    return rank, before


def shard_transform(rank: np.ndarray, before: np.ndarray, depth: int, symbol: int = SYMBOL) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, transform) of one shard; the order is by the first ``depth`` symbols, which is as deep as a merge looks."""
    n = len(rank)
    order = np.arange(n)
    for k in reversed(range(depth)):
        at = np.arange(n) + k * symbol
        # past a chain's end there is only the end symbol
        value = np.where(at < n, rank[np.minimum(at, n - 1)], 0)
        ended = np.zeros(n, bool)
        for j in range(k):
            ended |= rank[np.minimum(np.arange(n) + j * symbol, n - 1)] == 0
        value = np.where(ended, 0, value)
        order = order[_stable_order(value[order])]
    previous = before[order]
    return order, np.where(previous >= 0, rank[np.maximum(previous, 0)], 0)


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards and block starts after ``depth`` refinements.

    The interleave names the shard of each row.  A refinement reads the shards' transforms in the order of the
    interleave and deals the rows stably by the symbol read, which orders them by one symbol more.  Two rows part in
    the round in which their symbols, or the blocks they were read from, differ; blocks that are left agree in
    ``depth`` symbols at least.
    """
    together = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(together), np.int64)
    for _ in range(depth):
        read = np.empty(len(together), together.dtype)
        read[np.argsort(shard, kind="stable")] = together
        order = _stable_order(read)
        shard, read, block = shard[order], read[order], block[order]
        begins = np.r_[True, (read[1:] != read[:-1]) | (block[1:] != block[:-1])] if len(read) else np.zeros(0, bool)
        block = np.cumsum(begins) - 1
    return shard, block


def repeated_starts(data: np.ndarray, bounds: np.ndarray, key: np.ndarray, length: int = LENGTH, symbol: int = SYMBOL, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of windows of ``length`` bytes that equal a window at a smaller (key of the text + place)."""
    depth = length // symbol
    rank, before = symbol_ranks(data, bounds, symbol)
    n_rows = np.diff(bounds) + symbol
    first = np.cumsum(n_rows) - n_rows
    cuts = np.unique(np.linspace(0, len(n_rows), min(shards, len(n_rows)) + 1).astype(int))
    orders, transforms = [], []
    for a, z in zip(cuts[:-1], cuts[1:]):
        lo, hi = first[a], first[z] if z < len(first) else len(rank)
        order, transform = shard_transform(rank[lo:hi], np.where(before[lo:hi] >= 0, before[lo:hi] - lo, -1), depth, symbol)
        orders.append(order + lo)
        transforms.append(transform)
    shard, block = merge_transforms(transforms, depth)
    row = np.empty(len(rank), np.int64)
    row[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    text = np.searchsorted(first, row, "right") - 1
    place = row - first[text]
    whole = place + length <= np.diff(bounds)[text]
    row, text, place, block = row[whole], text[whole], place[whole], block[whole]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    at = key[text] + place
    least = np.repeat(np.minimum.reduceat(at, cut), np.diff(np.r_[cut, len(at)]))
    later = at > least
    return text[later], place[later]


def _extended_key(key: np.ndarray, data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """``key`` extended by the ``width`` bytes of ``data`` from ``at`` on."""
    values, key = T._byte_values(), T.mix(key + np.uint64(width))
    for k in range(width):
        key = T.mix(key ^ values[data[at + k]])
    return key


def families(data: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor_at: np.ndarray, key: np.ndarray, length: int, reach: int, most: int):
    """Yield (rows, first, last, keys): contexts whose windows from ``first`` to ``last`` (starts relative to the anchor) are to be compared.

    Context i is ``data[begin[i]:end[i]]`` with its anchor at ``anchor_at[i]``.  All windows from a to b hold the bytes from
    b to a + length, on which a group agrees.  A group of more than ``most`` contexts is cut: windows of the left half also
    hold bytes before these, those of the right half bytes behind them, and windows can be equal only where these bytes
    are.  Every cut halves the windows, so in the end a family is one window a context and its key settles it.
    """
    todo = [(np.arange(len(key)), key, -reach, 0)]
    while todo:
        rows, key, a, b = todo.pop()
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]) if len(key) else np.zeros(0, np.int64)
        large = np.repeat(size > most, size)
        if a == b or not large.any():
            yield rows, a, b, key
            continue
        yield rows[~large], a, b, key[~large]
        rows, key, m = rows[large], key[large], (a + b - 1) // 2
        left = begin[rows] <= anchor_at[rows] + m
        right = end[rows] >= anchor_at[rows] + m + 1 + length
        todo.append((rows[left], _extended_key(key[left], data, anchor_at[rows[left]] + m, b - m), a, m))
        todo.append((rows[right], _extended_key(key[right], data, anchor_at[rows[right]] + a + length, m + 1 - a), m + 1, b))


def _merged(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals by group; touching ones join."""
    if not len(start):
        return group, start, end
    order = np.lexsort((start, group))
    start, end, group = start[order], end[order], group[order]
    #: running maximum of ends within a group: groups are set apart by an offset
    g = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + g * span) - g * span
    begins = np.r_[True, (start[1:] > reach[:-1]) | (g[1:] != g[:-1])]
    first = np.flatnonzero(begins)
    return group[first], start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]


def _first_of_equal(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, context, document and place; which rows of that order are later than the first of their context)."""
    order = np.lexsort((place, doc, context, anchor))
    a, c, d, p = anchor[order], context[order], doc[order], place[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return order, (d != d[first]) | (p != p[first])


def _lists(values: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[cut, len(values)], pa.int32()), pa.array(values, kind))


def find_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, start, end): stretches of the texts of ``docs`` (id long, text) that repeat earlier ones; they may overlap."""
    bound_batches(docs.sparkSession, 2 * BATCH_BYTES)
    parts = number_of_partitions(docs.sparkSession)
    reach = length - gram

    def select(batches):
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            got = []
            for at, data, bounds in T.slices(b.column("text")):
                hashes = PrefixHash(data)
                place, anchor, doc = anchors(data, bounds, length, gram, hashes)
                lo, hi = np.maximum(place - reach, bounds[doc]), np.minimum(place + length, bounds[doc + 1])
                context = T.mix(hashes.of(lo, hi) ^ T.mix((place - lo).astype(np.uint64)))
                got.append((anchor, context, ids[doc + at], place - bounds[doc]))
            if not got:
                continue
            anchor, context, doc, place = (np.concatenate(c) for c in zip(*got))
            # equal contexts of this batch: all but the first are repeats whatever other batches hold
            order, later = _first_of_equal(anchor, context, doc, place)
            spans = _merged(np.maximum(place[order][later] - reach, 0), place[order][later] + length, doc[order][later])
            keep = order[~later]
            part = (anchor[keep] % np.uint64(parts)).astype(np.int64)
            keep = keep[np.argsort(part, kind="stable")]
            part = np.sort(part)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            m, e = len(cut), lambda kind: pa.array([[]] * m, pa.list_(kind))  # noqa: B023
            span_part = pa.array([abs(int(ids[0])) % parts], pa.int64())
            columns = [
                pa.concat_arrays([pa.array(part[cut], pa.int64()), span_part]),
                *(pa.concat_arrays([_lists(v[keep].view(np.int64) if v.dtype == np.uint64 else v[keep].astype(np.int64), cut, pa.int64()), pa.array([[]], pa.list_(pa.int64()))]) for v in (anchor, context, doc)),
                pa.concat_arrays([_lists(place[keep].astype(np.int32), cut, pa.int32()), pa.array([[]], pa.list_(pa.int32()))]),
                *(pa.concat_arrays([e(pa.int64()), pa.array([v.astype(np.int64)], pa.list_(pa.int64()))]) for v in spans),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "anchor", "context", "doc", "place", "span_doc", "span_start", "span_end"])

    def settle(table: pa.Table) -> pa.Table:
        """Later occurrences of a context become spans; first ones of anchors with several contexts are to be compared."""
        flat = {c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in table.column_names[1:]}
        anchor, context, doc, place = flat["anchor"].view(np.uint64), flat["context"].view(np.uint64), flat["doc"], flat["place"].astype(np.int64)
        order, later = _first_of_equal(anchor, context, doc, place)
        group, start, end = _merged(np.r_[flat["span_start"], np.maximum(place[order][later] - reach, 0)], np.r_[flat["span_end"], place[order][later] + length], np.r_[flat["span_doc"], doc[order][later]])
        keep = order[~later]
        a = anchor[keep]
        cut = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        many = keep[np.repeat(np.diff(np.r_[cut, len(a)]) > 1, np.diff(np.r_[cut, len(a)]))] if len(a) else keep
        nulls = pa.nulls(len(group), pa.int64())
        return pa.table({"id": np.r_[group, doc[many]], "start": np.r_[start, place[many]], "end": np.r_[end, place[many] + length], "anchor": pa.concat_arrays([nulls, pa.array(anchor[many].view(np.int64))])})

    lists = "part long, anchor array<long>, context array<long>, doc array<long>, place array<int>, span_doc array<long>, span_start array<long>, span_end array<long>"
    settled = stored(docs.mapInArrow(select, lists).groupBy("part").applyInArrow(settle, "id long, start long, end long, anchor long"), "spans")

    def extract(batches):
        """(part, anchor, id, anchor's place, context's place, context bytes) of the places that are to be compared."""
        for b in batches:
            out = {"part": [], "anchor": [], "id": [], "place": [], "from": [], "bytes": []}
            for doc, text, wanted in zip(b.column("id").to_pylist(), b.column("text"), b.column("wanted")):
                data = text.as_py().encode()
                for anchor, place in zip(wanted.values.field("anchor").to_pylist(), wanted.values.field("start").to_pylist()):
                    lo = max(0, place - reach)
                    out["part"].append(anchor % parts)
                    out["anchor"].append(anchor)
                    out["id"].append(doc)
                    out["place"].append(place)
                    out["from"].append(lo)
                    out["bytes"].append(data[lo : place + length])
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in (("part", pa.int64()), ("anchor", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("from", pa.int64()), ("bytes", pa.binary()))], list(out))

    def compare(table: pa.Table) -> pa.Table:
        ids, start, place = (table.column(c).to_numpy() for c in ("id", "from", "place"))
        texts = table.column("bytes").combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        anchor_at = offsets[:-1] + place - start
        #: ids become ranks so that the order of texts and the place in them fit in a long
        earlier = (np.unique(ids, return_inverse=True)[1].astype(np.int64) << 40) + start
        found = []
        for rows, first, last, key in families(data, offsets[:-1], offsets[1:], anchor_at, table.column("anchor").to_numpy().view(np.uint64), length, reach, CHUNK_CONTEXTS):
            lo, hi = np.maximum(offsets[rows], anchor_at[rows] + first), np.minimum(offsets[rows + 1], anchor_at[rows] + last + length)
            shift = lo - offsets[rows]
            if first == last:
                # one window a context, of equal bytes where the keys are equal
                order, later = _first_of_equal(key, key, earlier[rows] + shift, np.zeros(len(rows), np.int64))
                again = order[later]
                begin = (start[rows] + shift)[again]
                found.append(_merged(begin, begin + length, ids[rows][again]))
                continue
            cut = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
            i = 0
            while i < len(cut) - 1:
                j = max(i + 1, int(np.searchsorted(cut, cut[i] + CHUNK_CONTEXTS, "right")) - 1)
                here = slice(cut[i], cut[j])
                i = j
                size = hi[here] - lo[here]
                bounds = np.r_[0, np.cumsum(size)]
                part = data[np.repeat(lo[here] - bounds[:-1], size) + np.arange(bounds[-1])]
                origin = start[rows[here]] + shift[here]
                text, at = repeated_starts(part, bounds, earlier[rows[here]] + shift[here], length)
                found.append(_merged(origin[text] + at, origin[text] + at + length, ids[rows[here]][text]))
        group, begin, end = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"id": group.astype(np.int64), "start": begin.astype(np.int64), "end": end.astype(np.int64)})

    wanted = settled.where("anchor IS NOT NULL").groupBy("id").agg(F.collect_list(F.struct("anchor", "start")).alias("wanted"))
    contexts = docs.join(wanted.withColumnRenamed("id", "wanted_id"), F.col("id") == F.col("wanted_id")).select("id", "text", "wanted").mapInArrow(extract, "part long, anchor long, id long, place long, `from` long, bytes binary")
    compared = contexts.groupBy("part").applyInArrow(compare, "id long, start long, end long")
    return settled.where("anchor IS NULL").select("id", "start", "end").unionByName(compared)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) of every text.

    Texts are UTF-8 bytes; null is empty.  A byte is removed if it lies in a string of ``length`` bytes that also starts
    earlier: in a text of smaller id, or earlier in the same one.  Strings are those of the input.  spans: the maximal
    removed runs (start, end); kept: the remaining bytes.  Texts shorter than ``length`` stay whole.  Ids are longs; a
    null id is smaller than all others.  Rows that share an id count as one place: their strings are not earlier than
    each other's, and the spans of one apply to all, cut to each text's length.  Other columns are ignored; an empty
    table gives no rows.
    """
    lowest = -(1 << 62)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = find_spans(rows, length, gram).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches):
        for b in batches:
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "kept": []}
            for text, spans_ in zip(b.column("text"), b.column("spans")):
                data = text.as_py().encode()
                n, runs = len(data), []
                if spans_.is_valid:
                    start, end = (np.asarray(spans_.values.field(c)) for c in ("start", "end"))
                    _, start, end = _merged(start, np.minimum(end, n), np.zeros(len(start), np.int64))
                    runs = [(s, e) for s, e in zip(start.tolist(), end.tolist()) if e > s]
                kept, at = [], 0
                for s, e in runs:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(kept))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["spans"].append([{"start": s, "end": e} for s, e in runs])
                    out["kept"].append(kept)
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.binary()}
            names = [c for c in out if with_text or c not in ("spans", "kept")]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(out[c], types[c]) for c in names)], ["id", *names])

    joined = rows.join(spans.withColumnRenamed("id", "span_id"), F.col("id") == F.col("span_id"), "left").select("id", "text", "spans")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start:long,end:long>>, kept binary" * with_text
    return joined.mapInArrow(cut, schema).withColumn("id", F.when(F.col("id") != lowest, F.col("id")))
