"""SimHash near-duplicates: word-shingle fingerprints, bit-sliced comparison, components over links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import jaccard
from quillgrid.llm.bitslice import BITS, bit_planes, within_radius
from quillgrid.llm.components import connected_components
from quillgrid.llm.util import bound_batches, number_of_partitions, small_or_shuffled, stored, tiles_of

#: Fingerprints of one key that a task compares at once; larger groups are cut into tiles of two chunks.
CHUNK = 8192
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit majority of XXH64 over the word shingles of the ASCII-lower-cased text; 0 without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(tokens) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for start in range(0, n, 1 << 16):
        hashes = np.array([digest(join(tokens[i : i + words]), SEED) for i in range(start, min(n, start + (1 << 16)))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long.  Null and wordless texts have fingerprint 0."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def fingerprinted(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` with each row's fingerprint as a signed long (__fp).  Null and wordless texts have fingerprint 0."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], [*b.schema.names, "__fp"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0).cast("long").alias("__fp")).schema)


def key_masks(radius: int = 2, bits: int = BITS) -> list[int]:
    """Masks of which at least one selects equal bits in any two fingerprints within ``radius``.

    Pigeonhole twice: radius + 1 blocks, one of which is equal; of the other bits radius + 1 sub-blocks, one of which is
    equal too.  For radius 2 that is 9 keys of about 36 bits.
    """
    parts, masks = radius + 1, []
    cut = [bits * i // parts for i in range(parts + 1)]
    for i in range(parts):
        block = range(cut[i], cut[i + 1])
        rest = [b for b in range(bits) if b not in block]
        for j in range(parts):
            chosen = [*block, *rest[len(rest) * j // parts : len(rest) * (j + 1) // parts]]
            masks.append(sum(1 << b for b in chosen))
    return masks


def spanning_links(values: list[int], radius: int = 2, block: int = 4096) -> list[tuple[int, int]]:
    """Links that connect what direct links within ``radius`` connect in ``values``: at most len(values) - 1."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for start in range(0, len(values), block):
        part = values[start : start + block]
        planes = bit_planes(part)
        for i in range(start, len(values)):
            # a block meets itself above the diagonal and all later fingerprints
            everyone = (1 << (min(i - start, len(part)))) - 1
            found = within_radius(planes, everyone, values[i], radius) if everyone else 0
            while found:
                low = found & -found
                a, b = root(start + low.bit_length() - 1), root(i)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                found ^= low
    return [(values[root(i)], values[i]) for i in range(len(values)) if root(i) != i]


def _links_of_runs(radius: int):
    """Rows sorted by (key, lo, hi) -> links; a run may go on in the next batch."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches):
        held_key, held = None, []
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "lo", "hi")], 1)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            ends = np.r_[starts[1:], len(fp)]
            out = []
            first = tuple(key[0])
            if held and first != held_key:
                if len(held) > 1:
                    out += spanning_links(held, radius)
                held = []
            # runs of one fingerprint have no links; only the last run of the batch may go on
            last = len(starts) - 1
            many = np.flatnonzero(ends - starts > 1).tolist()
            for r in sorted({0, last, *many}):
                values = fp[starts[r] : ends[r]].tolist()
                if r == 0:
                    values = held + values
                    held = []
                if r == last:
                    held_key, held = tuple(key[starts[r]]), values
                elif len(values) > 1:
                    out += spanning_links(values, radius)
            yield pa.RecordBatch.from_arrays([pa.array([signed(a) for a, _ in out], pa.int64()), pa.array([signed(x) for _, x in out], pa.int64())], ["a", "b"])
        if len(held) > 1:
            out = spanning_links(held, radius)
            yield pa.RecordBatch.from_arrays([pa.array([signed(a) for a, _ in out], pa.int64()), pa.array([signed(x) for _, x in out], pa.int64())], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within ``radius`` bits.

    A fingerprint goes to one group for each key mask.  Groups are compared bit-sliced and give a spanning forest of
    their links, not all pairs.  A group of more than ``chunk`` fingerprints is cut into chunks, and each pair of
    chunks is a tile of its own, so that no task holds more than two chunks of a group.
    """
    def as_long(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(as_long(m)).cast("long"))) for i, m in enumerate(key_masks(radius))])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    hot = keyed.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    keyed = keyed.join(small_or_shuffled(hot), "key", "left")
    own = F.pmod(F.xxhash64(F.lit(3), "fp"), F.col("chunks")).cast("int")
    tiled = keyed.select("fp", "key", F.explode(tiles_of(own, F.col("chunks"))).alias("t")).select("fp", "key", "t.lo", "t.hi")
    n = number_of_partitions(distinct.sparkSession)
    runs = tiled.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "fp")
    return runs.mapInArrow(_links_of_runs(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for each row; component_id is the smallest id reachable over links, its own included.

    Equal fingerprints are one node, so a hot group of copies is one row before anything is compared.  Null, empty and
    wordless texts share fingerprint 0 and link like any other; a null id never names a component unless all its ids are
    null; repeated rows get the same answer; other columns are ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, id_col, text_col, words), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-nodes")
    components = connected_components(stored(links(nodes, radius), "simhash-links"))
    joined = nodes.join(components, nodes["fp"] == components["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_fp = joined.join(least, "component").select(F.col("fp").alias("node_fp"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("node_fp"), "left").select("id", "fp", "component_id")


def hex_fingerprint(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; rows with a null id all stay.

    Texts link within ``radius`` bits, or, where ``similarity`` is given, by the exact Jaccard similarity of their shingles,
    for which the fingerprints only rule pairs out (:mod:`quillgrid.llm.jaccard`).  Each row is judged by its own text,
    whatever other rows of its id hold; repeated rows share one verdict.
    """
    if similarity is not None:
        return jaccard.near_dedup(docs, id_col, text_col, words, similarity)
    found = stored(near_duplicates(docs, id_col, text_col, words, radius), "simhash-found")
    lost = found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias("__lost"), F.col("fp").alias("__lost_fp")).distinct()
    lost = small_or_shuffled(stored(lost, "simhash-lost"))
    # only rows of these ids need their own fingerprint
    ids = small_or_shuffled(lost.select(F.col("__lost").alias("__id")).distinct())
    touched = docs.join(ids, F.col(id_col) == F.col("__id"), "left_semi")
    own = stored(fingerprinted(touched, text_col, words), "simhash-touched")
    kept = own.join(lost, (F.col(id_col) == F.col("__lost")) & (F.col("__fp") == F.col("__lost_fp")), "left_anti")
    return docs.join(ids, F.col(id_col) == F.col("__id"), "left_anti").unionByName(kept.drop("__fp"))
