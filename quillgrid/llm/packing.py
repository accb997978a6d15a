"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.util import bound_batches, pieces_of

CAPACITY = 2048
#: Pieces in a packing group, on average; the number of groups grows with the input.
GROUP_PIECES = 4096
#: The pattern by which a ``ByteLevel`` pre-tokenizer with ``use_regex`` parts text (fixed value; files do not repeat it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 1
#: A run of white space of this length goes to the library: the other's pattern engine overflows its stack on half a million.
LONG_BLANK = 100_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def tokenizer(path: str):
    """text -> ids, equal to ``tokenizers`` on the file at ``path`` with add_special_tokens=False.

    Vocabulary, merge ranks and special tokens come from the file.  Where it is a plain byte-level BPE, ordinary texts are
    merged by tiktoken, which is five times as fast here; texts that hold a special token's string or a very long run of
    white space, and all texts where the file is anything else, go to the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    model, before = parts["model"], parts.get("pre_tokenizer") or {}
    special = {t["content"] for t in parts.get("added_tokens", [])}
    plain = model["type"] == "BPE" and not parts.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    blank = re.compile(r"\s{%d}" % LONG_BLANK)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or len(text) >= LONG_BLANK and blank.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class TournamentTree:
    """Largest free room of any bin under each node; finds the first bin with room in O(log n)."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.most = [0] * (2 * self.size)
        self.most[self.size : self.size + n] = [capacity] * n
        for i in range(self.size - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def take(self, need: int) -> tuple[int, int]:
        """The first bin with ``need`` free, and its room before it is taken."""
        most, i = self.most, 1
        while i < self.size:
            i *= 2
            if most[i] < need:
                i += 1
        room = most[i]
        most[i] = room - need
        bin_ = i - self.size
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order.tolist():
        bins[k], room = tree.take(int(lengths[k]))
        offsets[k] = capacity - room
    return bins, offsets


def tokenize_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every text's ids and an end id, cut every ``capacity`` ids.

    A null or empty text has the end id only; a text of any length is read whole, and one of any shape is cut alike;
    repeated rows have their pieces each; a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def pieces(batches):
        encode = tokenizer(path)
        for b in pieces_of(batches):
            out = {"doc_id": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": [], "ids": []}
            doc_ids = b.column("id").to_pylist()
            for doc_id, text in zip(doc_ids, b.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(piece))
                    out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                    out["doc_tokens"].append(len(ids))
                    if with_ids:
                        out["ids"].append(piece.astype("<i4"))
            arrays = {k: pa.array(v, b.column("id").type if k == "doc_id" else pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in out.items() if with_ids or k != "ids"}
            yield pa.RecordBatch.from_pydict(arrays)

    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def assign(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """``pieces`` with sequence_id and offset.  Give it no large columns: what it is given is shuffled once.

    Pieces are dealt to ceil(rows / group_pieces) groups by a hash of what they hold, and each group is packed on its
    own by first-fit decreasing; ``group << 32 | bin`` is the sequence id.  Groups are random, so each is a fair draw of
    lengths and none grows with the input; identical rows are told apart by their place in the partition, so that a
    hot repeated row does not meet in one group.  Nulls are hashed like values; pieces of equal length keep the order of
    their columns; an empty table gives no rows.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    names = pieces.columns
    salt = F.monotonically_increasing_id()
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), salt, *[F.col(c) for c in names]), F.lit(groups)).cast("long"))

    order = [f.name for f in pieces.schema if f.dataType.typeName() != "array"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        out = pdf[names].copy()
        out["sequence_id"] = (pdf["__group"].to_numpy(np.int64) << 32) | bins
        out["offset"] = offsets
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("__group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Real sequences: (sequence_id, ids, pieces) with ids of length at most ``capacity``.

    ``pieces`` lists (offset, doc_id, start, length).  Every id of every text lies in exactly one sequence.  Null and
    empty texts are one end id; very long texts fill sequences of their own but for the rest; repeated rows are packed
    each; other columns are ignored; an empty table gives no rows.
    """
    packed = assign(tokenize_pieces(docs, path, id_col, text_col, capacity), capacity)
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"], p["doc_id"], p["start"], p["length"])).alias("pieces"))
