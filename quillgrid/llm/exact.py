"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.util import ascii_lower, bound_batches, pieces_of, small_or_shuffled, stored

PREFIX_CHARS = 256
#: Copies from which a group is broadcast to its rows; there are at most rows / HOT such groups, and they are counted.
HOT = 256


def _full_hash(batches):
    """(id, text, survives, wanted) -> (id, survives, text_sha256); only wanted texts are read."""
    for b in pieces_of(batches):
        texts, wanted = b.column("text").to_pylist(), b.column("wanted").to_pylist()
        sha = [hashlib.sha256((t or "").encode().lower()).hexdigest() if w else None for t, w in zip(texts, wanted)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("survives"), pa.array(sha, pa.string())], ["id", "survives", "text_sha256"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """Groups of equal texts, compared after lower-casing A-Z only.

    1. Lengths are counted; a length that occurs once ends there.
    2. Rows of the other lengths are counted by (length, hash of the first ``prefix_chars`` characters).
    3. Only rows of groups that are still shared have their whole text hashed (SHA-256) and grouped by it.

    Counting is partial before each shuffle, so a hot group of copies moves one row a task; texts move
    only if the surviving keys are too many to broadcast.  ``digest_all`` hashes the other rows in the
    same scan, for callers that want the digest of every text.

    Returns a row for each input row: id, keep_id (largest id of the group), group_size, kept,
    text_sha256 (null for rows that no stage had to read, unless ``digest_all``).  A null text is an empty
    text; a null id ranks below all others, and a group with no other id has keep_id null and keeps its
    rows; repeated rows (same id, same text) share one verdict and count in group_size; an empty table
    gives no rows; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    length = F.octet_length("text").alias("length")
    lengths = stored(rows.select(length).groupBy("length").count().where("count > 1").select("length"), "lengths")
    prefix = F.xxhash64(ascii_lower(F.left("text", F.lit(prefix_chars)))).alias("prefix_hash")
    shared = rows.select(length, prefix).join(small_or_shuffled(lengths), "length", "left_semi").groupBy("length", "prefix_hash").count().where("count > 1").select("length", "prefix_hash", F.lit(True).alias("survives"))
    keyed = rows.select("id", "text", length, prefix).join(small_or_shuffled(stored(shared, "prefixes")), ["length", "prefix_hash"], "left")
    keyed = keyed.select("id", F.col("text"), F.coalesce("survives", F.lit(False)).alias("survives"))
    keyed = keyed.withColumn("wanted", F.lit(True) if digest_all else F.col("survives"))
    id_type = rows.schema["id"].dataType.simpleString()
    hashed = stored(keyed.mapInArrow(_full_hash, f"id {id_type}, survives boolean, text_sha256 string"), "digests")
    groups = hashed.where("survives").groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups.withColumnRenamed("text_sha256", "group_sha256"), "groups")
    # rows of a hot group meet its one row where they are; those of others meet in a shuffle, and rows that need no partner
    # are spread over its tasks
    hot = groups.where(F.col("group_size") > HOT).select(*[F.col(c).alias(f"hot_{c}") for c in groups.columns])
    out = hashed.join(small_or_shuffled(hot), F.col("survives") & (F.col("text_sha256") == F.col("hot_group_sha256")), "left")
    meets = F.col("survives") & F.col("hot_group_sha256").isNull()
    key = F.when(meets, F.col("text_sha256")).otherwise(F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    out = out.withColumn("key", key).join(groups.where(F.col("group_size") <= HOT), F.col("key") == F.col("group_sha256"), "left")
    out = out.select("id", "text_sha256", *[F.coalesce(f"hot_{c}", c).alias(c) for c in ("keep_id", "group_size")])
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        "id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text equals that of a row with a larger id (all columns kept).

    Repeated rows with the same id and the same text collapse to one.  Rows with a null id are compared
    like any other; a row goes by its own text, whatever other rows of its id hold.
    """
    groups = stored(exact_groups(docs, id_col, text_col), "exact-groups")
    shared = groups.where("group_size > 1")
    # only ids of shared texts need a second look, and of those each row is judged by its own text
    ids = shared.select(F.col("id").alias("__id")).distinct()
    ids = small_or_shuffled(ids)
    touched = F.col(id_col).eqNullSafe(F.col("__id"))
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    candidates = stored(docs.join(ids, touched, "left_semi").withColumn("__sha", digest), "exact-candidates")
    lost = small_or_shuffled(shared.where("NOT kept").select(F.col("id").alias("__lost"), F.col("text_sha256").alias("__lost_sha")).distinct())
    kept = candidates.join(lost, F.col(id_col).eqNullSafe(F.col("__lost")) & (F.col("__sha") == F.col("__lost_sha")), "left_anti")
    twice = shared.where("kept").groupBy("id", "text_sha256").count().where("count > 1").select(F.col("id").alias("__twice"), F.col("text_sha256").alias("__twice_sha"))
    twice = small_or_shuffled(twice)
    again = F.col(id_col).eqNullSafe(F.col("__twice")) & (F.col("__sha") == F.col("__twice_sha"))
    once = kept.join(twice, again, "left_semi").dropDuplicates([id_col, "__sha"])
    return docs.join(ids, touched, "left_anti").unionByName(kept.join(twice, again, "left_anti").unionByName(once).drop("__sha"))


ORACLE_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
