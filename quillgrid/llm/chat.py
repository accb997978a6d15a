"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Chat logs often store a conversation again after each exchange, so that shorter records are prefixes of
longer ones.  Rolling hashes of turn prefixes find them, anti-joins keep the maximal conversations, and
those are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.core import both
from quillgrid.llm.util import small_or_shuffled, stored

#: Turn numbers are cut into stretches of this length, so that a window never holds a whole hot conversation.
STRETCH = 1024


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def prefix_hashes(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, pos, h1, h2, is_last): each turn's place from 1 and the 128-bit hash of the turns up to it.

    Rows are ordered by turn, role and text; identical rows count once.  The hash of a prefix is the XOR of hashes of (place,
    role, text), hence a rolling one: equal if and only if the turns are equal (but for 2**-128).  Texts become hashes
    before anything is shuffled; only where one conversation has several texts of one turn and role do they travel, to be
    ordered.  Places and hashes run over stretches of turn numbers; the few conversations of more than one are then offset.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    #: xxhash64 skips nulls, so a null role or text is told apart by its flag.
    parts = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    stretch = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / STRETCH).cast("long")
    turns = turns.withColumns({"k1": F.xxhash64(*parts), "k2": F.xxhash64(F.lit("second"), *parts), "stretch": stretch})
    place = ["conv_id", "stretch", "turn", "role"]
    several = turns.groupBy(*place).agg((F.min("k1") != F.max("k1")).alias("several")).where("several")
    several = small_or_shuffled(several.select(*[F.col(c).alias(f"s_{c}") for c in place], "several"))
    here = both(*[F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in place])
    rows = turns.join(several, here, "left").select(*place, "k1", "k2", F.when(F.col("several"), F.col("text")).alias("tie"))
    rows = rows.repartition("conv_id", "stretch").dropDuplicates()
    inside = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "tie", "k1")
    rows = rows.withColumns({"k": F.row_number().over(inside), "n": F.count(F.lit(1)).over(Window.partitionBy("conv_id", "stretch"))})
    rows = stored(rows.select("conv_id", "stretch", "k", "n", "k1", "k2"), "turns")
    counts = rows.where("k = 1").select("conv_id", "stretch", "n")
    by_conv = Window.partitionBy("conv_id")
    earlier = by_conv.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("conv_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("conv_id").alias("c"))
    long = counts.join(small_or_shuffled(spans), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    long = long.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), (F.max("stretch").over(by_conv) != F.col("stretch")).alias("goes_on"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))
    rows = rows.join(small_or_shuffled(long), same, "left").withColumn("pos", F.col("k") + F.coalesce("before", F.lit(0)))
    is_last = (F.col("k") == F.col("n")) & ~F.coalesce("goes_on", F.lit(False))
    rows = rows.select("conv_id", "stretch", "pos", F.xxhash64("pos", "k1", "k2").alias("t1"), F.xxhash64(F.lit("second"), "pos", "k1", "k2").alias("t2"), is_last.alias("is_last"), F.col("c").isNotNull().alias("is_long"))
    upto = Window.partitionBy("conv_id", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"r1": F.bit_xor("t1").over(upto), "r2": F.bit_xor("t2").over(upto)})
    rows = stored(rows.drop("t1", "t2"), "prefixes")
    whole = rows.where("is_long").groupBy("conv_id", "stretch").agg(F.max_by(F.struct("r1", "r2"), "pos").alias("w"))
    offsets = whole.select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.bit_xor("w.r1").over(earlier).alias("b1"), F.bit_xor("w.r2").over(earlier).alias("b2"))
    rows = rows.join(small_or_shuffled(offsets), same, "left")
    h1, h2 = (F.col(f"r{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))).alias(f"h{i}") for i in (1, 2))
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), h1, h2, "is_last")


def collapse(hashes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept, keeper_id) for the rows of :func:`prefix_hashes`.

    Of equal conversations the smallest conv_id represents the others.  An anti-join with the prefixes of longer
    conversations leaves the maximal representatives; a semi-join's complement names who continues the rest.  keeper_id:
    the conversation itself if kept, the smallest conv_id of those that continue it if it is a proper prefix, else the
    representative.  All groupings are partial before they shuffle and one row a prefix afterwards, so a hot first turn
    is a single row.
    """
    key = ["pos", "h1", "h2"]
    ends = hashes.where("is_last").drop("is_last")
    equal = ends.groupBy(*key).agg(F.min("conv_id").alias("first_id"))
    longer = hashes.where("NOT is_last").groupBy(*key).agg(F.min("conv_id").alias("keeper"))
    maximal = equal.join(longer, key, "left_anti").select(*key, "first_id", F.col("first_id").alias("keeper"), F.lit(True).alias("maximal"))
    classes = maximal.unionByName(equal.join(longer, key).withColumn("maximal", F.lit(False)))
    return ends.join(classes, key).select(
        "conv_id",
        F.col("pos").alias("n_turns"),
        (F.col("maximal") & F.col("conv_id").eqNullSafe(F.col("first_id"))).alias("kept"),
        F.col("keeper").alias("keeper_id"),
    )


def render_turn(role, text, start: str = "<|im_start|>", end: str = "<|im_end|>"):
    """A turn in the template: role line, text, end mark."""
    return F.concat(F.lit(start), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(end + "\n"))


def format_chats(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row a conversation: conv_id, n_turns, kept, keeper_id, rendered (null unless kept).

    A null role is rendered as ``unknown`` and a null text as empty, but both differ from those words when
    conversations are compared.  Rows with a null conv_id are one conversation; null turns come first;
    identical rows count once; other columns are ignored; an empty table gives no rows.  A rendered
    conversation is one string, so it must fit in one (2 GB).
    """
    hashes = stored(prefix_hashes(conversations, conv_col, turn_col, role_col, text_col), "hashes")
    verdicts = stored(collapse(hashes), "verdicts")
    kept = small_or_shuffled(verdicts.where("kept").select(F.col("conv_id").alias("c")))
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col).join(kept, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    rendered = turns.groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    rendered = rendered.select("c", F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("rendered"))
    out = verdicts.join(rendered, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", "n_turns", "kept", "keeper_id", "rendered")


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t),
p AS (SELECT conv_id, pos, md5(string_agg(concat(coalesce('r' || role, 'n'), chr(1), coalesce('t' || text, 'n')), chr(2)) OVER (PARTITION BY conv_id ORDER BY pos)) AS h FROM o),
e AS (SELECT conv_id, max(pos) AS n_turns, arg_max(h, pos) AS h FROM p GROUP BY conv_id),
i AS (SELECT p.pos, p.h, min(p.conv_id) AS longer_id FROM p JOIN e ON p.conv_id = e.conv_id AND p.pos < e.n_turns GROUP BY p.pos, p.h),
c AS (SELECT n_turns, h, min(conv_id) AS first_id FROM e GROUP BY n_turns, h),
r AS (SELECT conv_id, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered FROM o GROUP BY conv_id),
v AS (SELECT e.conv_id, CAST(e.n_turns AS BIGINT) AS n_turns, i.h IS NULL AND e.conv_id = c.first_id AS kept,
      CASE WHEN i.h IS NULL THEN c.first_id ELSE i.longer_id END AS keeper_id
      FROM e JOIN c ON e.n_turns = c.n_turns AND e.h = c.h LEFT JOIN i ON e.n_turns = i.pos AND e.h = i.h)
SELECT v.*, CASE WHEN kept THEN rendered END AS rendered FROM v JOIN r ON v.conv_id = r.conv_id
"""
