"""The lookup family as joins: exact matches on deduplicated keys, approximate ones as as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.core import fold, function, num
from quillgrid.functions.criteria import criterion

#: Tables of at most this many rows are bands that each fact is held against; larger ones are merged.
SMALL_BANDS = 256
#: A lookup table is broadcast only if it was counted to have at most this many rows.
BROADCAST_ROWS = 200_000


def _sized(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _key(df: DataFrame, name: str) -> Column:
    """Text keys compare without regard to ASCII case."""
    return fold(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def exact_join(facts: DataFrame, key: str, table: DataFrame, table_key: str, values: list[str], position: str | None = None, last: bool = False, check_size: bool = True, matched: str | None = None) -> DataFrame:
    """``facts`` with the ``values`` of the first (or last) matching row of ``table``; a miss gives nulls, and false in the
    column ``matched`` if that is named.  Without a position the first is the row with the smallest values.

    The table is deduplicated by a partial aggregate, so a hot key in it costs one row a task; a table too large to
    broadcast is a shuffle join, whose skew Spark splits.
    """
    order = F.col(position) if position else F.struct(*values)
    pick = F.max_by if last else F.min_by
    right = table.where(F.col(table_key).isNotNull()).groupBy(_key(table, table_key).alias("__k")).agg(pick(F.struct(*values), order).alias("__v"))
    right = _sized(right) if check_size else right
    return _looked_up(facts.join(right, _key(facts, key) == F.col("__k"), "left"), facts, values, matched)


def _looked_up(joined: DataFrame, facts: DataFrame, values: list[str], matched: str | None) -> DataFrame:
    """The columns of ``facts``, the fields of __v and, if it is named, whether there was a match."""
    flag = [F.col("__v").isNotNull().alias(matched)] if matched else []
    return joined.select(*[F.col(c) for c in facts.columns], *[F.col("__v")[v].alias(v) for v in values], *flag)


def as_of_join(facts: DataFrame, key: str, table: DataFrame, table_key: str, values: list[str], forward: bool = False, matched: str | None = None) -> DataFrame:
    """``facts`` with the ``values`` of the nearest table row at or below (``forward``: at or above) the key.

    A table counted to be small becomes bands that are broadcast; others are merged with the facts by key range, each
    range carrying in the last table row before it, so no task orders all facts.  Of rows with the same key the one with
    the largest values counts, whatever the table's size.
    """
    usable = table.where(F.col(table_key).isNotNull()).groupBy(table_key).agg(F.max(F.struct(*values)).alias("__v")).select(F.col(table_key), *[F.col("__v")[v].alias(v) for v in values if v != table_key])
    if usable.limit(SMALL_BANDS + 1).count() <= SMALL_BANDS:
        return _as_of_small(facts, key, usable, table_key, values, forward, matched)
    return _as_of_merge(facts, key, usable, table_key, values, forward, matched=matched)


def _as_of_small(facts, key, table, table_key, values, forward, matched=None) -> DataFrame:
    """Bands: each table row with the next row's key, joined by range to the facts."""
    deduped = table.groupBy(F.col(table_key).alias("__lo")).agg(F.max(F.struct(*values)).alias("__v"))
    w = Window.orderBy("__lo")
    if forward:
        bands = deduped.withColumn("__from", F.lag("__lo").over(w))
        inside = ((F.col("__from").isNull()) | (F.col(key) > F.col("__from"))) & (F.col(key) <= F.col("__lo"))
    else:
        bands = deduped.withColumn("__to", F.lead("__lo").over(w))
        inside = (F.col(key) >= F.col("__lo")) & (F.col("__to").isNull() | (F.col(key) < F.col("__to")))
    return _looked_up(facts.join(F.broadcast(bands), inside, "left"), facts, values, matched)


def _as_of_merge(facts, key, table, table_key, values, forward, ranges: int = 200, matched: str | None = None) -> DataFrame:
    """Both sides are cut at quantiles of the table's keys; a range starts with the last table row before it."""
    cuts = table.select(F.percentile_approx(F.col(table_key), [i / ranges for i in range(1, ranges)], 1000).alias("__q"))
    lower = lambda k: F.size(F.filter(F.col("__q"), lambda x: x <= k))
    right = table.crossJoin(F.broadcast(cuts)).select(F.col(table_key).alias("__k"), F.struct(*values).alias("__v"), lower(F.col(table_key)).alias("__r"))
    ends = right.groupBy("__r").agg((F.min_by if forward else F.max_by)("__v", "__k").alias("__e"), (F.min if forward else F.max)("__k").alias("__ek"))
    w = Window.orderBy("__r")
    carry = ends.select("__r", *[f(c, ignorenulls=True).over(w.rowsBetween(*((1, Window.unboundedFollowing) if forward else (Window.unboundedPreceding, -1)))).alias(n) for f, c, n in ((F.first if forward else F.last, "__e", "__c"),)])
    left = facts.crossJoin(F.broadcast(cuts)).withColumn("__r", F.coalesce(lower(F.col(key)), F.lit(-1))).drop("__q")
    rows = left.select(F.col(key).alias("__k"), "__r", F.lit(None).cast(right.schema["__v"].dataType).alias("__v"), F.lit(0 if forward else 1).alias("__side"), F.struct(*facts.columns).alias("__f"))
    marks = right.select("__k", "__r", "__v", F.lit(1 if forward else 0).alias("__side"), F.lit(None).cast(rows.schema["__f"].dataType).alias("__f"))
    order = Window.partitionBy("__r").orderBy("__k", "__side")
    frame = order.rowsBetween(0, Window.unboundedFollowing) if forward else order.rowsBetween(Window.unboundedPreceding, 0)
    near = (F.first if forward else F.last)("__v", ignorenulls=True).over(frame)
    merged = rows.unionByName(marks).withColumn("__n", near).where(F.col("__f").isNotNull())
    carried = merged.join(F.broadcast(carry), "__r", "left")
    value = F.when(F.col("__k").isNotNull(), F.coalesce("__n", "__c"))
    found = carried.select("__f", value.alias("__v")).select(*[F.col("__f")[c].alias(c) for c in facts.columns], "__v")
    return _looked_up(found, facts, values, matched)


def wildcard_join(facts: DataFrame, table: DataFrame, table_text: str, pattern: str, values: list[str], position: str) -> DataFrame:
    """First row of ``table`` that matches a wildcard pattern known when the plan is made: a filter, then one row."""
    hit = table.where(criterion(F.col(table_text), pattern, numeric=False)).agg(F.min_by(F.struct(*values), F.col(position)).alias("__v"))
    return facts.crossJoin(F.broadcast(hit)).select(*facts.columns, *[F.col("__v")[v].alias(v) for v in values])


def _pattern(text: Column) -> Column:
    """The regular expression of a wildcard text in a column: ``*``, ``?``, and ``~`` before one that is meant literally."""
    out = fold(text)
    for mark, code in (("~*", "\x01"), ("~?", "\x02"), ("~~", "\x03")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    out = F.regexp_replace(out, r"([\\.\[\]{}()+^$|])", r"\\$1")
    for mark, code in (("*", ".*"), ("?", "."), ("\x01", "\\*"), ("\x02", "\\?"), ("\x03", "~")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return F.concat(F.lit("(?s)^"), out, F.lit("$"))


def pattern_join(facts: DataFrame, key: str, table: DataFrame, table_key: str, values: list[str], position: str | None = None, last: bool = False, matched: str | None = None) -> DataFrame:
    """As :func:`exact_join`, but a fact's text may hold wildcards.

    Texts without any go by the exact join.  Each distinct pattern is held against the distinct keys of the table once, its
    row is found by a partial aggregate, and the facts are joined to it by their text.
    """
    wild = F.col(key).cast("string").rlike(r"[*?~]")
    plain = exact_join(facts.where(~F.coalesce(wild, F.lit(False))), key, table, table_key, values, position, last, matched=matched)
    hard = facts.where(wild)
    order = F.col(position) if position else F.struct(*values)
    pick = F.max_by if last else F.min_by
    rows = table.where(F.col(table_key).isNotNull()).groupBy(fold(F.col(table_key)).alias("__t")).agg(pick(F.struct(F.struct(*values).alias("v"), order.alias("o")), order).alias("__b"))
    patterns = hard.select(fold(F.col(key)).alias("__w")).distinct().withColumn("__p", _pattern(F.col("__w")))
    best = rows.join(_sized(patterns), F.rlike("__t", F.col("__p"))).groupBy("__w").agg(pick("__b.v", "__b.o").alias("__v"))
    found = _looked_up(hard.join(_sized(best), fold(F.col(key)) == F.col("__w"), "left"), facts, values, matched)
    return plain.unionByName(found)


@function("XLOOKUP", 5, 10, kind="relation")
def XLOOKUP(facts, key, table, table_key, values, match_mode: int = 0, search_mode: int = 1, position: str | None = None, if_not_found=None, error: str | None = None):
    """match_mode 0 exact, -1 next smaller, 1 next larger, 2 wildcards; search_mode below 0 takes the last exact match.

    The binary search modes (2, -2) ask for a sorted table, on which they find what the linear ones do.  ``if_not_found`` stands
    for misses only, not for blanks that were found; ``error`` names a column that holds #N/A where nothing was.
    """
    flag = "__matched"
    if match_mode == 2:
        out = pattern_join(facts, key, table, table_key, values, position, search_mode < 0, flag)
    elif match_mode == 0:
        out = exact_join(facts, key, table, table_key, values, position, search_mode < 0, matched=flag)
    else:
        out = as_of_join(facts, key, table, table_key, values, match_mode > 0, flag)
    return _missed(out, facts, values, flag, if_not_found, error)


def _missed(out: DataFrame, facts: DataFrame, values: list[str], flag: str, if_not_found=None, error: str | None = None) -> DataFrame:
    """A miss gives ``if_not_found``, or #N/A in the ``error`` column."""
    hit = F.col(flag)
    filled = [F.col(v) if if_not_found is None else F.when(hit, F.col(v)).otherwise(F.lit(if_not_found)).alias(v) for v in values]
    code = [F.when(~hit, "#N/A").alias(error)] if error and if_not_found is None else [F.lit(None).cast("string").alias(error)] if error else []
    return out.select(*facts.columns, *filled, *code)


@function("VLOOKUP", 5, 8, kind="relation")
def VLOOKUP(facts, key, table, table_key, values, approximate: bool = True, position: str | None = None, error: str | None = None):
    """Exact matches take wildcards in the facts' texts."""
    return XLOOKUP(facts, key, table, table_key, values, -1 if approximate else _exact_mode(facts, key), 1, position, None, error)


def _exact_mode(facts: DataFrame, key: str) -> int:
    return 2 if dict(facts.dtypes)[key] == "string" else 0


@function("LOOKUP", 5, 6, kind="relation")
def LOOKUP(facts, key, table, table_key, values, error: str | None = None):
    return XLOOKUP(facts, key, table, table_key, values, -1, error=error)


@function("HLOOKUP", 5, 6, kind="relation")
def HLOOKUP(facts, key, table: DataFrame, headers: list[str], row: str, approximate: bool = False):
    """``table`` is wide: a header is matched and its cells in the rows come back as (row, value).

    ``approximate``: the last header in order that is not beyond the key, as text without regard to case.
    """
    if approximate:
        known = sorted({h.lower(): h for h in headers}.values(), key=str.lower)
        spots = facts.sparkSession.createDataFrame([(h.lower(), h) for h in known], "__low string, __want string")
        folded = facts.withColumn("__fold", fold(F.col(key)))
        near = as_of_join(folded, "__fold", spots, "__low", ["__want"]).drop("__fold")
        long = table.unpivot([row], headers, "__header", "value")
        return near.join(_sized(long), F.col("__want") == F.col("__header"), "left").drop("__header", "__want")
    long = table.unpivot([row], headers, "__header", "value")
    return facts.join(_sized(long), fold(F.col(key)) == fold(F.col("__header")), "left").drop("__header")


@function("MATCH", 4, 8, kind="relation")
def MATCH(facts, key, table, table_key, position: str, mode: int = 0, out: str = "match", error: str | None = None):
    """Position of the match: 0 exact and first (texts may hold wildcards), 1 largest at or below, -1 smallest at or above."""
    t = table.select(F.col(table_key), F.col(position).alias("__p"))
    found = XLOOKUP(facts, key, t, table_key, ["__p"], _exact_mode(facts, key) if mode == 0 else -mode, 1, "__p", None, error)
    return found.withColumnRenamed("__p", out)


@function("XMATCH", 4, 8, kind="relation")
def XMATCH(facts, key, table, table_key, position: str, match_mode: int = 0, search_mode: int = 1, out: str = "xmatch", error: str | None = None):
    t = table.select(F.col(table_key), F.col(position).alias("__p"))
    return XLOOKUP(facts, key, t, table_key, ["__p"], match_mode, search_mode, "__p", None, error).withColumnRenamed("__p", out)


@function("INDEX", 3, 6, kind="relation")
def INDEX(facts: DataFrame, row_number: str, table: DataFrame, position: str, values: list[str] | None = None, column: int | None = None, error: str | None = None):
    """Rows of ``table`` by position: all its columns, the named ``values``, or the ``column``-th (0: all).

    Out of range gives nulls, and #REF! in the column ``error`` if that is named.  Row 0 is the whole column: each fact that
    asks for it gets all rows.
    """
    names = values or [c for c in table.columns if c != position]
    if column:
        if not 1 <= column <= len(names):
            raise ValueError("#REF!")
        names = [names[column - 1]]
    whole = F.col(row_number) == 0
    one = exact_join(facts.where(~F.coalesce(whole, F.lit(False))), row_number, table, position, names, position, matched="__matched")
    line = facts.where(whole).crossJoin(_sized(table.select(*names))).withColumn("__matched", F.lit(True))
    out = one.unionByName(line)
    code = [F.when(~F.col("__matched"), "#REF!").alias(error)] if error else []
    return out.select(*facts.columns, *names, *code)


def anti(facts: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Facts with no match: ISNA(MATCH(...)) or COUNTIF(...) = 0."""
    return facts.join(table.select(_key(table, table_key).alias("__k")).where("__k IS NOT NULL").distinct(), _key(facts, key) == F.col("__k"), "left_anti")


def semi(facts: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    return facts.join(table.select(_key(table, table_key).alias("__k")).where("__k IS NOT NULL").distinct(), _key(facts, key) == F.col("__k"), "left_semi")


# --- positions -------------------------------------------------------------------------------------------------------
@function("ROW", 1, kind="scalar")
def ROW(position):
    return num(position)


@function("COLUMN", 2, kind="plan")
def COLUMN(df: DataFrame, name: str) -> int:
    return df.columns.index(name) + 1


@function("COLUMNS", 1, kind="plan")
def COLUMNS(df: DataFrame) -> int:
    return len(df.columns)


@function("ROWS", 1, kind="relation")
def ROWS(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


@function("INDIRECT", 2, kind="plan")
def INDIRECT(tables: dict[str, DataFrame], reference: str) -> DataFrame:
    """``Tab!column`` or ``Tab`` resolved among named tables when the plan is made."""
    tab, _, column = reference.partition("!")
    if tab not in tables or column and column not in tables[tab].columns:
        raise KeyError(f"#REF! {reference}")
    return tables[tab].select(column) if column else tables[tab]


@function("OFFSET", 3, 4)
def OFFSET(column, rows: int, over):
    """A column shifted by whole rows within an ordered window: what a filled-down OFFSET reads."""
    return (F.lag(column, -rows) if rows < 0 else F.lead(column, rows)).over(over)
