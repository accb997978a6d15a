"""Dynamic-array operators on DataFrames with an explicit row position, since DataFrames have no order of their own."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.core import fold, function

MOST_CELLS = 1_000_000


def _relation(name: str, least: int, most: int | None = -1):
    return function(name, least, most, kind="relation")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, so that all plans on it see the same partitions.

    It is a checkpoint where ``spark.checkpoint.dir`` is set; elsewhere it is kept on the executors' disks, and partitions
    that are lost are computed again by the same partitioner.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ranges of a total order: __r numbers the ranges, __k the rows of each from 1.

    Ties are told apart by a row number, so a hot value is cut into ranges like any other.  Ranges are settled: planned
    twice they would be cut at other samples, and rows would be lost where the two meet.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [*order, F.col("__tie")]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__i", F.monotonically_increasing_id())
    rows = dealt.withColumns({"__r": F.shiftright("__i", 33), "__k": F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    return settled(rows.drop("__tie", "__i"))


def before_ranges(rows: DataFrame, amount: Column) -> DataFrame:
    """(__r, __before): the sum of ``amount``, an aggregate, over the ranges before each; one row a range."""
    sums = rows.groupBy("__r").agg(amount.alias("__s"))
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("__r", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: list[Column], position: str = "pos") -> DataFrame:
    """Add positions from 1 in a total order without gathering all rows in one task: each range is numbered on its own and
    offset by the counts of those before."""
    rows = ranged(df, order)
    offsets = before_ranges(rows, F.count(F.lit(1)))
    return rows.join(F.broadcast(offsets), "__r").select(*df.columns, (F.col("__before") + F.col("__k")).alias(position))


@_relation("FILTER", 2, 3)
def FILTER(df: DataFrame, include: Column | list[bool], if_empty: DataFrame | None = None) -> DataFrame:
    """Rows where ``include`` holds (a list: columns where it is true); if none does and a fallback is given, that."""
    if isinstance(include, list):
        names = [c for c, keep in zip(df.columns, include, strict=True) if keep]
        if not names and if_empty is None:
            raise ValueError("#CALC!")
        return df.select(*names) if names else if_empty
    kept = df.where(include)
    if if_empty is None:
        return kept
    none = kept.limit(1).agg(F.count("*").alias("__n"))
    return kept.unionByName(if_empty.crossJoin(F.broadcast(none)).where("__n = 0").drop("__n"))


def sort_keys(df: DataFrame, keys: list[tuple[str, int]], position: str | None) -> list[Column]:
    """Blanks are last in both directions; text without regard to ASCII case; then the position."""
    types = dict(df.dtypes)
    out = []
    for name, direction in keys:
        c = fold(F.col(name)) if types[name] == "string" else F.col(name)
        out.append(c.asc_nulls_last() if direction >= 0 else c.desc_nulls_last())
    return out + ([F.col(position)] if position else [])


@_relation("SORT", 2, 4)
def SORT(df: DataFrame, key: str, direction: int = 1, position: str | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(df, [(key, direction)], position))


@_relation("SORTBY", 2, 3)
def SORTBY(df: DataFrame, keys: list[tuple[str, int]], position: str | None = None) -> DataFrame:
    return df.orderBy(*sort_keys(df, keys, position))


@_relation("UNIQUE", 2, 3)
def UNIQUE(df: DataFrame, position: str, exactly_once: bool = False) -> DataFrame:
    """Distinct rows with their first position; text compares without regard to ASCII case."""
    types, names = dict(df.dtypes), [c for c in df.columns if c != position]
    keys = [(fold(F.col(c)) if types[c] == "string" else F.col(c)).alias(f"__{c}") for c in names]
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(position).alias(position), F.min_by(F.struct(*names), F.col(position)).alias("__row"))
    if exactly_once:
        groups = groups.where("__n = 1")
    return groups.select(*[F.col("__row")[c].alias(c) for c in names], position)


def _columns(df: DataFrame, position: str) -> list[str]:
    return [c for c in df.columns if c != position]


@_relation("TAKE", 3, 4)
def TAKE(df: DataFrame, n: int | None, position: str, columns: int | None = None) -> DataFrame:
    """First n rows by position, or the last for a negative n (None: all); so for columns, beside the position."""
    if n == 0 or columns == 0:
        raise ValueError("#CALC!")
    if columns is not None:
        names = _columns(df, position)
        df = df.select(position, *(names[:columns] if columns > 0 else names[columns:]))
    if n is None:
        return df
    return df.orderBy(F.col(position) if n > 0 else F.col(position).desc()).limit(abs(n))


@_relation("DROP", 3, 4)
def DROP(df: DataFrame, n: int | None, position: str, columns: int | None = None) -> DataFrame:
    """All but the first n rows by position, or the last: those are found first, the others pass a filter; so for columns."""
    if columns:
        names = _columns(df, position)
        left = names[columns:] if columns > 0 else names[:columns]
        if not left:
            raise ValueError("#CALC!")
        df = df.select(position, *left)
    if not n:
        return df
    edge = TAKE(df.select(position), n, position).agg((F.max if n > 0 else F.min)(position).alias("__edge"))
    beyond = F.col(position) > F.col("__edge") if n > 0 else F.col(position) < F.col("__edge")
    return df.crossJoin(F.broadcast(edge)).where(beyond).drop("__edge")


@_relation("CHOOSECOLS", 2, None)
def CHOOSECOLS(df: DataFrame, *numbers: int) -> DataFrame:
    picked = [df.columns[k - 1 if k > 0 else k] for k in numbers]
    seen: dict[str, int] = {}
    out = []
    for c in picked:
        seen[c] = seen.get(c, 0) + 1
        out.append(F.col(c).alias(c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return df.select(*out)


@_relation("CHOOSEROWS", 3, None)
def CHOOSEROWS(df: DataFrame, position: str, *numbers: int) -> DataFrame:
    """Rows by position in the order of ``numbers`` (column pick); negatives count from the end."""
    spark = df.sparkSession
    total = df.agg(F.max(position)).first()[0] or 0
    wanted = spark.createDataFrame([(i, k if k > 0 else total + 1 + k) for i, k in enumerate(numbers, 1)], "pick int, __at long")
    return df.join(F.broadcast(wanted), F.col(position) == F.col("__at")).drop("__at")


@_relation("VSTACK", 1, None)
def VSTACK(*tables: DataFrame, position: str = "pos") -> DataFrame:
    """Rows of all tables by column name, missing ones null (#N/A); ``part`` and the table's own position give the order."""
    parts = [t.withColumn("part", F.lit(i)) for i, t in enumerate(tables, 1)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@_relation("HSTACK", 1, None)
def HSTACK(*tables: DataFrame, position: str = "pos") -> DataFrame:
    """Columns side by side, joined on position; shorter tables are padded with nulls."""
    return reduce(lambda a, b: a.join(b, position, "full"), tables)


@_relation("SEQUENCE", 2, 5)
def SEQUENCE(spark: SparkSession, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """(pos, c1, c2, ...): an arithmetic ramp by rows."""
    if rows * columns > MOST_CELLS:
        raise ValueError("#NUM!")
    base = spark.range(1, rows + 1).withColumnRenamed("id", "pos")
    return base.select("pos", *[(F.lit(float(start)) + F.lit(float(step)) * ((F.col("pos") - 1) * columns + (j - 1))).alias(f"c{j}") for j in range(1, columns + 1)])


@_relation("TRANSPOSE", 2)
def TRANSPOSE(df: DataFrame, position: str) -> DataFrame:
    """(row, col, value) with axes swapped: the long form scales, a wide one needs a column a row."""
    names = [c for c in df.columns if c != position]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.col(c).cast("string").alias("value")) for i, c in enumerate(names, 1)])).alias("cell")
    return df.select(F.col(position).cast("long").alias("col"), cells).select("cell.row", "col", "cell.value")


@_relation("TEXTSPLIT", 3, 6)
def TEXTSPLIT(df: DataFrame, text: str, delimiter: str, row_delimiter: str | None = None, ignore_empty: bool = False, ignore_case: bool = False) -> DataFrame:
    """The input's columns with (r, c, piece), a row for each piece; pieces are not padded, a missing one is absent."""
    flag = "(?i)" if ignore_case else ""
    quote = lambda d: flag + "\\Q" + d + "\\E"
    lines = F.split(F.col(text), quote(row_delimiter), -1) if row_delimiter else F.array(F.col(text))
    keep = (lambda a: F.filter(a, lambda x: x != "")) if ignore_empty else (lambda a: a)
    rows = df.select("*", F.posexplode(keep(lines)).alias("__r", "__line"))
    out = rows.select(*df.columns, (F.col("__r") + 1).alias("r"), F.posexplode(keep(F.split("__line", quote(delimiter), -1))).alias("__c", "piece"))
    return out.select(*df.columns, "r", (F.col("__c") + 1).alias("c"), "piece")


# --- set operations, composed from the above in formulas -------------------------------------------------------------
def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
