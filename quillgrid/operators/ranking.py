"""Ranks and running figures: windows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillgrid.functions.core import aggregated, alias, function, num, trunc
from quillgrid.functions.core import ranged as ranged_numbers
from quillgrid.operators.arrays import before_ranges, ranged


def _w(by: tuple[str, ...]) -> WindowSpec:
    """Without a key a window would sort all rows in one task: :func:`rank_over_all` does not."""
    if not by:
        raise ValueError("#VALUE!: ranks beside rows take a key; use rank_over_all without one, or rank_of for one number")
    return Window.partitionBy(*by)


def rank_of(number, values: Column, ascending: bool = False) -> Column:
    """RANK of a given number in a range, as an aggregate; #N/A if it is not there."""
    x, v = num(number), ranged_numbers(values)
    before = F.count_if(v < x) if ascending else F.count_if(v > x)
    return aggregated((before + 1).cast("double"), values, fails=((F.count_if(v == x) == 0, "#N/A"),))


def percentrank_of(number, values: Column, digits: int = 3, exclusive: bool = False) -> Column:
    """PERCENTRANK of a given number as an aggregate, interpolated between its neighbours; #N/A outside the range."""
    x, v = num(number), ranged_numbers(values)
    n, below, at = F.count(v), F.count_if(v < x), F.count_if(v == x)
    low, high = F.max(F.when(v < x, v)), F.min(F.when(v > x, v))
    rank = F.when(at > 0, below).otherwise(below - 1 + F.try_divide(x - low, high - low))
    share = F.try_divide(rank + 1, n + 1) if exclusive else F.when(n == 1, F.lit(1.0)).otherwise(F.try_divide(rank, n - 1))
    outside = ~F.coalesce((F.min(v) <= x) & (F.max(v) >= x), F.lit(False))
    return aggregated(_truncated(share, digits), values, fails=((outside, "#N/A"),))


@function("RANK", 1, 3)
def RANK(x: Column, by: tuple[str, ...] = (), ascending: bool = False) -> Column:
    """Best rank of ties, largest first unless ``ascending``; blanks have none."""
    order = num(x).asc_nulls_last() if ascending else num(x).desc_nulls_last()
    return F.when(x.isNotNull(), F.rank().over(_w(by).orderBy(order)).cast("double"))


alias("RANK.EQ", "RANK")


@function("RANK.AVG", 1, 3)
def RANK_AVG(x: Column, by: tuple[str, ...] = (), ascending: bool = False) -> Column:
    order = num(x).asc_nulls_last() if ascending else num(x).desc_nulls_last()
    w = _w(by).orderBy(order)
    #: ties are the rows of one range frame
    return F.when(x.isNotNull(), F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2)


def _truncated(p: Column, digits: int) -> Column:
    scale = float(10**digits)
    return trunc(p * scale + 1e-9) / scale


@function("PERCENTRANK", 1, 3)
def PERCENTRANK(x: Column, by: tuple[str, ...] = (), digits: int = 3) -> Column:
    """Of members: smaller ones over n - 1, cut to ``digits``."""
    below = F.rank().over(_w(by).orderBy(num(x).asc_nulls_last())) - 1
    n = F.count(x).over(_w(by))
    return F.when(x.isNotNull(), F.when(n == 1, F.lit(1.0)).otherwise(_truncated(F.try_divide(below, n - 1), digits)))


alias("PERCENTRANK.INC", "PERCENTRANK")


@function("PERCENTRANK.EXC", 1, 3)
def PERCENTRANK_EXC(x: Column, by: tuple[str, ...] = (), digits: int = 3) -> Column:
    rank = F.rank().over(_w(by).orderBy(num(x).asc_nulls_last()))
    return F.when(x.isNotNull(), _truncated(rank / (F.count(x).over(_w(by)) + 1), digits))


# --- filled-down anchored ranges -------------------------------------------------------------------------------------
def running_sum(x: Column, by: tuple[str, ...], order: list[Column]) -> Column:
    """SUM($B$2:B2) filled down."""
    return F.sum(x).over(_w(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def running_count(by: tuple[str, ...], order: list[Column]) -> Column:
    """COUNTIF($E$2:E2, E2) filled down: occurrences so far of the row's key."""
    return F.count(F.lit(1)).over(_w(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def sliding(aggregate: Column, by: tuple[str, ...], order: list[Column], before: int, after: int) -> Column:
    """AVERAGE(B2:B4), AVERAGE(B3:B5), ... filled down."""
    return aggregate.over(_w(by).orderBy(*order).rowsBetween(-before, after))


def previous(x: Column, by: tuple[str, ...], order: list[Column], rows: int = 1) -> Column:
    """A reference to the row above."""
    return F.lag(x, rows).over(_w(by).orderBy(*order))


def running_total_over_all(df: DataFrame, value: str, order: list[str], out: str = "running") -> DataFrame:
    """A running sum without a key at any size: ranges are summed on their own and offset by those before."""
    rows = ranged(df, [F.col(c) for c in order])
    own = F.sum(value).over(Window.partitionBy("__r").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__own", own).join(F.broadcast(before_ranges(rows, F.sum(value))), "__r")
    return joined.select(*df.columns, (F.col("__own") + F.col("__before")).alias(out))


def rank_over_all(df: DataFrame, value: str, ascending: bool = False, out: str = "rank") -> DataFrame:
    """RANK without a key at any size: distinct values are counted and their counts summed range by range, then joined
    back; a hot value is one counted row until the join, whose skew Spark splits."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    ordered = counts.withColumn("__o", F.col("__v") if ascending else -F.col("__v"))
    ranks = running_total_over_all(ordered, "__n", ["__o"], "__through").select("__v", (F.col("__through") - F.col("__n") + 1).cast("double").alias(out))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")
