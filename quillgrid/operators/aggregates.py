"""Aggregates as Columns for ``agg`` or ``over``: plain, criteria, database, statistics, regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions.core import aggregated, alias, both, error_of, function, has_error, num, ranged, with_error
from quillgrid.functions.criteria import criterion
from quillgrid.operators.arrays import numbered


def _agg(name: str, least: int = 1, most: int | None = -1):
    return function(name, least, most, kind="aggregate")


# --- plain -----------------------------------------------------------------------------------------------------------
DIV, NUM, NA = "#DIV/0!", "#NUM!", "#N/A"


def _n(x) -> Column:
    return F.count(ranged(x))


@_agg("SUM", 1, None)
def SUM(*values):
    """Of one column over rows, or of several; empty is 0."""
    out = F.coalesce(F.sum(ranged(values[0])), F.lit(0.0))
    for v in values[1:]:
        out = out + F.coalesce(F.sum(ranged(v)), F.lit(0.0))
    return aggregated(out, *values)


@_agg("AVERAGE")
def AVERAGE(x):
    return aggregated(F.avg(ranged(x)), x, fails=((_n(x) == 0, DIV),))


@_agg("COUNT")
def COUNT(x):
    """Numbers only; errors are not counted and not passed on."""
    return _n(x).cast("double")


@_agg("COUNTA")
def COUNTA(x):
    """What is not blank, errors too."""
    return F.count_if(x.isNotNull() | error_of(x).isNotNull()).cast("double") if has_error(x) else F.count(x).cast("double")


@_agg("COUNTBLANK")
def COUNTBLANK(x):
    blank = x.isNull() & error_of(x).isNull() if has_error(x) else x.isNull()
    return F.count_if(blank | (x.cast("string") == "")).cast("double")


@_agg("MIN")
def MIN(x):
    return aggregated(F.coalesce(F.min(ranged(x)), F.lit(0.0)), x)


@_agg("MAX")
def MAX(x):
    return aggregated(F.coalesce(F.max(ranged(x)), F.lit(0.0)), x)


@_agg("PRODUCT")
def PRODUCT(x):
    return aggregated(F.coalesce(F.product(ranged(x)), F.lit(0.0)), x)


@_agg("SUMSQ")
def SUMSQ(x):
    return aggregated(F.coalesce(F.sum(ranged(x) * ranged(x)), F.lit(0.0)), x)


@_agg("SUMPRODUCT", 1, None)
def SUMPRODUCT(*columns):
    """Row-aligned columns; what is no number is a factor 0."""
    out = F.coalesce(ranged(columns[0]), F.lit(0.0))
    for c in columns[1:]:
        out = out * F.coalesce(ranged(c), F.lit(0.0))
    return aggregated(F.coalesce(F.sum(out), F.lit(0.0)), *columns)


# --- criteria --------------------------------------------------------------------------------------------------------
def _pairs(pairs) -> Column:
    """AND of (column, criterion[, is numeric]) with the kind taken from a wrapped column or a Python criterion."""
    tests = []
    for c, wanted in zip(pairs[::2], pairs[1::2]):
        if isinstance(c, TextColumn):
            tests.append(criterion(c.column, wanted, numeric=False))
        else:
            tests.append(criterion(c, wanted))
    return both(*tests)


class TextColumn:
    """Marks a criteria column as text; columns are numeric otherwise."""

    def __init__(self, column: Column):
        self.column = column


def _where(f, values, pairs, empty: float | None = None) -> Column:
    """An aggregate of the numbers of matching rows: errors of other rows do not matter; without a number it is ``empty``, or #DIV/0!."""
    test = _pairs(pairs)
    values = values.column if isinstance(values, TextColumn) else values
    chosen = F.when(test, ranged(values))
    chosen = with_error(chosen, F.when(test, error_of(values)) if has_error(values) else None)
    if empty is not None:
        return aggregated(F.coalesce(f(chosen), F.lit(empty)), chosen)
    return aggregated(f(chosen), chosen, fails=((F.count(chosen) == 0, DIV),))


@_agg("SUMIF", 2, 3)
def SUMIF(c, wanted, values=None):
    v = values if values is not None else c
    return _where(F.sum, v, (c, wanted), empty=0.0)


@_agg("SUMIFS", 3, None)
def SUMIFS(values, *pairs):
    if len(pairs) % 2:
        raise ValueError("#VALUE!: criteria come in pairs")
    return _where(F.sum, values, pairs, empty=0.0)


@_agg("COUNTIF", 2)
def COUNTIF(c, wanted):
    return F.count_if(_pairs((c, wanted))).cast("double")


@_agg("COUNTIFS", 2, None)
def COUNTIFS(*pairs):
    return F.count_if(_pairs(pairs)).cast("double")


@_agg("AVERAGEIF", 2, 3)
def AVERAGEIF(c, wanted, values=None):
    return _where(F.avg, values if values is not None else c, (c, wanted))


@_agg("AVERAGEIFS", 3, None)
def AVERAGEIFS(values, *pairs):
    return _where(F.avg, values, pairs)


@_agg("MINIFS", 3, None)
def MINIFS(values, *pairs):
    return _where(F.min, values, pairs, empty=0.0)


@_agg("MAXIFS", 3, None)
def MAXIFS(values, *pairs):
    return _where(F.max, values, pairs, empty=0.0)


# --- database --------------------------------------------------------------------------------------------------------
def database_filter(df: DataFrame, criteria: list[dict], text_columns: tuple[str, ...] = ()) -> Column:
    """OR over the criteria rows of the AND over their cells; bare text matches what begins with it; {} matches all."""
    rows = []
    for row in criteria:
        tests = [criterion(F.col(c), w, numeric=c not in text_columns and dict(df.dtypes)[c] != "string", begins=True) for c, w in row.items() if w is not None]
        rows.append(both(*tests) if tests else F.lit(True))
    out = rows[0]
    for r in rows[1:]:
        out = out | r
    return out


def _database(name: str, make):
    def build(df: DataFrame, field: str | None, criteria: list[dict], by: tuple[str, ...] = ()) -> DataFrame:
        """(value, error) of the matching rows; the error column is there for functions that can fail."""
        chosen = df.where(database_filter(df, criteria))
        value = make(F.col(field) if field is not None else F.lit(1.0))
        error = [error_of(value).alias("error")] if has_error(value) else []
        return chosen.groupBy(*by).agg(value.alias(name.lower()), *error)

    build.__name__ = name
    function(name, 3, 4, kind="relation")(build)
    return build


DSUM = _database("DSUM", SUM)
DAVERAGE = _database("DAVERAGE", AVERAGE)
DCOUNT = _database("DCOUNT", COUNT)
DCOUNTA = _database("DCOUNTA", COUNTA)
DMAX = _database("DMAX", MAX)
DMIN = _database("DMIN", MIN)


@function("DGET", 3, kind="relation")
def DGET(df: DataFrame, field: str, criteria: list[dict]) -> DataFrame:
    """(dget, error): the only match's value; none is #VALUE!, several #NUM!."""
    found = df.where(database_filter(df, criteria)).agg(F.count("*").alias("n"), F.first(field).alias("v"))
    return found.select(F.when(F.col("n") == 1, F.col("v")).alias("dget"), F.when(F.col("n") == 0, "#VALUE!").when(F.col("n") > 1, "#NUM!").alias("error"))


# --- dispersion and shape --------------------------------------------------------------------------------------------
def _named(names: tuple[str, ...], f, least: int, code: str):
    def build(x):
        return aggregated(f(ranged(x)), x, fails=((_n(x) < least, code),))

    build.__name__ = names[0]
    for n in names:
        function(n, 1, kind="aggregate")(build)
    return build


STDEV = _named(("STDEV", "STDEV.S"), F.stddev_samp, 2, DIV)
STDEVP = _named(("STDEVP", "STDEV.P"), F.stddev_pop, 1, DIV)
VAR = _named(("VAR", "VAR.S"), F.var_samp, 2, DIV)
VARP = _named(("VARP", "VAR.P"), F.var_pop, 1, DIV)
MEDIAN = _named(("MEDIAN",), F.median, 1, NUM)


def _positive(x, value: Column) -> Column:
    v = ranged(x)
    return aggregated(F.when(F.min(v) > 0, value), x, fails=((F.coalesce(F.min(v), F.lit(0.0)) <= 0, NUM),))


@_agg("GEOMEAN")
def GEOMEAN(x):
    return _positive(x, F.exp(F.avg(F.ln(ranged(x)))))


@_agg("HARMEAN")
def HARMEAN(x):
    return _positive(x, F.try_divide(_n(x), F.sum(F.try_divide(F.lit(1.0), ranged(x)))))


def _shaped(x, least: int, value: Column) -> Column:
    flat = (_n(x) < least) | ~F.coalesce(F.var_pop(ranged(x)) > 0, F.lit(False))
    return aggregated(F.when(~flat, value), x, fails=((flat, DIV),))


@_agg("SKEW")
def SKEW(x):
    n = _n(x)
    return _shaped(x, 3, F.skewness(ranged(x)) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


@_agg("KURT")
def KURT(x):
    n = _n(x)
    return _shaped(x, 4, F.try_divide(((n + 1) * F.kurtosis(ranged(x)) + 6) * (n - 1), (n - 2) * (n - 3)))


@function("AVEDEV", 2, 3, kind="relation")
def AVEDEV(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean absolute deviation by key: the means are joined back, so that a hot key is no window."""
    means = df.groupBy(*by).agg(F.avg(num(F.col(value))).alias("__mean"))
    joined = df.join(means, list(by)) if by else df.crossJoin(F.broadcast(means))
    return joined.groupBy(*by).agg(F.avg(F.abs(num(F.col(value)) - F.col("__mean"))).alias("avedev"))


def a_value(x: Column, kind: str) -> Column:
    """The A-rule: booleans are 1 and 0, text is 0."""
    return F.when(x.isNotNull(), F.lit(0.0)) if kind == "string" else num(x)


@_agg("AVERAGEA", 1, 2)
def AVERAGEA(x, kind: str = "double"):
    return aggregated(F.avg(a_value(x, kind)), x, fails=((F.count(a_value(x, kind)) == 0, DIV),))


@_agg("MAXA", 1, 2)
def MAXA(x, kind: str = "double"):
    return F.coalesce(F.max(a_value(x, kind)), F.lit(0.0))


@_agg("MINA", 1, 2)
def MINA(x, kind: str = "double"):
    return F.coalesce(F.min(a_value(x, kind)), F.lit(0.0))


# --- order statistics ------------------------------------------------------------------------------------------------
@_agg("PERCENTILE", 2)
def PERCENTILE(x, k: float):
    inside = 0 <= k <= 1
    return aggregated(F.percentile(ranged(x), F.lit(float(k) if inside else 0.0)), x, fails=((F.lit(not inside) | (_n(x) == 0), NUM),))


alias("PERCENTILE.INC", "PERCENTILE")


@_agg("QUARTILE", 2)
def QUARTILE(x, q: float):
    return PERCENTILE(x, int(q) / 4)


alias("QUARTILE.INC", "QUARTILE")


def _numbered(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Rows of numbers with their rank (__k), value (__v) and their key's count (__n).

    With a key, ranks are a window over it; without one, rows are numbered range by range, so no task sorts them all.
    """
    rows = df.withColumn("__v", ranged(F.col(value))).where(F.col("__v").isNotNull())
    counts = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    if not by:
        return numbered(rows, [F.col("__v")], "__k").crossJoin(F.broadcast(counts))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__v")))
    return ranked.join(counts, list(by))


def _kth(name: str, descending: bool):
    def build(df: DataFrame, value: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
        """(keys, value, error): the k-th number of each key, #NUM! if it has fewer.  Spark keeps k rows a task before it shuffles."""
        v = ranged(F.col(value))
        w = Window.partitionBy(*by).orderBy(v.desc() if descending else v)
        top = df.where(v.isNotNull()).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).where(F.col("__k") == k).select(*by, v.alias(name.lower()))
        # every key answers: those with too few numbers have an error
        keys = df.groupBy(*by).agg(F.lit(1).alias("__one"))
        joined = keys.join(top, list(by), "left") if by else keys.join(top, F.col("__one") == 1, "left")
        return joined.select(*by, name.lower(), F.when(F.col(name.lower()).isNull(), NUM).alias("error"))

    build.__name__ = name
    function(name, 3, 4, kind="relation")(build)
    return build


LARGE, SMALL = _kth("LARGE", True), _kth("SMALL", False)


@function("PERCENTILE.EXC", 3, 4, kind="relation")
def PERCENTILE_EXC(df: DataFrame, value: str, k: float, by: tuple[str, ...] = (), out: str = "percentile_exc") -> DataFrame:
    """Rank k (n + 1), which must lie in [1, n]; null and an error otherwise."""
    ranked = _numbered(df, value, by)
    at = F.lit(float(k)) * (F.col("__n") + 1)
    low = F.floor(at)
    near = ranked.where((F.col("__k") == low) | (F.col("__k") == low + 1))
    got = near.groupBy(*by, "__n").agg(F.max(F.when(F.col("__k") == low, F.col("__v"))).alias("a"), F.max(F.when(F.col("__k") == low + 1, F.col("__v"))).alias("b"))
    value_ = F.when((at >= 1) & (at <= F.col("__n")), F.col("a") + F.when(at == low, F.lit(0.0)).otherwise((at - low) * (F.col("b") - F.col("a"))))
    return got.select(*by, value_.alias(out)).withColumn("error", F.when(F.col(out).isNull(), NUM))


@function("QUARTILE.EXC", 3, 4, kind="relation")
def QUARTILE_EXC(df: DataFrame, value: str, q: int, by: tuple[str, ...] = ()) -> DataFrame:
    if int(q) not in (1, 2, 3):
        raise ValueError("#NUM!: q is 1, 2 or 3")
    return PERCENTILE_EXC(df, value, int(q) / 4, by, "quartile_exc")


def _value_counts(df: DataFrame, value: str, position: str, by: tuple[str, ...]) -> DataFrame:
    """(keys, __v, __n, __p): each number with its count and first position."""
    rows = df.select(*by, ranged(F.col(value)).alias("__v"), F.col(position).alias("__at"))
    return rows.groupBy(*by, "__v").agg(F.count("*").alias("__n"), F.min("__at").alias("__p"))


@function("MODE", 3, 4, kind="relation")
def MODE(df: DataFrame, value: str, position: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, mode, error): the most frequent number, the earliest on ties; #N/A if none occurs twice."""
    number = F.col("__v").isNotNull()
    best = F.min_by(F.when(number, F.col("__v")), F.struct(~number, -F.col("__n"), F.col("__p")))
    most = F.coalesce(F.max(F.when(number, F.col("__n"))), F.lit(0))
    out = _value_counts(df, value, position, by).groupBy(*by).agg(F.when(most > 1, best).alias("mode"))
    return out.withColumn("error", F.when(F.col("mode").isNull(), NA))


alias("MODE.SNGL", "MODE")


@function("MODE.MULT", 3, 4, kind="relation")
def MODE_MULT(df: DataFrame, value: str, position: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All most frequent numbers with their first positions, in whose order they come; a key without one (#N/A) has no row."""
    counts = _value_counts(df, value, position, by).where("__v IS NOT NULL")
    most = counts.groupBy(*by).agg(F.max("__n").alias("__most")).where("__most > 1")
    joined = counts.join(most, list(by)) if by else counts.crossJoin(F.broadcast(most))
    return joined.where("__n = __most").select(*by, F.col("__v").alias("mode_mult"), F.col("__p").alias("first_position"))


@function("FREQUENCY", 3, kind="relation")
def FREQUENCY(df: DataFrame, value: str, bins: list[float]) -> DataFrame:
    """(bin, upper, n): counts of numbers up to each bin's bound, bins in the given order, and one row beyond."""
    v = num(F.col(value))
    which = F.when(v <= bins[0], 0)
    for i, b in enumerate(bins[1:], 1):
        which = which.when(v <= b, i)
    counts = df.where(v.isNotNull()).groupBy(which.otherwise(len(bins)).alias("bin")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    all_bins = spark.createDataFrame([(i, float(b)) for i, b in enumerate(bins)] + [(len(bins), None)], "bin int, upper double")
    return F.broadcast(all_bins).join(counts, "bin", "left").select("bin", "upper", F.coalesce("n", F.lit(0)).alias("n"))


# --- SUBTOTAL and AGGREGATE ------------------------------------------------------------------------------------------
def _subtotal_codes() -> dict:
    return {1: AVERAGE, 2: COUNT, 3: COUNTA, 4: MAX, 5: MIN, 6: PRODUCT, 7: STDEV, 8: STDEVP, 9: SUM, 10: VAR, 11: VARP}


@_agg("SUBTOTAL", 2, None)
def SUBTOTAL(code: int, x):
    return _subtotal_codes()[code - 100 if code > 100 else code](x)


@_agg("AGGREGATE", 3, 4)
def AGGREGATE(code: int, options: int, x, k: float | None = None, error: Column | None = None):
    """Codes 1 to 13 and 16 to 17 as Columns (14 and 15 are LARGE and SMALL, 18 and 19 the exclusive forms: relations).

    Options 2, 3, 6 and 7 leave out rows whose ``error`` is set.
    """
    v = F.when(error.isNull(), x) if error is not None and options in (2, 3, 6, 7) else x
    if code in _subtotal_codes():
        return _subtotal_codes()[code](v)
    if code == 12:
        return MEDIAN(v)
    if code == 13:
        return F.mode(num(v), True)
    if code == 14:
        return F.element_at(F.sort_array(F.collect_list(num(v)), False), int(k))
    if code == 15:
        return F.element_at(F.sort_array(F.collect_list(num(v))), int(k))
    if code == 16:
        return PERCENTILE(v, k)
    if code == 17:
        return QUARTILE(v, k)
    raise ValueError("#VALUE!: codes 18 and 19 take the DataFrame, see aggregate_over")


def aggregate_over(df: DataFrame, code: int, options: int, value: str, k: float, by: tuple[str, ...] = (), error: str | None = None) -> DataFrame:
    """(keys, value, error) of codes 14 to 19 as relations, which gather no column in a group: LARGE, SMALL, the inclusive
    and the exclusive percentiles and quartiles."""
    rows = df.where(F.col(error).isNull()) if error is not None and options in (2, 3, 6, 7) else df
    if code in (14, 15):
        out, name = (LARGE if code == 14 else SMALL)(rows, value, int(k), by), "large" if code == 14 else "small"
    elif code in (16, 17):
        found = (PERCENTILE if code == 16 else QUARTILE)(F.col(value), k)
        out, name = rows.groupBy(*by).agg(found.alias("v"), error_of(found).alias("error")), "v"
    elif code == 18:
        out, name = PERCENTILE_EXC(rows, value, k, by), "percentile_exc"
    elif code == 19:
        out, name = QUARTILE_EXC(rows, value, int(k), by), "quartile_exc"
    else:
        raise ValueError("#VALUE!: codes 1 to 13 are Columns, see AGGREGATE")
    return out.select(*by, F.col(name).alias("value"), "error")


# --- regression ------------------------------------------------------------------------------------------------------
def _paired(a, b) -> tuple[Column, Column]:
    """Both numbers, or null where either is missing."""
    a_, b_ = ranged(a), ranged(b)
    ok = a_.isNotNull() & b_.isNotNull()
    return F.when(ok, a_), F.when(ok, b_)


def _flat(*columns: Column) -> Column:
    """Whether a column does not vary, or there is none."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.coalesce(F.var_pop(c) > 0, F.lit(False))
    return out


@_agg("CORREL", 2)
def CORREL(a, b):
    x, y = _paired(a, b)
    return aggregated(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), a, b, fails=((_flat(x, y), DIV),))


@_agg("RSQ", 2)
def RSQ(ys, xs):
    r = CORREL(ys, xs)
    return with_error(r * r, error_of(r))


@_agg("COVARIANCE.P", 2)
def COVARIANCE_P(a, b):
    x, y = _paired(a, b)
    return aggregated(F.covar_pop(x, y), a, b, fails=((F.count(x) < 1, DIV),))


@_agg("COVARIANCE.S", 2)
def COVARIANCE_S(a, b):
    x, y = _paired(a, b)
    return aggregated(F.covar_samp(x, y), a, b, fails=((F.count(x) < 2, DIV),))


@_agg("SLOPE", 2)
def SLOPE(ys, xs):
    y, x = _paired(ys, xs)
    return aggregated(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), ys, xs, fails=((_flat(x), DIV),))


@_agg("INTERCEPT", 2)
def INTERCEPT(ys, xs):
    y, x = _paired(ys, xs)
    slope = SLOPE(ys, xs)
    return with_error(F.avg(y) - slope * F.avg(x), error_of(slope))


@_agg("FORECAST", 3)
def FORECAST(x0, ys, xs):
    slope = SLOPE(ys, xs)
    return with_error(INTERCEPT(ys, xs) + slope * num(x0), error_of(slope))


alias("FORECAST.LINEAR", "FORECAST")


@function("TREND", 3, 5, kind="relation")
def TREND(df: DataFrame, ys: str, xs: str, new_xs: DataFrame | None = None, through_origin: bool = False) -> DataFrame:
    """(x, trend) on the fitted line for the rows of ``new_xs`` (column x) or of ``df``; the two parameters are broadcast."""
    y, x = _paired(F.col(ys), F.col(xs))
    if through_origin:
        line = df.agg(F.try_divide(F.sum(x * y), F.sum(x * x)).alias("__a"), F.lit(0.0).alias("__b"))
    else:
        line = df.agg(SLOPE(F.col(ys), F.col(xs)).alias("__a"), INTERCEPT(F.col(ys), F.col(xs)).alias("__b"))
    at = new_xs if new_xs is not None else df.select(num(F.col(xs)).alias("x"))
    return at.crossJoin(F.broadcast(line)).select("x", (F.col("__b") + F.col("__a") * num(F.col("x"))).alias("trend"))


def filled_down(facts: DataFrame, keys: DataFrame, on: list[str], **aggregates: Column) -> DataFrame:
    """A criteria aggregate filled down beside ``keys``: one grouping of the facts and a left join, not a scan a key.

    Counts and sums of keys without facts are 0 if wrapped in SUM or the like here; a key's absence gives null otherwise.
    """
    grouped = facts.groupBy(*on).agg(*[c.alias(n) for n, c in aggregates.items()])
    return keys.join(grouped, on, "left")
