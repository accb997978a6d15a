"""Queries of the aggregate, database, statistics, lookup, array, ranking and recurrence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgrid.functions import scalar_finance
from quillgrid.functions.core import call, error_of
from quillgrid.functions.criteria import criterion
from quillgrid.functions.scalar_logic import COMPARISONS
from quillgrid.operators import aggregates as A
from quillgrid.operators import arrays as R
from quillgrid.operators import lookup as L
from quillgrid.operators import ranking as K
from quillgrid.plans.recurrence import amortization, geometric
from quillgrid.queries.base import Catalog, c, read

PRICE = "CAST(l_extendedprice AS DECIMAL(18, 2))"


def price(name: str = "l_extendedprice"):
    """Money as an exact decimal, so that sums do not depend on their order."""
    return F.col(name).cast("decimal(18,2)")


def sumifs_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue and count of large lines by order priority: SUMIFS and COUNTIFS filled down over the priorities."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", price().alias("price"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    big = criterion(c("l_quantity"), ">25")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy("o_orderpriority").agg(F.sum(F.when(big, c("price"))).cast("double").alias("revenue"), F.count_if(big).alias("n_lines"))


def register(k: Catalog) -> None:
    def lines(name, build, sql, digits=4):
        k.grouped(name, "lineitem", "l_returnflag", build, sql, digits)

    def customers(name, build, sql, digits=4):
        k.grouped(name, "customer", "c_mktsegment", build, sql, digits)

    k.add(
        "sumifs_by_priority",
        sumifs_by_priority,
        f"SELECT o_orderpriority, CAST(sum({PRICE}) FILTER (WHERE l_quantity > 25) AS DOUBLE) AS revenue, count(*) FILTER (WHERE l_quantity > 25) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
    )
    q, flag, mode = (lambda: c("l_quantity")), (lambda: c("l_returnflag")), (lambda: A.TextColumn(c("l_linestatus")))
    # plain
    lines("sum", lambda: A.SUM(q()), "sum(l_quantity)")
    lines("average", lambda: A.AVERAGE(q()), "avg(l_quantity)")
    lines("count", lambda: A.COUNT(q()), "count(l_quantity)")
    lines("counta", lambda: A.COUNTA(flag()), "count(l_returnflag)")
    lines("countblank", lambda: A.COUNTBLANK(F.nullif(c("l_linestatus"), F.lit("O"))), "count(*) FILTER (WHERE l_linestatus = 'O')")
    lines("min", lambda: A.MIN(q()), "min(l_quantity)")
    lines("max", lambda: A.MAX(c("l_extendedprice")), "max(l_extendedprice)")
    lines("product", lambda: A.PRODUCT(F.lit(1.0) + c("l_discount") / 10000), "product(1.0 + l_discount / 10000)")
    lines("sumsq", lambda: A.SUMSQ(q()), "sum(l_quantity * l_quantity)")
    lines("sumproduct", lambda: A.SUMPRODUCT(q(), c("l_linenumber")), "sum(l_quantity * l_linenumber)")
    # criteria
    lines("sumif", lambda: A.SUMIF(q(), ">25"), "sum(l_quantity) FILTER (WHERE l_quantity > 25)")
    lines("sumifs", lambda: A.SUMIFS(q(), q(), ">=10", mode(), "o"), "sum(l_quantity) FILTER (WHERE l_quantity >= 10 AND lower(l_linestatus) = 'o')")
    lines("countif", lambda: A.COUNTIF(q(), "<>10"), "count(*) FILTER (WHERE l_quantity <> 10)")
    lines("countifs", lambda: A.COUNTIFS(q(), "<10", mode(), "<>o"), "count(*) FILTER (WHERE l_quantity < 10 AND lower(l_linestatus) <> 'o')")
    lines("averageif", lambda: A.AVERAGEIF(q(), "<=20"), "avg(l_quantity) FILTER (WHERE l_quantity <= 20)")
    lines("averageifs", lambda: A.AVERAGEIFS(q(), q(), "<=20", mode(), "F"), "avg(l_quantity) FILTER (WHERE l_quantity <= 20 AND l_linestatus = 'F')")
    lines("minifs", lambda: A.MINIFS(q(), q(), ">7"), "min(l_quantity) FILTER (WHERE l_quantity > 7)")
    lines("maxifs", lambda: A.MAXIFS(c("l_extendedprice"), q(), "<7"), "max(l_extendedprice) FILTER (WHERE l_quantity < 7)")
    k.add("wildcard_criteria", lambda s, d: read(s, d, "part").agg(A.COUNTIF(A.TextColumn(c("p_type")), "*e?l*").cast("bigint").alias("n")), "SELECT count(*) AS n FROM part WHERE p_type ILIKE '%e_l%'")
    k.add("blank_criteria", lambda s, d: read(s, d, "orders").agg(A.COUNTIF(A.TextColumn(F.nullif(c("o_orderstatus"), F.lit("O"))), "=").cast("bigint").alias("n")), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
    k.add("neq_criteria", lambda s, d: read(s, d, "orders").agg(A.COUNTIF(A.TextColumn(c("o_orderstatus")), "<>o").cast("bigint").alias("n")), "SELECT count(*) AS n FROM orders WHERE lower(o_orderstatus) <> 'o'")

    def filled(s, d):
        facts = read(s, d, "orders").select("o_custkey", price("o_totalprice").alias("price"))
        keys = read(s, d, "customer").select(c("c_custkey").alias("o_custkey"))
        out = A.filled_down(facts, keys, ["o_custkey"], spent=F.sum("price"), n=F.count("*"))
        return out.select("o_custkey", F.coalesce("spent", F.lit(0)).cast("double").alias("spent"), F.coalesce("n", F.lit(0)).alias("n"))

    k.add("filldown_sumifs", filled, "SELECT c_custkey AS o_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS spent, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
    # database
    crit = [{"o_orderstatus": "F", "o_totalprice": ">100000"}, {"o_orderpriority": "1", "o_totalprice": "<50000"}]
    where = "(lower(o_orderstatus) LIKE 'f%' AND o_totalprice > 100000) OR (o_orderpriority LIKE '1%' AND o_totalprice < 50000)"

    def db(name, op, sql):
        k.add(name, lambda s, d: op(read(s, d, "orders").withColumn("whole", F.floor("o_totalprice").cast("double")).withColumn("o_orderpriority", F.concat(F.lit("p"), "o_orderpriority")), "whole", [crit[0], crit[1] | {"o_orderpriority": "p1"}]).select(c(name).cast("double").alias("value")), f"SELECT CAST({sql} AS DOUBLE) AS value FROM (SELECT *, floor(o_totalprice) AS whole FROM orders) WHERE {where}")

    db("dsum", A.DSUM, "sum(whole)")
    db("daverage", A.DAVERAGE, "sum(CAST(whole AS BIGINT)) / CAST(count(*) AS DOUBLE)")
    db("dcount", A.DCOUNT, "count(whole)")
    db("dcounta", A.DCOUNTA, "count(whole)")
    db("dmax", A.DMAX, "max(whole)")
    db("dmin", A.DMIN, "min(whole)")
    k.add("dget", lambda s, d: A.DGET(read(s, d, "nation"), "n_name", [{"n_nationkey": 7}]), "SELECT n_name AS dget, CAST(NULL AS VARCHAR) AS error FROM nation WHERE n_nationkey = 7")
    # dispersion and shape
    for name, sql in (("stdev", "stddev_samp"), ("stdev_s", "stddev_samp"), ("stdevp", "stddev_pop"), ("stdev_p", "stddev_pop")):
        customers(name, lambda op=A.STDEV if sql.endswith("samp") else A.STDEVP: op(c("c_acctbal")), f"{sql}(c_acctbal)")
    for name, sql in (("var", "var_samp"), ("var_s", "var_samp"), ("varp", "var_pop"), ("var_p", "var_pop")):
        customers(name, lambda op=A.VAR if sql.endswith("samp") else A.VARP: op(c("c_acctbal") / 1000), f"{sql}(c_acctbal / 1000)")
    customers("median", lambda: A.MEDIAN(c("c_acctbal")), "median(c_acctbal)")
    lines("geomean", lambda: A.GEOMEAN(q()), "exp(avg(ln(l_quantity)))")
    lines("harmean", lambda: A.HARMEAN(q()), "count(*) / sum(1.0 / l_quantity)")
    customers("skew", lambda: A.SKEW(c("c_acctbal")), "skewness(c_acctbal)")
    customers("kurt", lambda: A.KURT(c("c_acctbal")), "kurtosis(c_acctbal)")
    k.add("avedev", lambda s, d: A.AVEDEV(read(s, d, "customer"), "c_acctbal", ("c_mktsegment",)).select("c_mktsegment", F.round("avedev", 4).alias("value")), "WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, round(avg(abs(c_acctbal - m)), 4) AS value FROM customer JOIN m USING (c_mktsegment) GROUP BY 1")
    lines("averagea", lambda: A.AVERAGEA(c("l_linestatus") == "O", "boolean"), "avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0 END)")
    lines("maxa", lambda: A.MAXA(c("l_linestatus") == "O", "boolean"), "max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)")
    lines("mina", lambda: A.MINA(F.when(q() > 5, q())), "min(l_quantity) FILTER (WHERE l_quantity > 5)")
    # order statistics
    customers("percentile", lambda: A.PERCENTILE(c("c_acctbal"), 0.9), "quantile_cont(c_acctbal, 0.9)")
    customers("percentile_inc", lambda: A.PERCENTILE(c("c_acctbal"), 0.25), "quantile_cont(c_acctbal, 0.25)")
    customers("quartile", lambda: A.QUARTILE(c("c_acctbal"), 3), "quantile_cont(c_acctbal, 0.75)")
    customers("quartile_inc", lambda: A.QUARTILE(c("c_acctbal"), 1), "quantile_cont(c_acctbal, 0.25)")
    by = ("c_mktsegment",)
    exc = lambda p: f"WITH r AS (SELECT c_mktsegment, c_acctbal AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)), t AS (SELECT *, {p} * (n + 1) AS a FROM r) SELECT c_mktsegment, round(max(CASE WHEN k = floor(a) THEN v END) + (max(a) - floor(max(a))) * (max(CASE WHEN k = floor(a) + 1 THEN v END) - max(CASE WHEN k = floor(a) THEN v END)), 4) AS value FROM t GROUP BY 1"
    k.add("percentile_exc", lambda s, d: A.PERCENTILE_EXC(read(s, d, "customer"), "c_acctbal", 0.9, by).select("c_mktsegment", F.round("percentile_exc", 4).alias("value")), exc("0.9"))
    k.add("percentile_exc_all", lambda s, d: A.PERCENTILE_EXC(read(s, d, "customer"), "c_acctbal", 0.9).select(F.round("percentile_exc", 4).alias("value")), exc("0.9").replace("PARTITION BY c_mktsegment ORDER", "ORDER").replace("(PARTITION BY c_mktsegment)", "()").replace("SELECT c_mktsegment, round", "SELECT round").replace(" GROUP BY 1", ""))
    k.add("quartile_exc", lambda s, d: A.QUARTILE_EXC(read(s, d, "customer"), "c_acctbal", 1, by).select("c_mktsegment", F.round("quartile_exc", 4).alias("value")), exc("0.25"))
    for name, op, order in (("large", A.LARGE, "DESC"), ("small", A.SMALL, "ASC")):
        k.add(name, lambda s, d, op=op, name=name: op(read(s, d, "customer"), "c_acctbal", 3, by).select("c_mktsegment", c(name).alias("value")), f"SELECT c_mktsegment, c_acctbal AS value FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal {order}) AS k FROM customer) WHERE k = 3")
    modes = "WITH g AS (SELECT l_returnflag, l_quantity AS v, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY 1, 2), m AS (SELECT l_returnflag, max(n) AS n FROM g GROUP BY 1)"
    at = lambda s, d: read(s, d, "lineitem").select("l_returnflag", "l_quantity", (c("l_orderkey") * 10 + c("l_linenumber")).alias("at"))
    for name in ("mode", "mode_sngl"):
        k.add(name, lambda s, d: A.MODE(at(s, d), "l_quantity", "at", ("l_returnflag",)).select("l_returnflag", c("mode").alias("value")), f"{modes} SELECT l_returnflag, arg_min(v, p) AS value FROM g JOIN m USING (l_returnflag, n) GROUP BY 1")
    k.add("mode_mult", lambda s, d: A.MODE_MULT(at(s, d), "l_quantity", "at", ("l_returnflag",)), f"{modes} SELECT l_returnflag, v AS mode_mult, p AS first_position FROM g JOIN m USING (l_returnflag, n)")
    k.add("frequency", lambda s, d: A.FREQUENCY(read(s, d, "lineitem"), "l_quantity", [10, 30, 20]), "WITH b(bin, upper) AS (VALUES (0, 10.0::DOUBLE), (1, 30.0), (2, 20.0), (3, NULL)), g AS (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 1 WHEN l_quantity <= 20 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(bin AS INTEGER) AS bin, upper, coalesce(n, 0) AS n FROM b LEFT JOIN g USING (bin)")
    lines("subtotal", lambda: A.SUBTOTAL(101, q()), "avg(l_quantity)")
    lines("aggregate", lambda: A.AGGREGATE(9, 6, q(), error=F.when(c("l_linestatus") == "O", "#N/A")), "sum(l_quantity) FILTER (WHERE l_linestatus <> 'O')")
    # regression
    xy = lambda op: (lambda: op(c("l_extendedprice") / 1000, c("l_quantity")))
    Y = "l_extendedprice / 1000, l_quantity"
    lines("correl", xy(A.CORREL), f"corr({Y})")
    lines("rsq", xy(A.RSQ), f"regr_r2({Y})")
    lines("covariance_p", xy(A.COVARIANCE_P), f"covar_pop({Y})")
    lines("covariance_s", xy(A.COVARIANCE_S), f"covar_samp({Y})")
    lines("slope", xy(A.SLOPE), f"regr_slope({Y})")
    lines("intercept", xy(A.INTERCEPT), f"regr_intercept({Y})")
    for name in ("forecast", "forecast_linear"):
        lines(name, lambda: A.FORECAST(60, c("l_extendedprice") / 1000, c("l_quantity")), f"regr_intercept({Y}) + 60 * regr_slope({Y})")
    k.add("trend", lambda s, d: A.TREND(read(s, d, "lineitem"), "l_extendedprice", "l_quantity", s.range(1, 61).select(c("id").cast("double").alias("x"))).select("x", F.round("trend", 3).alias("trend")), "SELECT CAST(x.range AS DOUBLE) AS x, round(b + a * x.range, 3) AS trend FROM range(1, 61) x, (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)")
    register_errors(k)
    register_lookups(k)
    register_arrays(k)
    register_windows(k)
    register_flows(k)


def register_errors(k: Catalog) -> None:
    """Text and booleans in ranges, error codes of aggregates, codes of SUBTOTAL and AGGREGATE, comparisons."""
    lines = lambda s, d: read(s, d, "lineitem")
    r4 = lambda x: F.round(x, 4)
    flagged = lambda: c("l_linestatus") == "O"
    mixed = lambda: {"text_sum": A.SUM(c("l_linestatus")), "text_count": A.COUNT(c("l_linestatus")), "boolean_sum": A.SUM(flagged()), "boolean_count": A.COUNT(flagged()), "text_counta": A.COUNTA(c("l_linestatus")), "number_count": A.COUNT(c("l_quantity"))}
    k.add("mixed_ranges", lambda s, d: lines(s, d).groupBy("l_returnflag").agg(*[v.alias(n) for n, v in mixed().items()]), "SELECT l_returnflag, 0.0::DOUBLE AS text_sum, 0.0::DOUBLE AS text_count, 0.0::DOUBLE AS boolean_sum, 0.0::DOUBLE AS boolean_count, count(l_linestatus)::DOUBLE AS text_counta, count(l_quantity)::DOUBLE AS number_count FROM lineitem GROUP BY 1")

    def coded(s, d):
        only = F.when((c("c_nationkey") % 5 == 0), c("c_acctbal"))
        average, spread, middle, some = A.AVERAGE(only), A.STDEV(F.when(c("c_custkey") % 97 == 0, c("c_acctbal"))), A.MEDIAN(only), A.AVERAGEIFS(c("c_acctbal"), c("c_acctbal"), ">9990")
        out = {"average": average, "stdev": spread, "median": middle, "averageifs": some}
        return read(s, d, "customer").groupBy("c_nationkey").agg(*[r4(v).alias(n) for n, v in out.items()], *[error_of(v).alias(f"{n}_error") for n, v in out.items()])

    codes = "round(avg({0}), 4) AS average, round(stddev_samp({1}), 4) AS stddev, round(median({0}), 4) AS median, round(avg({2}), 4) AS averageifs, CASE WHEN count({0}) = 0 THEN '#DIV/0!' END AS average_error, CASE WHEN count({1}) < 2 THEN '#DIV/0!' END AS stdev_error, CASE WHEN count({0}) = 0 THEN '#NUM!' END AS median_error, CASE WHEN count({2}) = 0 THEN '#DIV/0!' END AS averageifs_error".replace("AS stddev,", "AS stdev,")
    k.add("aggregate_errors", coded, "SELECT c_nationkey, " + codes.format("CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal END", "CASE WHEN c_custkey % 97 = 0 THEN c_acctbal END", "CASE WHEN c_acctbal > 9990 THEN c_acctbal END") + " FROM customer GROUP BY 1")

    def passed_on(s, d):
        root = call("SQRT", c("c_acctbal"))
        total, largest, n, chosen = A.SUM(root), A.MAX(root), A.COUNT(root), A.SUMIFS(root, c("c_acctbal"), ">0")
        return read(s, d, "customer").groupBy("c_mktsegment", (c("c_acctbal") < 0).alias("owes")).agg(r4(total).alias("total"), error_of(total).alias("total_error"), error_of(largest).alias("max_error"), n.alias("n"), r4(chosen).alias("chosen"))

    k.add("errors_passed_on", passed_on, "SELECT c_mktsegment, c_acctbal < 0 AS owes, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(sum(CASE WHEN c_acctbal >= 0 THEN sqrt(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) END), 4) END AS total, CASE WHEN c_acctbal < 0 THEN '#NUM!' END AS total_error, CASE WHEN c_acctbal < 0 THEN '#NUM!' END AS max_error, CAST(count(CASE WHEN c_acctbal >= 0 THEN 1 END) AS DOUBLE) AS n, round(coalesce(sum(sqrt(CASE WHEN c_acctbal > 0 THEN c_acctbal END)), 0), 4) AS chosen FROM customer GROUP BY c_mktsegment, c_acctbal < 0".replace("CASE WHEN c_acctbal < 0 THEN NULL ELSE round", "CASE WHEN bool_or(c_acctbal < 0) THEN NULL ELSE round").replace("CASE WHEN c_acctbal < 0 THEN '#NUM!'", "CASE WHEN bool_or(c_acctbal < 0) THEN '#NUM!'"))
    q = lambda: c("l_quantity")
    plain = {1: "avg({})", 2: "count({})", 3: "count({})", 4: "max({})", 5: "min({})", 7: "stddev_samp({})", 8: "stddev_pop({})", 9: "sum({})", 10: "var_samp({})", 11: "var_pop({})"}
    k.add("subtotal_codes", lambda s, d: lines(s, d).groupBy("l_returnflag").agg(*[r4(A.SUBTOTAL(code + 100 * (code % 2), q()).cast("double")).alias(f"c{code}") for code in plain]), "SELECT l_returnflag, " + ", ".join(f"round(CAST({x.format('l_quantity')} AS DOUBLE), 4) AS c{n}" for n, x in plain.items()) + " FROM lineitem GROUP BY 1")
    k.add("subtotal_product", lambda s, d: lines(s, d).where("l_linenumber <= 4 AND l_orderkey <= 40").groupBy("l_orderkey").agg(A.SUBTOTAL(6, c("l_linenumber")).alias("value")), "SELECT l_orderkey, CAST(product(l_linenumber) AS DOUBLE) AS value FROM lineitem WHERE l_linenumber <= 4 AND l_orderkey <= 40 GROUP BY 1")
    left_out = lambda: F.when(c("l_linestatus") == "O", "#N/A")
    all_codes = plain | {12: "median({})", 16: "quantile_cont({}, 0.3)", 17: "quantile_cont({}, 0.75)"}
    argument = {16: 0.3, 17: 3}
    k.add("aggregate_codes", lambda s, d: lines(s, d).groupBy("l_returnflag").agg(*[r4(A.AGGREGATE(code, 6, q(), argument.get(code), error=left_out()).cast("double")).alias(f"c{code}") for code in all_codes]), "SELECT l_returnflag, " + ", ".join(f"round(CAST({x.format('v')} AS DOUBLE), 4) AS c{n}" for n, x in all_codes.items()) + " FROM (SELECT l_returnflag, CASE WHEN l_linestatus <> 'O' THEN l_quantity END AS v FROM lineitem) GROUP BY 1")
    ranked = "(SELECT c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal {}) AS k FROM customer)"
    for code, way in ((14, "DESC"), (15, "ASC")):
        k.add(f"aggregate_{code}", lambda s, d, code=code: A.aggregate_over(read(s, d, "customer"), code, 4, "c_acctbal", 4, ("c_mktsegment",)), f"SELECT c_mktsegment, v AS value, CAST(NULL AS VARCHAR) AS error FROM {ranked.format(way)} WHERE k = 4")
    for code, arg, share in ((18, 0.3, 0.3), (19, 3, 0.75)):
        k.add(f"aggregate_{code}", lambda s, d, code=code, arg=arg: A.aggregate_over(read(s, d, "customer"), code, 4, "c_acctbal", arg, ("c_mktsegment",)).withColumn("value", r4(c("value"))), f"WITH r AS (SELECT *, {share} * (count(*) OVER (PARTITION BY c_mktsegment) + 1) AS a FROM {ranked.format('ASC')}) SELECT c_mktsegment, round(max(CASE WHEN k = floor(a) THEN v END) + (max(a) - floor(max(a))) * (max(CASE WHEN k = floor(a) + 1 THEN v END) - max(CASE WHEN k = floor(a) THEN v END)), 4) AS value, CAST(NULL AS VARCHAR) AS error FROM r GROUP BY 1")
    k.add("large_too_few", lambda s, d: A.LARGE(read(s, d, "nation"), "n_nationkey", 6, ("n_regionkey",)), "SELECT n_regionkey, CAST(NULL AS DOUBLE) AS large, '#NUM!' AS error FROM nation GROUP BY 1")
    k.add("rank_of", lambda s, d: read(s, d, "nation").groupBy("n_regionkey").agg(*[x for n, v in (("rank", K.rank_of(7, c("n_nationkey"))), ("percentrank", K.percentrank_of(7, c("n_nationkey")))) for x in (v.alias(n), error_of(v).alias(f"{n}_error"))]), "WITH g AS (SELECT n_regionkey, count(*) AS n, count(*) FILTER (WHERE n_nationkey > 7) AS above, count(*) FILTER (WHERE n_nationkey < 7) AS below, count(*) FILTER (WHERE n_nationkey = 7) AS here, min(n_nationkey) AS lo, max(n_nationkey) AS hi, max(n_nationkey) FILTER (WHERE n_nationkey < 7) AS l, min(n_nationkey) FILTER (WHERE n_nationkey > 7) AS h FROM nation GROUP BY 1) SELECT n_regionkey, CASE WHEN here > 0 THEN CAST(above + 1 AS DOUBLE) END AS rank, CASE WHEN here = 0 THEN '#N/A' END AS rank_error, CASE WHEN lo <= 7 AND hi >= 7 THEN floor((CASE WHEN here > 0 THEN below ELSE below - 1 + (7 - l) / CAST(h - l AS DOUBLE) END) / CAST(n - 1 AS DOUBLE) * 1000 + 1e-9) / 1000 END AS percentrank, CASE WHEN lo <= 7 AND hi >= 7 THEN NULL ELSE '#N/A' END AS percentrank_error FROM g")
    for name, sign, sql in (("op_eq", "=", "="), ("op_ne", "<>", "<>"), ("op_lt", "<", "<"), ("op_le", "<=", "<="), ("op_gt", ">", ">"), ("op_ge", ">=", ">=")):
        k.add(name, lambda s, d, sign=sign: read(s, d, "part").select("p_partkey", COMPARISONS[sign](c("p_size"), 25).alias("numbers"), COMPARISONS[sign](c("p_brand"), "bRAND#3").alias("texts"), COMPARISONS[sign](c("p_size"), "1").alias("kinds"), COMPARISONS[sign](c("p_size") > 25, True).alias("booleans"), COMPARISONS[sign](F.nullif(c("p_size"), F.lit(7)), 0).alias("blanks")), f"SELECT p_partkey, p_size {sql} 25 AS numbers, lower(p_brand) {sql} 'brand#3' AS texts, 0 {sql} 1 AS kinds, (p_size > 25) {sql} true AS booleans, coalesce(nullif(p_size, 7), 0) {sql} 0 AS blanks FROM part")


def register_lookups(k: Catalog) -> None:
    facts = lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = lambda s, d: read(s, d, "part").where("p_size <= 25").select("p_partkey", "p_name")
    base = "SELECT l_orderkey, l_linenumber, l_partkey, {} FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey"
    k.add("xlookup_exact", lambda s, d: L.XLOOKUP(facts(s, d), "l_partkey", parts(s, d), "p_partkey", ["p_name"]), base.format("p_name"))
    k.add("xlookup_if_not_found", lambda s, d: L.XLOOKUP(facts(s, d), "l_partkey", parts(s, d), "p_partkey", ["p_name"], if_not_found="none"), base.format("coalesce(p_name, 'none') AS p_name"))
    k.add("vlookup_exact", lambda s, d: L.VLOOKUP(facts(s, d), "l_partkey", parts(s, d), "p_partkey", ["p_name"], approximate=False), base.format("p_name"))
    orders = lambda s, d: read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    cust = lambda s, d: read(s, d, "customer").select("c_custkey", "c_name")
    last = "SELECT c_custkey, c_name, v AS o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, {}(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey"
    k.add("xlookup_last", lambda s, d: L.XLOOKUP(cust(s, d), "c_custkey", orders(s, d), "o_custkey", ["o_totalprice"], 0, -1, "o_orderkey"), last.format("arg_max"))
    k.add("xlookup_first", lambda s, d: L.XLOOKUP(cust(s, d), "c_custkey", orders(s, d), "o_custkey", ["o_totalprice"], 0, 1, "o_orderkey"), last.format("arg_min"))

    def bands(s):
        return s.createDataFrame([(0.0, "low", 1), (20000.0, "mid", 2), (50000.0, "high", 3)], "floor double, band string, spot int")

    priced = lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    V = "(VALUES (0.0::DOUBLE, 'low', 1), (20000.0, 'mid', 2), (50000.0, 'high', 3)) b(floor, band, spot)"
    asof = "SELECT l_orderkey, l_linenumber, l_extendedprice, {} FROM lineitem ASOF LEFT JOIN " + V + " ON l_extendedprice {} floor"
    k.add("vlookup_approx", lambda s, d: L.VLOOKUP(priced(s, d), "l_extendedprice", bands(s), "floor", ["band"]), asof.format("band", ">="))
    k.add("lookup", lambda s, d: L.LOOKUP(priced(s, d), "l_extendedprice", bands(s), "floor", ["band"]), asof.format("band", ">="))
    k.add("xlookup_next_smaller", lambda s, d: L.XLOOKUP(priced(s, d), "l_extendedprice", bands(s), "floor", ["band"], -1), asof.format("band", ">="))
    k.add("xlookup_next_larger", lambda s, d: L.XLOOKUP(priced(s, d), "l_extendedprice", bands(s), "floor", ["band"], 1), asof.format("band", "<="))
    k.add("match_1", lambda s, d: L.MATCH(priced(s, d), "l_extendedprice", bands(s), "floor", "spot", 1), asof.format("spot AS match", ">="))
    k.add("match_minus_1", lambda s, d: L.MATCH(priced(s, d), "l_extendedprice", bands(s), "floor", "spot", -1).withColumn("match", F.coalesce("match", F.lit(0))), asof.format("coalesce(spot, 0) AS match", "<="))
    k.add("xmatch", lambda s, d: L.XMATCH(priced(s, d), "l_extendedprice", bands(s), "floor", "spot", -1), asof.format("spot AS xmatch", ">="))
    k.add("match_0", lambda s, d: L.MATCH(facts(s, d), "l_partkey", read(s, d, "part").select("p_partkey", (c("p_partkey") + 1).alias("at")), "p_partkey", "at"), "SELECT l_orderkey, l_linenumber, l_partkey, p_partkey + 1 AS match FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
    k.add("index", lambda s, d: L.INDEX(read(s, d, "supplier").select("s_suppkey", F.expr("s_nationkey + 1").alias("at_row")), "at_row", read(s, d, "nation").select((c("n_nationkey") + 1).alias("pos"), "n_name"), "pos"), "SELECT s_suppkey, s_nationkey + 1 AS at_row, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
    k.add("index_match", lambda s, d: L.exact_join(read(s, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("seg")), "seg", s.createDataFrame([("BUILDING", "one"), ("MACHINERY", "two")], "segment string, code string"), "segment", ["code"]), "SELECT c_custkey, lower(c_mktsegment) AS seg, CASE lower(c_mktsegment) WHEN 'building' THEN 'one' WHEN 'machinery' THEN 'two' END AS code FROM customer")
    words = lambda s: s.createDataFrame([(1, "NATION_1"), (2, "nation_1*"), (3, "*_?"), (4, "none*"), (5, "~*"), (6, "*.1"), (7, None)], "id int, want string")
    W = "(VALUES (1, 'nation\\_1'), (2, 'nation\\_1%'), (3, '%\\__'), (4, 'none%'), (5, '*'), (6, '%.1'), (7, NULL)) w(id, p)"
    wild = f"FROM {W} LEFT JOIN nation ON n_name ILIKE p ESCAPE '\\' GROUP BY id"
    k.add("xlookup_wildcard", lambda s, d: L.XLOOKUP(words(s), "want", read(s, d, "nation"), "n_name", ["n_nationkey"], 2, 1, "n_nationkey", error="error").drop("want"), f"SELECT id, min(n_nationkey) AS n_nationkey, CASE WHEN count(n_nationkey) = 0 THEN '#N/A' END AS error {wild}")
    k.add("match_wildcard", lambda s, d: L.MATCH(words(s), "want", read(s, d, "nation").select("n_name", (c("n_nationkey") + 1).alias("at")), "n_name", "at", error="error").drop("want"), f"SELECT id, min(n_nationkey) + 1 AS match, CASE WHEN count(n_nationkey) = 0 THEN '#N/A' END AS error {wild}")
    k.add("xlookup_blank_found", lambda s, d: L.XLOOKUP(read(s, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", read(s, d, "region").where("r_regionkey < 3").select("r_regionkey", F.nullif(c("r_name"), F.lit("AFRICA")).alias("r_name")), "r_regionkey", ["r_name"], if_not_found="none"), "SELECT n_nationkey, n_regionkey, CASE WHEN r_regionkey IS NULL THEN 'none' ELSE nullif(r_name, 'AFRICA') END AS r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
    k.add("vlookup_error", lambda s, d: L.VLOOKUP(facts(s, d), "l_partkey", parts(s, d), "p_partkey", ["p_name"], approximate=False, error="error"), base.format("p_name, CASE WHEN p_partkey IS NULL THEN '#N/A' END AS error"))
    k.add("index_column", lambda s, d: L.INDEX(read(s, d, "supplier").select("s_suppkey", F.expr("s_nationkey + 4").alias("at_row")), "at_row", read(s, d, "nation").select((c("n_nationkey") + 1).alias("pos"), "n_regionkey", "n_name"), "pos", column=2, error="error"), "SELECT s_suppkey, s_nationkey + 4 AS at_row, n_name, CASE WHEN n_nationkey IS NULL THEN '#REF!' END AS error FROM supplier LEFT JOIN nation ON n_nationkey + 1 = s_nationkey + 4")
    k.add("index_whole_column", lambda s, d: L.INDEX(read(s, d, "region").select("r_regionkey", F.lit(0).alias("at_row")), "at_row", read(s, d, "nation").select((c("n_nationkey") + 1).alias("pos"), "n_name"), "pos"), "SELECT r_regionkey, 0 AS at_row, n_name FROM region CROSS JOIN nation")
    k.add("hlookup_approx", lambda s, d: L.HLOOKUP(s.createDataFrame([("Bzz",), ("c",), ("A",)], "want string"), "want", read(s, d, "nation").select("n_nationkey", c("n_regionkey").alias("b"), (c("n_nationkey") * 2).alias("c")), ["b", "c"], "n_nationkey", True), "SELECT 'Bzz' AS want, n_nationkey, n_regionkey AS value FROM nation UNION ALL SELECT 'c', n_nationkey, n_nationkey * 2 FROM nation UNION ALL SELECT 'A', NULL, NULL")
    k.add("hlookup", lambda s, d: L.HLOOKUP(s.createDataFrame([("B",), ("c",)], "want string"), "want", read(s, d, "nation").select("n_nationkey", c("n_regionkey").alias("b"), (c("n_nationkey") * 2).alias("c")), ["b", "c"], "n_nationkey"), "SELECT 'B' AS want, n_nationkey, n_regionkey AS value FROM nation UNION ALL SELECT 'c', n_nationkey, n_nationkey * 2 FROM nation")
    k.add("countif_anti", lambda s, d: L.anti(read(s, d, "customer").select("c_custkey"), "c_custkey", read(s, d, "orders"), "o_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    k.add("match_semi", lambda s, d: L.semi(read(s, d, "customer").select("c_custkey"), "c_custkey", read(s, d, "orders"), "o_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
    k.add("wildcard_lookup", lambda s, d: L.wildcard_join(read(s, d, "region").select("r_regionkey"), read(s, d, "nation"), "n_name", "*1*", ["n_name"], "n_nationkey"), "SELECT r_regionkey, (SELECT arg_min(n_name, n_nationkey) FROM nation WHERE n_name ILIKE '%1%') AS n_name FROM region")
    k.add("asof_large", lambda s, d: L._as_of_merge(read(s, d, "events").select("event_id", c("value").alias("x")), "x", read(s, d, "orders").select((c("o_totalprice") / 1000).alias("p"), "o_orderkey").groupBy("p").agg(F.max("o_orderkey").alias("o_orderkey")), "p", ["o_orderkey"], False).withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1))), "SELECT event_id, value AS x, coalesce(o_orderkey, -1) AS o_orderkey FROM events ASOF LEFT JOIN (SELECT o_totalprice / 1000 AS p, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON value >= p")
    k.add("rows", lambda s, d: L.ROWS(read(s, d, "lineitem")), "SELECT count(*) AS rows FROM lineitem")
    k.add("columns", lambda s, d: s.range(1).select(F.lit(L.COLUMNS(read(s, d, "part"))).cast("bigint").alias("columns"), F.lit(L.COLUMN(read(s, d, "part"), "p_brand")).cast("bigint").alias("at")), "SELECT CAST(6 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS at")
    k.add("indirect", lambda s, d: L.INDIRECT({"Nations": read(s, d, "nation")}, "Nations!n_name"), "SELECT n_name FROM nation")


def register_arrays(k: Catalog) -> None:
    nation = lambda s, d: read(s, d, "nation").select((c("n_nationkey") + 1).cast("bigint").alias("pos"), "n_name", "n_regionkey")
    N = "(SELECT CAST(n_nationkey + 1 AS BIGINT) AS pos, n_name, n_regionkey FROM nation)"
    k.add("filter", lambda s, d: R.FILTER(nation(s, d), c("n_regionkey") == 2), f"SELECT * FROM {N} WHERE n_regionkey = 2")
    k.add("filter_if_empty", lambda s, d: R.FILTER(nation(s, d), c("n_regionkey") == 99, s.createDataFrame([(0, "none", 0)], "pos long, n_name string, n_regionkey int")), "SELECT CAST(0 AS BIGINT) AS pos, 'none' AS n_name, CAST(0 AS INTEGER) AS n_regionkey")
    k.add("sort", lambda s, d: R.numbered(read(s, d, "part").select("p_partkey", "p_size"), R.sort_keys(read(s, d, "part"), [("p_size", -1)], "p_partkey")), "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS pos FROM part")
    k.add("sortby", lambda s, d: R.numbered(read(s, d, "part").select("p_partkey", "p_brand", "p_size"), R.sort_keys(read(s, d, "part"), [("p_brand", 1), ("p_size", -1)], "p_partkey")), "SELECT p_partkey, p_brand, p_size, row_number() OVER (ORDER BY lower(p_brand), p_size DESC, p_partkey) AS pos FROM part")
    k.add("unique", lambda s, d: R.UNIQUE(read(s, d, "part").select("p_brand", "p_size", "p_partkey"), "p_partkey"), "SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2")
    k.add("unique_once", lambda s, d: R.UNIQUE(read(s, d, "part").select("p_type", "p_size", "p_partkey"), "p_partkey", True), "SELECT p_type, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2 HAVING count(*) = 1")
    k.add("take", lambda s, d: R.TAKE(nation(s, d), 5, "pos"), f"SELECT * FROM {N} WHERE pos <= 5")
    k.add("take_last", lambda s, d: R.TAKE(nation(s, d), -4, "pos"), f"SELECT * FROM {N} WHERE pos > 21")
    k.add("take_columns", lambda s, d: R.TAKE(nation(s, d), 5, "pos", -1), f"SELECT pos, n_regionkey FROM {N} WHERE pos <= 5")
    k.add("drop_columns", lambda s, d: R.DROP(nation(s, d), -5, "pos", 1), f"SELECT pos, n_regionkey FROM {N} WHERE pos <= 20")
    k.add("filter_columns", lambda s, d: R.FILTER(nation(s, d), [True, False, True]), f"SELECT pos, n_regionkey FROM {N}")
    k.add("drop", lambda s, d: R.DROP(nation(s, d), 5, "pos"), f"SELECT * FROM {N} WHERE pos > 5")
    k.add("choosecols", lambda s, d: R.CHOOSECOLS(nation(s, d), -1, 1, 1), f"SELECT n_regionkey, pos, pos AS pos_2 FROM {N}")
    k.add("chooserows", lambda s, d: R.CHOOSEROWS(nation(s, d), "pos", 3, -1, 3), f"SELECT pos, n_name, n_regionkey, CAST(pick AS INTEGER) AS pick FROM {N} JOIN (VALUES (1, 3), (2, 25), (3, 3)) w(pick, spot) ON pos = spot")
    k.add("vstack", lambda s, d: R.VSTACK(nation(s, d).drop("n_regionkey"), read(s, d, "region").select((c("r_regionkey") + 1).cast("bigint").alias("pos"), c("r_name").alias("n_name"), F.lit("x").alias("extra"))), "SELECT CAST(n_nationkey + 1 AS BIGINT) AS pos, n_name, CAST(1 AS INTEGER) AS part, CAST(NULL AS VARCHAR) AS extra FROM nation UNION ALL SELECT r_regionkey + 1, r_name, 2, 'x' FROM region")
    k.add("hstack", lambda s, d: R.HSTACK(nation(s, d), read(s, d, "region").select((c("r_regionkey") + 1).cast("bigint").alias("pos"), "r_name")), f"SELECT pos, n_name, n_regionkey, r_name FROM {N} LEFT JOIN region ON r_regionkey + 1 = pos")
    k.add("transpose", lambda s, d: R.TRANSPOSE(nation(s, d), "pos"), f"SELECT CAST(1 AS INTEGER) AS row, pos AS col, n_name AS value FROM {N} UNION ALL SELECT 2, pos, CAST(n_regionkey AS VARCHAR) FROM {N}")
    k.add("sequence", lambda s, d: R.SEQUENCE(s, 100, 2, 5, 3), "SELECT CAST(range AS BIGINT) AS pos, CAST(5 + 3 * (range - 1) * 2 AS DOUBLE) AS c1, CAST(5 + 3 * ((range - 1) * 2 + 1) AS DOUBLE) AS c2 FROM range(1, 101)")
    k.add("textsplit", lambda s, d: R.TEXTSPLIT(read(s, d, "part").select("p_partkey", "p_type"), "p_type", " ").select("p_partkey", c("c").cast("bigint").alias("c"), "piece"), "SELECT p_partkey, CAST(unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS BIGINT) AS c, unnest(string_split(p_type, ' ')) AS piece FROM part")
    k.add("union_distinct", lambda s, d: R.union_distinct(read(s, d, "customer").select(c("c_nationkey").alias("k")), read(s, d, "supplier").select(c("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
    k.add("intersect", lambda s, d: R.intersect(read(s, d, "customer").select(c("c_nationkey").alias("k")), read(s, d, "supplier").select(c("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
    k.add("except", lambda s, d: R.subtract(read(s, d, "customer").select(c("c_custkey").alias("k")), read(s, d, "orders").select(c("o_custkey").alias("k"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")


def register_windows(k: Catalog) -> None:
    by = ("c_mktsegment",)
    w = "PARTITION BY c_mktsegment"

    def rank(name, build, sql):
        k.add(name, lambda s, d: read(s, d, "customer").select("c_custkey", F.round(build(c("c_nationkey")), 6).alias("value")), f"SELECT c_custkey, round(CAST({sql} AS DOUBLE), 6) AS value FROM customer")

    for name in ("rank", "rank_eq"):
        rank(name, lambda x: K.RANK(x, by), f"rank() OVER ({w} ORDER BY c_nationkey DESC)")
    rank("rank_avg", lambda x: K.RANK_AVG(x, by, True), f"rank() OVER ({w} ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0")
    for name in ("percentrank", "percentrank_inc"):
        rank(name, lambda x: K.PERCENTRANK(x, by), f"floor(percent_rank() OVER ({w} ORDER BY c_nationkey) * 1000 + 1e-9) / 1000")
    rank("percentrank_exc", lambda x: K.PERCENTRANK_EXC(x, by), f"floor(rank() OVER ({w} ORDER BY c_nationkey) / (count(*) OVER ({w}) + 1.0) * 1000 + 1e-9) / 1000")
    k.add("rank_over_all", lambda s, d: K.rank_over_all(read(s, d, "part").select("p_partkey", "p_size"), "p_size"), "SELECT p_partkey, p_size, CAST(rank() OVER (ORDER BY p_size DESC) AS DOUBLE) AS rank FROM part")
    order = lambda: [c("o_orderkey")]

    def run(name, build, sql):
        k.add(name, lambda s, d: read(s, d, "orders").select("o_orderkey", build().alias("value")), f"SELECT o_orderkey, {sql} AS value FROM orders")

    ow = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
    run("running_sum", lambda: K.running_sum(price("o_totalprice"), ("o_custkey",), order()).cast("double"), f"CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) {ow} ROWS UNBOUNDED PRECEDING) AS DOUBLE)")
    run("running_count", lambda: K.running_count(("o_custkey",), order()), f"count(*) {ow} ROWS UNBOUNDED PRECEDING)")
    run("moving_sum", lambda: K.sliding(F.sum(price("o_totalprice")), ("o_custkey",), order(), 0, 2).cast("double"), f"CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) {ow} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS DOUBLE)")
    run("prev_row", lambda: K.previous(c("o_totalprice"), ("o_custkey",), order()), f"lag(o_totalprice) {ow})")
    run("offset", lambda: L.OFFSET(c("o_totalprice"), 2, Window.partitionBy("o_custkey").orderBy("o_orderkey")), f"lead(o_totalprice, 2) {ow})")
    k.add("running_total_all", lambda s, d: K.running_total_over_all(read(s, d, "orders").select("o_orderkey", price("o_totalprice").alias("price")), "price", ["o_orderkey"]).select("o_orderkey", c("running").cast("double").alias("running")), "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders")
    k.add("first_occurrence", lambda s, d: read(s, d, "orders").select("o_orderkey", (K.running_count(("o_custkey",), order()) == 1).alias("value")), f"SELECT o_orderkey, count(*) {ow} ROWS UNBOUNDED PRECEDING) = 1 AS value FROM orders")


def register_flows(k: Catalog) -> None:
    flows = lambda s, d: read(s, d, "events").select("user_id", c("value").alias("v"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    fsql = "(SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
    k.add("npv", lambda s, d: flows(s, d).groupBy("user_id").agg(F.round(scalar_finance.NPV(0.05, c("v"), position=c("k")), 4).alias("npv")), f"SELECT user_id, round(sum(v / pow(1.05, k)), 4) AS npv FROM {fsql} GROUP BY 1")
    k.add("xnpv", lambda s, d: flows(s, d).groupBy("user_id").agg(F.round(scalar_finance.XNPV(0.05, c("v"), c("k") * 30.0, first=F.lit(30.0)), 4).alias("xnpv")), f"SELECT user_id, round(sum(v / pow(1.05, (k - 1) * 30.0 / 365)), 4) AS xnpv FROM {fsql} GROUP BY 1")
    signed = lambda s, d: flows(s, d).withColumn("v", F.when(c("k") == 1, -2 * F.abs("v") - 100).otherwise(F.abs("v") + 1))
    ssql = f"(SELECT user_id, CASE WHEN k = 1 THEN -2 * abs(v) - 100 ELSE abs(v) + 1 END AS v, k FROM {fsql})"
    k.add("mirr", lambda s, d: signed(s, d).groupBy("user_id").agg(F.round(scalar_finance.MIRR(c("v"), 0.1, 0.12, position=c("k") - 1), 6).alias("mirr")), f"SELECT user_id, round(pow(-sum(CASE WHEN v > 0 THEN v * pow(1.12, n - k) END) / sum(CASE WHEN v < 0 THEN v / pow(1.1, k - 1) END), 1.0 / NULLIF(n - 1, 0)) - 1, 6) AS mirr FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS n FROM {ssql}) GROUP BY user_id, n")

    def back(s, d, solve):
        """The solved rate put back: the net present value it leaves, which is nothing; null where none was found."""
        rows = signed(s, d)
        rates = rows.groupBy("user_id").agg(solve().alias("r"))
        counts = rows.groupBy("user_id").agg(F.count("*").alias("n"))
        joined = rows.join(rates, "user_id").join(counts, "user_id")
        return joined.groupBy("user_id", "n").agg((F.abs(F.sum(c("v") / F.pow(1 + c("r"), (c("k") - 1).cast("double") * F.lit(solve.scale)))) < 1e-4).alias("solved")).select("user_id", F.when(c("n") > 1, F.coalesce("solved", F.lit(False))).alias("solved"))

    def irr():
        return scalar_finance.IRR(c("v"), order=c("k"))

    def xirr():
        return scalar_finance.XIRR(c("v"), c("k") * 30)

    irr.scale, xirr.scale = 1.0, 30 / 365
    for name, solve in (("irr", irr), ("xirr", xirr)):
        k.add(name, lambda s, d, solve=solve: back(s, d, solve), f"SELECT user_id, CASE WHEN count(*) > 1 THEN true END AS solved FROM {fsql} GROUP BY 1")
    loans = lambda s, d: read(s, d, "customer").select("c_custkey", ((c("c_nationkey") + 1) / 1000.0).alias("rate"), (c("c_custkey") % 24 + 6).cast("int").alias("nper"), F.lit(10000.0).alias("pv"))
    k.add(
        "amortization",
        lambda s, d: amortization(loans(s, d)).select("c_custkey", "month", *[F.round(x, 4).alias(x) for x in ("begin", "payment", "interest", "principal")]),
        "WITH l AS (SELECT c_custkey, (c_nationkey + 1) / 1000.0::DOUBLE AS r, CAST(c_custkey % 24 + 6 AS INTEGER) AS n FROM customer), p AS (SELECT *, 10000 * pow(1 + r, n) * r / (pow(1 + r, n) - 1) AS p FROM l), m AS (SELECT *, CAST(unnest(range(1, n + 1)) AS INTEGER) AS month FROM p), b AS (SELECT *, 10000 * pow(1 + r, month - 1) - p * (pow(1 + r, month - 1) - 1) / r AS b FROM m) SELECT c_custkey, month, round(b, 4) AS begin, round(p, 4) AS payment, round(b * r, 4) AS interest, round(p - b * r, 4) AS principal FROM b",
    )
    k.add("recurrence_growth", lambda s, d: read(s, d, "orders").select("o_orderkey", F.round(geometric(F.lit(100.0), F.lit(1.01), ["o_custkey"], [c("o_orderkey")]), 6).alias("value")), "SELECT o_orderkey, round(100 * pow(1.01, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)), 6) AS value FROM orders")
    from quillgrid.streaming.criteria import windowed_ifs

    k.add(
        "windowed_sumifs",
        lambda s, d: windowed_ifs(read(s, d, "events").withColumn("v", price("value")), "ts", "1 day", ["event_type"], "1 day", total=F.sum(F.when(criterion(c("value"), ">10"), c("v"))), n=F.count("*")).select(c("window_start").cast("date").cast("string").alias("day"), "event_type", F.coalesce("total", F.lit(0)).cast("double").alias("total"), "n"),
        "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(coalesce(sum(CAST(value AS DECIMAL(18, 2))) FILTER (WHERE value > 10), 0) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY 1, 2",
    )
