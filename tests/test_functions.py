"""Functions on single values: results, error codes, and how errors pass through."""

import pytest
from pyspark.sql import functions as F

from quillgrid import catalog  # noqa: F401  (registers everything)
from quillgrid.functions import format_codes
from quillgrid.functions.core import REGISTRY, call, error_of
from quillgrid.functions.criteria import criterion
from quillgrid.functions.scalar_date import serial

CASES = [
    ("ROUND", (2.5, 0), 3.0), ("ROUND", (-2.5, 0), -3.0), ("ROUND", (1234.567, -2), 1200.0), ("ROUNDUP", (-1.1, 0), -2.0), ("TRUNC", (-3.99,), -3.0),
    ("INT", (-3.2,), -4.0), ("MOD", (7, -3), -2.0), ("MOD", (7, 0), "#DIV/0!"), ("POWER", (0, -1), "#DIV/0!"), ("POWER", (-8, 0.5), "#NUM!"), ("SQRT", (-1,), "#NUM!"),
    ("CEILING", (-2.5, -2), -4.0), ("CEILING", (2.5, -2), "#NUM!"), ("CEILING", (2.5, 0), 0.0), ("FLOOR", (2.5, 0), "#DIV/0!"), ("CEILING.MATH", (-5.5, 2, 1), -6.0),
    ("FLOOR.MATH", (-5.5, 2), -6.0), ("MROUND", (10, 3), 9.0), ("MROUND", (5, -2), "#NUM!"), ("EVEN", (-1,), -2.0), ("EVEN", (0,), 0.0), ("ODD", (0,), 1.0), ("ODD", (-1.5,), -3.0),
    ("QUOTIENT", (-10, 3), -3.0), ("EXP", (1000,), "#NUM!"), ("LN", (0,), "#NUM!"), ("LOG", (8, 2), 3.0), ("LOG", (8, 1), "#DIV/0!"), ("ATAN2", (0, 0), "#DIV/0!"), ("ASIN", (2,), "#NUM!"),
    ("GCD", (24, 36, 60), 12.0), ("GCD", (-4,), "#NUM!"), ("LCM", (4, 6, 10), 60.0), ("LCM", (0, 5), 0.0), ("FACT", (5.9,), 120.0), ("FACT", (171,), "#NUM!"), ("COMBIN", (8, 3), 56.0), ("COMBIN", (3, 8), "#NUM!"),
    ("LEFT", ("héllo", 2), "hé"), ("LEFT", ("x", -1), "#VALUE!"), ("RIGHT", ("abc", 5), "abc"), ("MID", ("abcdef", 3, 2), "cd"), ("MID", ("abc", 9, 2), ""), ("MID", ("abc", 0, 2), "#VALUE!"),
    ("FIND", ("B", "abB"), 3.0), ("FIND", ("z", "ab"), "#VALUE!"), ("FIND", ("", "ab", 2), 2.0), ("SEARCH", ("B", "ab"), 2.0), ("SEARCH", ("c?e", "abcde"), 3.0),
    ("SUBSTITUTE", ("a-b-c", "-", "+", 2), "a-b+c"), ("SUBSTITUTE", ("a-b", "-", "+", 5), "a-b"), ("SUBSTITUTE", ("aaa", "a", "b"), "bbb"), ("REPLACE", ("abcdef", 2, 3, "X"), "aXef"), ("REPLACE", ("ab", 9, 1, "X"), "abX"),
    ("TRIM", ("  a   b ",), "a b"), ("PROPER", ("o'brien tom-x 2nd",), "O'Brien Tom-X 2Nd"), ("REPT", ("ab", 3), "ababab"), ("REPT", ("ab", -1), "#VALUE!"), ("CHAR", (128,), "€"), ("CODE", ("€",), 128.0), ("CHAR", (0,), "#VALUE!"),
    ("UNICHAR", (8364,), "€"), ("UNICODE", ("€x",), 8364.0), ("VALUE", ("$1,234.50",), 1234.5), ("VALUE", ("5%",), 0.05), ("VALUE", ("(3)",), -3.0), ("VALUE", ("2026-03-31",), 46112.0), ("VALUE", ("abc",), "#VALUE!"),
    ("NUMBERVALUE", ("2.500,25", ",", "."), 2500.25), ("NUMBERVALUE", ("3.5%%",), 0.00035), ("TEXTBEFORE", ("a-b-c", "-", 2), "a-b"), ("TEXTBEFORE", ("a-b-c", "-", -1), "a-b"), ("TEXTAFTER", ("a-b-c", "-"), "b-c"), ("TEXTAFTER", ("abc", "-"), "#N/A"),
    ("TEXTBEFORE", ("abc", "-", 1, False, True), "abc"), ("TEXTAFTER", ("aXbxc", "x", 2, True), "c"), ("CLEAN", ("a\tb\x01",), "ab"), ("EXACT", ("a", "A"), False), ("FIXED", (-1234.567, 1), "-1,234.6"), ("FIXED", (1234.5, 0, True), "1235"), ("DOLLAR", (-1234.5,), "($1,234.50)"),
    ("ADDRESS", (2, 28), "$AB$2"), ("ADDRESS", (2, 3, 4, True, "My Tab"), "'My Tab'!C2"), ("ADDRESS", (2, 3, 1, False), "R2C3"), ("ADDRESS", (1, 703), "$AAA$1"),
    ("DATE", (2024, 14, 35), 45723.0), ("DATE", (1900, 1, 1), 1.0), ("DATE", (1900, 3, 1), 61.0), ("DATE", (10000, 1, 1), "#NUM!"), ("EDATE", (45322, 1), 45351.0), ("EOMONTH", (45322, 1), 45351.0), ("DAY", (46112,), 31.0), ("YEAR", (1,), 1900.0),
    ("DATEDIF", (45322, 46112, "m"), 26.0), ("DATEDIF", (45322, 46112, "YM"), 2.0), ("DATEDIF", (46112, 45322, "d"), "#NUM!"), ("WEEKDAY", (46112,), 3.0), ("WEEKDAY", (46112, 2), 2.0), ("WEEKNUM", (46112,), 14.0), ("ISOWEEKNUM", (44199,), 53.0),
    ("WORKDAY", (46112, 1), 46113.0), ("WORKDAY", (46115, 1), 46118.0), ("WORKDAY", (46112, 2, [46113]), 46115.0), ("WORKDAY", (46118, -1), 46115.0), ("NETWORKDAYS", (46112, 46118), 5.0), ("NETWORKDAYS", (46118, 46112), -5.0), ("NETWORKDAYS.INTL", (46112, 46118, 11), 6.0), ("WORKDAY.INTL", (46112, 5, "0000011"), 46119.0),
    ("YEARFRAC", (45292, 45658, 1), 366 / 366), ("YEARFRAC", (45292, 45474), 0.5), ("DAYS360", (45322, 45351), 29.0), ("TIME", (25, 0, 0), 1 / 24), ("HOUR", (0.75,), 18.0), ("DATEVALUE", ("2026-03-31",), 46112.0), ("TIMEVALUE", ("6:00 PM",), 0.75), ("DATEVALUE", ("x",), "#VALUE!"),
    ("PMT", (0.01, 12, 1000), -88.84878867834166), ("PMT", (0, 10, 1000), -100.0), ("FV", (0.01, 12, -100), 1268.2503013196976), ("PV", (0.01, 12, -100), 1125.5077473484646), ("NPER", (0, -100, 1000), 10.0), ("NPER", (0.1, -1, 1000), "#NUM!"), ("IPMT", (0.01, 13, 12, 1000), "#NUM!"), ("IPMT", (0.01, 1, 12, 1000), -10.0),
    ("SLN", (30000, 7500, 10), 2250.0), ("SYD", (30000, 7500, 10, 1), 4090.909090909091), ("DDB", (2400, 300, 10, 1), 480.0), ("DB", (1000000, 100000, 6, 1, 7), 186083.33333333334), ("DB", (1000000, 100000, 6, 7, 7), 15845.098473848071), ("EFFECT", (0.0525, 4), 0.05354266737075819), ("RRI", (96, 10000, 11000), 0.0009933073762913303),
    ("NORM.S.DIST", (1.333333, True), 0.908788725604095), ("NORM.S.INV", (0.908789,), 1.3333346730441071), ("NORM.INV", (1.5, 0, 1), "#NUM!"), ("STANDARDIZE", (42, 40, 1.5), 4 / 3), ("CONVERT", (1, "lbm", "kg"), 0.45359237), ("CONVERT", (68, "F", "C"), 20.0), ("CONVERT", (2.5, "ft", "sec"), "#N/A"), ("CONVERT", (1, "kibyte", "bit"), 8192.0),
]


def test_values_and_codes(spark):
    built = [(n, a, e, call(n, *a)) for n, a, e in CASES]
    for at in range(0, len(built), 24):
        part = built[at : at + 24]
        row = spark.range(1).select(*[F.struct(c.alias("value"), error_of(c).alias("error")).alias(f"c{i}") for i, (*_, c) in enumerate(part)]).first()
        for i, (name, args, expect, _) in enumerate(part):
            value, error = row[i]
            if isinstance(expect, str) and expect.startswith("#"):
                assert (value, error) == (None, expect), (name, args, value, error)
            elif isinstance(expect, float):
                assert value == pytest.approx(expect, rel=1e-6, abs=1e-12) and error is None, (name, args, value, error)
            else:
                assert (value, error) == (expect, None), (name, args, value, error)


def test_errors_pass_through_and_are_caught(spark):
    bad = call("ABS", call("SQRT", -1))
    lost = call("IFS", F.lit(False), 1.0)
    columns = [error_of(bad), call("IFERROR", bad, 7.0), call("IFNA", lost, 8.0), error_of(call("IFNA", bad, 8.0)), call("ERROR.TYPE", bad), call("ISERR", bad), call("ISNA", lost), error_of(call("IF", F.lit(True), bad, 1.0)), error_of(call("IF", F.lit(False), bad, 1.0))]
    assert tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()) == ("#NUM!", 7.0, 8.0, "#NUM!", 6.0, True, True, "#NUM!", None)


def test_criteria(spark):
    df = spark.createDataFrame([(1.0, "Apple"), (10.0, "pear"), (None, None), (25.0, "a*b"), (10.0, "")], "n double, t string")
    count = lambda c: df.where(c).count()
    n, t = F.col("n"), F.col("t")
    assert [count(criterion(n, w)) for w in (">1", "10", 10, "<>10", "", "<>", ">=10", "x", "<>x")] == [3, 2, 2, 3, 1, 4, 3, 0, 5]
    assert [count(criterion(t, w, numeric=False)) for w in ("apple", "a*", "?ear", "a~*b", "<>apple", "=", "", ">b", 5)] == [1, 2, 1, 1, 4, 1, 2, 1, 0]
    assert count(criterion(t, "app", numeric=False, begins=True)) == 1


@pytest.mark.parametrize(
    "x, code, expect",
    [
        (1234.567, "#,##0.00", "1,234.57"), (-1234.5, "#,##0;(#,##0)", "(1,235)"), (0, '0;-0;"zero"', "zero"), (0.256, "0.0%", "25.6%"), (1234567, "0.00E+00", "1.23E+06"), (0.5, "# ?/?", " 1/2"), (1.25, "# ?/?", "1 1/4"),
        (46112, "yyyy-mm-dd", "2026-03-31"), (46112.75, "d mmm yy h:mm AM/PM", "31 Mar 26 6:00 PM"), (46112.5, "dddd", "Tuesday"), (1.5, "[h]:mm", "36:00"), (60, "yyyy-mm-dd", "1900-02-29"), (5, "000", "005"), (1500000, "0.0,,", "1.5"), (3, '0 "items"', "3 items"),
        (-0.001, "0.00", "0.00"), (1, "a;b;c;d;e", None), (12.3, "General", "12.3"), (1e20, "General", "1E+20"), (0.1 + 0.2, "General", "0.3"),
    ],
)
def test_format_codes(x, code, expect):
    assert format_codes.render(float(x), code) == expect


def test_serials(spark):
    row = spark.sql("SELECT DATE '1900-01-01' a, DATE '1900-02-28' b, DATE '1900-03-01' c, DATE '2026-03-31' d").select(*[serial(F.col(x)) for x in "abcd"]).first()
    assert tuple(row) == (1.0, 59.0, 61.0, 46112.0)


def test_registry_checks_arguments():
    assert len(REGISTRY) == 253
    with pytest.raises(TypeError):
        call("MOD", 1)
    with pytest.raises(KeyError):
        call("NOSUCH", 1)


def test_fixed_of_negative_numbers_that_round_to_zero(spark, tmp_path):
    import duckdb

    rows = [(i, float(v)) for i, v in enumerate([-0.06, -0.05, -0.04, -0.01, 0.0, 0.01, 0.04, 0.05, -999.96, 9999.95])]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["value"] for r in catalog.QUERIES["fixed"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert got == dict(con.execute(catalog.ORACLE_SQL["fixed"]).fetchall())
    assert got[2] == "-0.0" and spark.range(1).select(call("FIXED", -0.04, 1)).first()[0] == "0.0"
