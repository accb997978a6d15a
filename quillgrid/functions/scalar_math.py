"""Arithmetic, rounding, logarithms, trigonometry, combinatorics, random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import finite, function, guarded, num, trunc


# --- operators -------------------------------------------------------------------------------------------------------
def add(a, b) -> Column:
    return finite(num(a) + num(b), args=(a, b))


def subtract(a, b) -> Column:
    return finite(num(a) - num(b), args=(a, b))


def multiply(a, b) -> Column:
    return finite(num(a) * num(b), args=(a, b))


def divide(a, b) -> Column:
    return finite(F.try_divide(num(a), num(b)), (num(b) == 0, "#DIV/0!"), args=(a, b))


def percent(a) -> Column:
    return finite(num(a) / 100, args=(a,))


def negate(a) -> Column:
    return finite(-num(a), args=(a,))


# --- arithmetic and rounding -----------------------------------------------------------------------------------------
@function("ABS", 1)
def ABS(x):
    return finite(F.abs(num(x)), args=(x,))


def _scale(digits) -> Column:
    return F.pow(F.lit(10.0), F.greatest(F.least(trunc(num(digits)), F.lit(308.0)), F.lit(-308.0)))


def _half_away(x: Column) -> Column:
    """Nearest integer in binary arithmetic, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def _at_digits(x, digits, step) -> Column:
    p = _scale(digits)
    return finite(F.when(F.abs(num(x) * p) == float("inf"), num(x)).otherwise(step(num(x) * p) / p), args=(x, digits))


@function("ROUND", 2)
def ROUND(x, digits=0):
    return _at_digits(x, digits, _half_away)


@function("ROUNDUP", 2)
def ROUNDUP(x, digits=0):
    return _at_digits(x, digits, lambda v: F.signum(v) * F.ceil(F.abs(v)))


@function("ROUNDDOWN", 2)
def ROUNDDOWN(x, digits=0):
    return _at_digits(x, digits, trunc)


@function("TRUNC", 1, 2)
def TRUNC(x, digits=0):
    return _at_digits(x, digits, trunc)


@function("INT", 1)
def INT(x):
    return finite(F.floor(num(x)).cast("double"), args=(x,))


@function("MOD", 2)
def MOD(n, d):
    n_, d_ = num(n), num(d)
    return finite(n_ - d_ * F.floor(F.try_divide(n_, d_)), (d_ == 0, "#DIV/0!"), args=(n, d))


@function("POWER", 2)
def POWER(x, y):
    x_, y_ = num(x), num(y)
    return finite(F.pow(x_, y_), ((x_ == 0) & (y_ < 0), "#DIV/0!"), args=(x, y))


@function("SQRT", 1)
def SQRT(x):
    return finite(F.sqrt(num(x)), (num(x) < 0, "#NUM!"), args=(x,))


@function("CEILING", 2)
def CEILING(x, significance):
    x_, s = num(x), num(significance)
    return finite(F.when((s == 0) | (x_ == 0), F.lit(0.0)).otherwise(s * F.ceil(F.try_divide(x_, s))), ((x_ > 0) & (s < 0), "#NUM!"), args=(x, significance))


@function("FLOOR", 2)
def FLOOR(x, significance):
    x_, s = num(x), num(significance)
    return finite(F.when(x_ == 0, F.lit(0.0)).otherwise(s * F.floor(F.try_divide(x_, s))), (s == 0, "#DIV/0!"), ((x_ > 0) & (s < 0), "#NUM!"), args=(x, significance))


def _math(x, significance, mode, away: str):
    x_, s, m = num(x), F.abs(num(significance)), num(mode)
    up, down = s * F.ceil(F.try_divide(x_, s)), s * F.floor(F.try_divide(x_, s))
    flipped = (x_ < 0) & (m != 0)
    first, second = (up, down) if away == "up" else (down, up)
    return finite(F.when(s == 0, F.lit(0.0)).when(flipped, second).otherwise(first), args=(x, significance, mode))


@function("CEILING.MATH", 1, 3)
def CEILING_MATH(x, significance=1, mode=0):
    return _math(x, significance, mode, "up")


@function("FLOOR.MATH", 1, 3)
def FLOOR_MATH(x, significance=1, mode=0):
    return _math(x, significance, mode, "down")


@function("SIGN", 1)
def SIGN(x):
    return finite(F.signum(num(x)), args=(x,))


@function("MROUND", 2)
def MROUND(x, multiple):
    x_, m = num(x), num(multiple)
    return finite(F.when((m == 0) | (x_ == 0), F.lit(0.0)).otherwise(m * _half_away(F.try_divide(x_, m))), (x_ * m < 0, "#NUM!"), args=(x, multiple))


@function("EVEN", 1)
def EVEN(x):
    x_ = num(x)
    return finite(F.signum(x_) * 2 * F.ceil(F.abs(x_) / 2), args=(x,))


@function("ODD", 1)
def ODD(x):
    x_ = num(x)
    sign = F.when(x_ < 0, -1.0).otherwise(1.0)
    return finite(sign * (2 * F.ceil((F.greatest(F.abs(x_), F.lit(1.0)) - 1) / 2) + 1), args=(x,))


@function("QUOTIENT", 2)
def QUOTIENT(a, b):
    return finite(trunc(F.try_divide(num(a), num(b))), (num(b) == 0, "#DIV/0!"), args=(a, b))


# --- exponentials, logarithms, trigonometry --------------------------------------------------------------------------
@function("PI", 0)
def PI():
    return F.pi()


@function("EXP", 1)
def EXP(x):
    return finite(F.exp(num(x)), args=(x,))


@function("LN", 1)
def LN(x):
    return finite(F.ln(num(x)), (num(x) <= 0, "#NUM!"), args=(x,))


@function("LOG10", 1)
def LOG10(x):
    return finite(F.log10(num(x)), (num(x) <= 0, "#NUM!"), args=(x,))


@function("LOG", 1, 2)
def LOG(x, base=10):
    x_, b = num(x), num(base)
    value = F.when(b == 10, F.log10(x_)).when(b == 2, F.log2(x_)).otherwise(F.try_divide(F.ln(x_), F.ln(b)))
    return finite(value, ((x_ <= 0) | (b <= 0), "#NUM!"), (b == 1, "#DIV/0!"), args=(x, base))


def _one(name: str, f, domain=None):
    def build(x):
        return finite(f(num(x)), *([(domain(num(x)), "#NUM!")] if domain else []), args=(x,))

    build.__name__ = name
    function(name, 1)(build)
    return build


SIN, COS, TAN = _one("SIN", F.sin), _one("COS", F.cos), _one("TAN", F.tan)
ASIN, ACOS = _one("ASIN", F.asin, lambda x: F.abs(x) > 1), _one("ACOS", F.acos, lambda x: F.abs(x) > 1)
ATAN, SINH, COSH, TANH = _one("ATAN", F.atan), _one("SINH", F.sinh), _one("COSH", F.cosh), _one("TANH", F.tanh)
RADIANS, DEGREES = _one("RADIANS", F.radians), _one("DEGREES", F.degrees)


@function("ATAN2", 2)
def ATAN2(x, y):
    """The x coordinate comes first."""
    return finite(F.atan2(num(y), num(x)), ((num(x) == 0) & (num(y) == 0), "#DIV/0!"), args=(x, y))


# --- combinatorics ---------------------------------------------------------------------------------------------------
def _euclid(a: Column, b: Column) -> Column:
    """Greatest common divisor of two longs: Euclid's steps as a fold; 2**53 needs fewer than 80."""
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0)).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).cast("long").alias("b"))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda s: s["a"])


def _whole(values) -> list[Column]:
    return [trunc(num(v)) for v in values]


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


@function("GCD", 1, None)
def GCD(*values):
    whole = _whole(values)
    out = whole[0].cast("long")
    for v in whole[1:]:
        out = _euclid(out, v.cast("long"))
    return guarded(out.cast("double"), (_any([(v < 0) | (v >= 2.0**53) for v in whole]), "#NUM!"), args=values)


@function("LCM", 1, None)
def LCM(*values):
    whole = _whole(values)
    out = whole[0]
    for v in whole[1:]:
        g = _euclid(out.cast("long"), v.cast("long")).cast("double")
        out = F.when((out == 0) | (v == 0), F.lit(0.0)).otherwise(F.try_divide(out, g) * v)
    return guarded(out, (_any([(v < 0) | (v >= 2.0**53) for v in whole]) | (out >= 2.0**53), "#NUM!"), args=values)


@function("FACT", 1)
def FACT(n):
    k = trunc(num(n))
    last = F.greatest(F.least(k, F.lit(170.0)), F.lit(1.0)).cast("int")
    value = F.aggregate(F.sequence(F.lit(1), last), F.lit(1.0), lambda a, i: a * i)
    return guarded(value, ((k < 0) | (k > 170), "#NUM!"), args=(n,))


@function("COMBIN", 2)
def COMBIN(n, k):
    n_, k_ = trunc(num(n)), trunc(num(k))
    m = F.least(k_, n_ - k_)
    steps = F.sequence(F.lit(1), F.greatest(F.least(m, F.lit(100000.0)), F.lit(1.0)).cast("int"))
    value = F.when(m <= 0, F.lit(1.0)).otherwise(F.aggregate(steps, F.lit(1.0), lambda a, i: F.round(a * (n_ - m + i) / i, 0)))
    big = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n_ - m + i) / i)
    return finite(F.when(big < 2.0**52, value).otherwise(big), ((n_ < 0) | (k_ < 0) | (k_ > n_), "#NUM!"), args=(n, k))


# --- random ----------------------------------------------------------------------------------------------------------
@function("RAND", 0)
def RAND(seed: int | None = None):
    return F.rand(seed)


@function("RANDBETWEEN", 2)
def RANDBETWEEN(low, high, seed: int | None = None):
    lo, hi = F.ceil(num(low)).cast("double"), F.floor(num(high)).cast("double")
    return guarded(lo + F.floor(F.rand(seed) * (hi - lo + 1)), (lo > hi, "#NUM!"), args=(low, high))


