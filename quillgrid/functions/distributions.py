"""The normal distribution.  Spark has no error function, so the cumulative function and its inverse run on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillgrid.functions.core import alias, finite, function, num

#: Coefficients of West's (2005) rational approximation of the normal tail (fixed values).
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Coefficients of Acklam's approximation of the inverse (fixed values).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly_of(coefficients, x: np.ndarray) -> np.ndarray:
    return np.polyval(np.array(coefficients), x)


def _lower(z: np.ndarray) -> np.ndarray:
    """Cumulative probability below z."""
    a = np.abs(z)
    far = 1 / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = np.where(a > 37, 0, np.exp(-a * a / 2) * np.where(a < 7.07106781186547, _poly_of(_TOP, a) / _poly_of(_BOTTOM, a), far))
    return np.where(z > 0, 1 - tail, tail)


@F.pandas_udf(DoubleType())
def _cumulative(z: pd.Series) -> pd.Series:
    return pd.Series(_lower(z.to_numpy(float)))


def standard_cdf(z: Column) -> Column:
    """On Arrow batches: as a Column the rational expression would repeat its argument some twenty times."""
    return _cumulative(z)


def standard_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


@F.pandas_udf(DoubleType())
def _inverse(p: pd.Series) -> pd.Series:
    """Acklam's approximation and one Halley step, on Arrow batches: as a Column it would repeat itself hundreds of times."""
    v = p.to_numpy(float)
    with np.errstate(all="ignore"):
        q = np.sqrt(-2 * np.log(np.minimum(v, 1 - v)))
        tail = _poly_of(_C, q) / _poly_of(_D, q)
        r = (v - 0.5) ** 2
        x = np.where(v < 0.02425, tail, np.where(v > 1 - 0.02425, -tail, _poly_of(_A, r) * (v - 0.5) / _poly_of(_B, r)))
        u = (_lower(x) - v) * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
        return pd.Series(x - u / (1 + x * u / 2))


def standard_inverse(p: Column) -> Column:
    return _inverse(p)


@function("STANDARDIZE", 3)
def STANDARDIZE(x, mean, sd):
    return finite(F.try_divide(num(x) - num(mean), num(sd)), (num(sd) <= 0, "#NUM!"), args=(x, mean, sd))


@function("NORM.DIST", 4)
def NORM_DIST(x, mean, sd, cumulative):
    z = F.try_divide(num(x) - num(mean), num(sd))
    value = F.when(F.lit(cumulative) if isinstance(cumulative, bool) else cumulative, standard_cdf(z)).otherwise(F.try_divide(standard_pdf(z), num(sd)))
    return finite(value, (num(sd) <= 0, "#NUM!"), args=(x, mean, sd))


@function("NORM.S.DIST", 2)
def NORM_S_DIST(z, cumulative):
    return NORM_DIST(z, 0.0, 1.0, cumulative)


@function("NORMSDIST", 1)
def NORMSDIST(z):
    return NORM_DIST(z, 0.0, 1.0, True)


@function("NORM.INV", 3)
def NORM_INV(p, mean, sd):
    inside = F.when((num(p) > 0) & (num(p) < 1), num(p))
    return finite(num(mean) + num(sd) * standard_inverse(inside), (inside.isNull() | (num(sd) <= 0), "#NUM!"), args=(p, mean, sd))


@function("NORM.S.INV", 1)
def NORM_S_INV(p):
    return NORM_INV(p, 0.0, 1.0)


alias("NORMDIST", "NORM.DIST")
alias("NORMINV", "NORM.INV")
alias("NORMSINV", "NORM.S.INV")
