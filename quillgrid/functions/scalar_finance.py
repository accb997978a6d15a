"""Annuities, depreciation and rate conversions as Column expressions; solvers as Arrow-batched Newton steps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillgrid.functions.core import aggregated, finite, function, guarded, num, trunc, with_error


def _growth(rate, periods) -> Column:
    return F.pow(1 + num(rate), num(periods))


def _due(rate, kind) -> Column:
    return 1 + num(rate) * F.when(num(kind) != 0, 1.0).otherwise(0.0)


def _pmt(rate, nper, pv, fv, kind) -> Column:
    r, g = num(rate), _growth(rate, nper)
    return F.when(r == 0, -F.try_divide(num(pv) + num(fv), num(nper))).otherwise(-F.try_divide((num(pv) * g + num(fv)) * r, _due(rate, kind) * (g - 1)))


def _fv(rate, nper, pmt, pv, kind) -> Column:
    r, g = num(rate), _growth(rate, nper)
    return F.when(r == 0, -(num(pv) + num(pmt) * num(nper))).otherwise(-(num(pv) * g + num(pmt) * _due(rate, kind) * F.try_divide(g - 1, r)))


def _ipmt(rate, per, nper, pv, fv, kind) -> Column:
    before = _fv(rate, num(per) - 1, _pmt(rate, nper, pv, fv, kind), pv, kind) * num(rate)
    due = num(kind) != 0
    return F.when(due & (num(per) == 1), F.lit(0.0)).when(due, F.try_divide(before, 1 + num(rate))).otherwise(before)


@function("PMT", 3, 5)
def PMT(rate, nper, pv, fv=0, kind=0):
    return finite(_pmt(rate, nper, pv, fv, kind), (num(nper) == 0, "#DIV/0!"), args=(rate, nper, pv, fv))


@function("FV", 3, 5)
def FV(rate, nper, pmt, pv=0, kind=0):
    return finite(_fv(rate, nper, pmt, pv, kind), args=(rate, nper, pmt, pv))


@function("PV", 3, 5)
def PV(rate, nper, pmt, fv=0, kind=0):
    r, g = num(rate), _growth(rate, nper)
    value = F.when(r == 0, -(num(fv) + num(pmt) * num(nper))).otherwise(-F.try_divide(num(fv) + num(pmt) * _due(rate, kind) * F.try_divide(g - 1, r), g))
    return finite(value, (g == 0, "#DIV/0!"), args=(rate, nper, pmt, fv))


@function("NPER", 3, 5)
def NPER(rate, pmt, pv, fv=0, kind=0):
    r = num(rate)
    p = num(pmt) * _due(rate, kind)
    ratio = F.try_divide(p - num(fv) * r, p + num(pv) * r)
    value = F.when(r == 0, -F.try_divide(num(pv) + num(fv), num(pmt))).otherwise(F.try_divide(F.ln(ratio), F.ln(1 + r)))
    return finite(value, ((r == 0) & (num(pmt) == 0), "#DIV/0!"), ((r != 0) & ((ratio <= 0) | ratio.isNull() | (r <= -1)), "#NUM!"), args=(rate, pmt, pv, fv))


@function("IPMT", 4, 6)
def IPMT(rate, per, nper, pv, fv=0, kind=0):
    return finite(_ipmt(rate, per, nper, pv, fv, kind), ((num(per) < 1) | (num(per) > num(nper)), "#NUM!"), args=(rate, per, nper, pv, fv))


def _ppmt(rate, per, nper, pv, fv, kind) -> Column:
    return _pmt(rate, nper, pv, fv, kind) - _ipmt(rate, per, nper, pv, fv, kind)


@function("PPMT", 4, 6)
def PPMT(rate, per, nper, pv, fv=0, kind=0):
    return finite(_ppmt(rate, per, nper, pv, fv, kind), ((num(per) < 1) | (num(per) > num(nper)), "#NUM!"), args=(rate, per, nper, pv, fv))


def _cumulated(part, rate, nper, pv, start, end, kind) -> Column:
    lo, hi = trunc(num(start)).cast("int"), trunc(num(end)).cast("int")
    periods = F.sequence(F.greatest(lo, F.lit(1)), F.greatest(hi, lo, F.lit(1)))
    value = F.aggregate(periods, F.lit(0.0), lambda a, k: a + part(rate, k, nper, pv, 0, kind))
    bad = (num(rate) <= 0) | (num(nper) <= 0) | (num(pv) <= 0) | (lo < 1) | (hi < lo) | (hi > num(nper))
    return finite(value, (bad, "#NUM!"), args=(rate, nper, pv, start, end))


@function("CUMIPMT", 6)
def CUMIPMT(rate, nper, pv, start, end, kind):
    return _cumulated(_ipmt, rate, nper, pv, start, end, kind)


@function("CUMPRINC", 6)
def CUMPRINC(rate, nper, pv, start, end, kind):
    return _cumulated(_ppmt, rate, nper, pv, start, end, kind)


@function("SLN", 3)
def SLN(cost, salvage, life):
    return finite(F.try_divide(num(cost) - num(salvage), num(life)), (num(life) == 0, "#DIV/0!"), args=(cost, salvage, life))


@function("SYD", 4)
def SYD(cost, salvage, life, per):
    n, k = num(life), num(per)
    return finite(F.try_divide((num(cost) - num(salvage)) * (n - k + 1) * 2, n * (n + 1)), ((n <= 0) | (k < 1) | (k > n), "#NUM!"), args=(cost, salvage, life, per))


@function("DB", 4, 5)
def DB(cost, salvage, life, period, month=12):
    c, n, k, m = num(cost), num(life), trunc(num(period)), num(month)
    raw = 1 - F.pow(F.try_divide(num(salvage), c), F.try_divide(F.lit(1.0), n))
    rate = F.floor(raw * 1000 + 0.5) / 1000
    first = c * rate * m / 12
    #: the value left before the period; the years between take the rate in full
    left = (c - first) * F.pow(1 - rate, F.greatest(k - 2, F.lit(0.0)))
    value = F.when(c == 0, F.lit(0.0)).when(k == 1, first).when(k > n, left * rate * (12 - m) / 12).otherwise(left * rate)
    bad = (c < 0) | (num(salvage) < 0) | (n <= 0) | (k < 1) | (m < 1) | (m > 12) | (k > n + F.when(m < 12, 1).otherwise(0))
    return finite(value, (bad, "#NUM!"), args=(cost, salvage, life, period))


@function("DDB", 4, 5)
def DDB(cost, salvage, life, period, factor=2):
    c, s, n, k = num(cost), num(salvage), num(life), num(period)
    rate = F.least(F.try_divide(num(factor), n), F.lit(1.0))
    before = c * F.pow(1 - rate, k - 1)
    value = F.greatest(F.least(before * rate, before - s), F.lit(0.0))
    return finite(value, ((c < 0) | (s < 0) | (n <= 0) | (k < 1) | (k > n) | (num(factor) <= 0), "#NUM!"), args=(cost, salvage, life, period))


@function("EFFECT", 2)
def EFFECT(nominal, periods):
    n = trunc(num(periods))
    return finite(F.pow(1 + F.try_divide(num(nominal), n), n) - 1, ((num(nominal) <= 0) | (n < 1), "#NUM!"), args=(nominal, periods))


@function("NOMINAL", 2)
def NOMINAL(effective, periods):
    n = trunc(num(periods))
    return finite(n * (F.pow(1 + num(effective), F.try_divide(F.lit(1.0), n)) - 1), ((num(effective) <= 0) | (n < 1), "#NUM!"), args=(effective, periods))


@function("PDURATION", 3)
def PDURATION(rate, pv, fv):
    return finite(F.try_divide(F.ln(num(fv)) - F.ln(num(pv)), F.ln(1 + num(rate))), ((num(rate) <= 0) | (num(pv) <= 0) | (num(fv) <= 0), "#NUM!"), args=(rate, pv, fv))


@function("RRI", 3)
def RRI(nper, pv, fv):
    return finite(F.pow(F.try_divide(num(fv), num(pv)), F.try_divide(F.lit(1.0), num(nper))) - 1, ((num(nper) <= 0) | (num(pv) == 0), "#NUM!"), args=(nper, pv, fv))


# --- solvers ---------------------------------------------------------------------------------------------------------
@F.pandas_udf(DoubleType())
def _rate(nper: pd.Series, pmt: pd.Series, pv: pd.Series, fv: pd.Series, due: pd.Series, guess: pd.Series) -> pd.Series:
    """All rows of a batch take Newton steps together; a row that does not settle is null."""
    n, p, v, f, t = (x.to_numpy(float) for x in (nper, pmt, pv, fv, due))
    r = guess.to_numpy(float).copy()

    def residual(r):
        with np.errstate(all="ignore"):
            g = (1 + r) ** n
            return np.where(np.abs(r) < 1e-12, v + p * n + f, v * g + p * (1 + r * t) * (g - 1) / np.where(r == 0, 1, r) + f)

    for _ in range(100):
        h = 1e-6 * np.maximum(np.abs(r), 1e-3)
        with np.errstate(all="ignore"):
            slope = (residual(r + h) - residual(r - h)) / (2 * h)
            step = residual(r) / slope
        r = np.where(np.isfinite(step) & (np.abs(step) > 1e-14), np.maximum(r - step, -0.999999), r)
    scale = np.abs(v) + np.abs(p) * np.abs(n) + np.abs(f)
    with np.errstate(all="ignore"):
        ok = np.isfinite(r) & (np.abs(residual(r)) <= 1e-6 * np.maximum(scale, 1e-300))
    return pd.Series(np.where(ok, r, np.nan)).where(lambda s: s.notna(), None)


@function("RATE", 3, 6)
def RATE(nper, pmt, pv, fv=0, kind=0, guess=0.1):
    value = _rate(num(nper), num(pmt), num(pv), num(fv), F.when(num(kind) != 0, 1.0).otherwise(0.0), num(guess))
    return guarded(value, (value.isNull(), "#NUM!"), args=(nper, pmt, pv, fv))


def solve_rate(flows: np.ndarray, times: np.ndarray, guess: float = 0.1) -> float | None:
    """Root of the net present value: Newton from the guess, then bisection from -99.9 % upwards."""
    if not (flows > 0).any() or not (flows < 0).any():
        return None

    def value(r: float) -> float:
        return float((flows / (1 + r) ** times).sum())

    def slope(r: float) -> float:
        return float((-times * flows / (1 + r) ** (times + 1)).sum())

    tolerance = 1e-9 * float(np.abs(flows).sum())
    r = guess
    with np.errstate(all="ignore"):
        for _ in range(50):
            v, d = value(r), slope(r)
            if not np.isfinite(v) or d == 0:
                break
            step = v / d
            r = max(r - step, -0.999)
            if abs(step) < 1e-13 * max(1.0, abs(r)):
                break
        if np.isfinite(r) and abs(value(r)) <= tolerance:
            return r
        lo, hi = -0.999, 1.0
        while value(lo) * value(hi) > 0 and hi < 1e6:
            hi *= 2
        if value(lo) * value(hi) > 0:
            return None
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if value(lo) * value(mid) > 0 else (lo, mid)
        return (lo + hi) / 2


def _by_order(values: pd.Series, order: pd.Series) -> np.ndarray:
    keep = values.notna().to_numpy()
    return values.to_numpy(float)[keep][np.argsort(order.to_numpy()[keep], kind="stable")]


@F.pandas_udf(DoubleType())
def _irr(values: pd.Series, order: pd.Series, guess: pd.Series) -> float:
    flows = _by_order(values, order)
    return solve_rate(flows, np.arange(len(flows), dtype=float), float(guess.iloc[0]) if len(guess) else 0.1)


@function("IRR", 1, 2, kind="aggregate")
def IRR(values, guess=0.1, *, order):
    """Aggregate of one cash flow a row, taken in ``order``; a group must fit in a task."""
    rate = _irr(num(values), order, num(guess))
    return with_error(rate, F.when(rate.isNull(), "#NUM!"))


@F.pandas_udf(DoubleType())
def _xirr(values: pd.Series, days: pd.Series, guess: pd.Series) -> float:
    keep = (values.notna() & days.notna()).to_numpy()
    v, d = values.to_numpy(float)[keep], days.to_numpy(float)[keep]
    return solve_rate(v, (d - d.min()) / 365, float(guess.iloc[0])) if len(v) else None


@function("XIRR", 2, 3, kind="aggregate")
def XIRR(values, dates, guess=0.1):
    """``dates`` are serials; the earliest is where discounting begins."""
    rate = _xirr(num(values), num(dates), num(guess))
    return with_error(rate, F.when(rate.isNull(), "#NUM!"))


@function("NPV", 2, None, kind="aggregate")
def NPV(rate, values, *, position):
    """Aggregate: ``position`` is the period of a row, from 1."""
    return F.coalesce(F.sum(num(values) / F.pow(1 + num(rate), num(position))), F.lit(0.0))


@function("XNPV", 3, kind="aggregate")
def XNPV(rate, values, dates, *, first):
    """Aggregate: ``first`` is the first date's serial."""
    return F.sum(num(values) / F.pow(1 + num(rate), (num(dates) - num(first)) / 365))


@function("MIRR", 3, kind="aggregate")
def MIRR(values, finance_rate, reinvest_rate, *, position):
    """Aggregate over periods 0, 1, ...; null without a gain and a loss."""
    v, k = num(values), num(position)
    n = F.max(k)
    gains = F.sum(F.when(v > 0, v / F.pow(1 + num(reinvest_rate), k)))
    losses = F.sum(F.when(v < 0, v / F.pow(1 + num(finance_rate), k)))
    r = F.first(num(reinvest_rate))
    value = F.pow(F.try_divide(-gains * F.pow(1 + r, n), losses), F.try_divide(F.lit(1.0), n)) - 1
    return aggregated(value, values, fails=((gains.isNull() | losses.isNull(), "#DIV/0!"),))
