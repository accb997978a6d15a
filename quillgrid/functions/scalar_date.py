"""Dates and times as day serials of the 1900 system, whose day 60 is a 29 February that never was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import function, guarded, num, text, trunc

FIRST_SERIAL, LAST_SERIAL = 1, 2_958_465
_EPOCH = "DATE '1899-12-30'"


def serial(d: Column) -> Column:
    """Serial of a Spark date or timestamp (days, with the fraction of a timestamp's day left out)."""
    days = F.datediff(d.cast("date"), F.expr(_EPOCH))
    return (days - F.when(days < 61, 1).otherwise(0)).cast("double")


def to_date(s) -> Column:
    """Spark date of a serial's whole part; serial 60 reads as 1 March."""
    k = F.floor(num(s)).cast("int")
    return F.date_add(F.expr(_EPOCH), k + F.when(k < 60, 1).otherwise(0).cast("int"))


def _out_of_band(s: Column) -> Column:
    return (F.floor(s) < 0) | (F.floor(s) > LAST_SERIAL)


def _part(name: str, f):
    def build(s):
        return guarded(f(to_date(F.when(~_out_of_band(num(s)), num(s)))).cast("double"), (_out_of_band(num(s)), "#NUM!"), args=(s,))

    function(name, 1)(build)
    return build


YEAR, MONTH, DAY = _part("YEAR", F.year), _part("MONTH", F.month), _part("DAY", F.dayofmonth)
ISOWEEKNUM = _part("ISOWEEKNUM", F.weekofyear)


def _date(y: Column, m: Column, d: Column) -> Column:
    """Serial of year, month and day, months and days running over; parts are doubles."""
    months = (y - 1900) * 12 + m - 1
    safe = F.when((months >= -1) & (months < 97200), months).otherwise(F.lit(0.0)).cast("int")
    first = F.add_months(F.expr("DATE '1900-01-01'"), safe)
    return serial(first) + d - 1


@function("DATE", 3)
def DATE(year, month, day):
    y, m, d = trunc(num(year)), trunc(num(month)), trunc(num(day))
    y = F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y)
    value = _date(y, m, d)
    months = (y - 1900) * 12 + m - 1
    return guarded(value, ((y < 0) | (y > 9999) | (months < 0) | (months >= 97200) | (value < 0) | (value > LAST_SERIAL), "#NUM!"), args=(year, month, day))


def _moved(start, months) -> tuple[Column, Column]:
    d = to_date(F.when(~_out_of_band(num(start)), num(start)))
    m = F.least(F.greatest(trunc(num(months)), F.lit(-97200.0)), F.lit(97200.0)).cast("int")
    return F.add_months(d, m), d


@function("EDATE", 2)
def EDATE(start, months):
    value = serial(_moved(start, months)[0])
    return guarded(value, (_out_of_band(num(start)) | (value < FIRST_SERIAL) | (value > LAST_SERIAL), "#NUM!"), args=(start, months))


@function("EOMONTH", 2)
def EOMONTH(start, months):
    value = serial(F.last_day(_moved(start, months)[0]))
    return guarded(value, (_out_of_band(num(start)) | (value < FIRST_SERIAL) | (value > LAST_SERIAL), "#NUM!"), args=(start, months))


@function("DAYS", 2)
def DAYS(end, start):
    return guarded(F.floor(num(end)) - F.floor(num(start)).cast("double"), args=(end, start))


@function("DATEDIF", 3)
def DATEDIF(start, end, unit: str):
    a, b = to_date(start), to_date(end)
    y, m, d = (f(b) - f(a) for f in (F.year, F.month, F.dayofmonth))
    months = y * 12 + m - F.when(d < 0, 1).otherwise(0)
    kind = unit.upper()
    if kind == "D":
        value = F.floor(num(end)) - F.floor(num(start))
    elif kind == "M":
        value = months
    elif kind == "Y":
        value = F.floor(months / 12)
    elif kind == "YM":
        value = F.pmod(months, F.lit(12))
    elif kind == "MD":
        before = F.dayofmonth(F.last_day(F.add_months(b, -1)))
        value = F.when(d >= 0, d).otherwise(before + d)
    elif kind == "YD":
        late = (F.month(b) < F.month(a)) | ((F.month(b) == F.month(a)) & (F.dayofmonth(b) < F.dayofmonth(a)))
        turn = F.add_months(a, (y - F.when(late, 1).otherwise(0)).cast("int") * 12)
        value = F.datediff(b, turn)
    else:
        return guarded(F.lit(None).cast("double"), (F.lit(True), "#NUM!"))
    return guarded(value.cast("double"), (num(start) > num(end), "#NUM!"), args=(start, end))


def today(pinned: str | None = None) -> Column:
    return serial(F.lit(pinned).cast("date") if pinned else F.current_date())


@function("TODAY", 0, 1)
def TODAY(pinned: str | None = None):
    return today(pinned)


@function("NOW", 0, 1)
def NOW(pinned: str | None = None):
    t = F.lit(pinned).cast("timestamp_ntz") if pinned else F.current_timestamp().cast("timestamp_ntz")
    return serial(t) + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400


@function("WEEKDAY", 1, 2)
def WEEKDAY(s, kind: int = 1):
    """1: Sunday is 1; 2 and 11: Monday is 1; 3: Monday is 0; 12 to 17: Tuesday to Sunday is 1."""
    k = F.floor(num(s))
    sunday_based = F.pmod(k - 1, F.lit(7))
    start = {1: 0, 17: 0, 2: 1, 3: 1, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5, 16: 6}.get(kind)
    if start is None:
        return guarded(F.lit(None).cast("double"), (F.lit(True), "#NUM!"))
    value = F.pmod(sunday_based - start, F.lit(7)) + (0 if kind == 3 else 1)
    return guarded(value.cast("double"), (_out_of_band(num(s)), "#NUM!"), args=(s,))


@function("WEEKNUM", 1, 2)
def WEEKNUM(s, kind: int = 1):
    if kind == 21:
        return ISOWEEKNUM(s)
    start = {1: 0, 17: 0, 2: 1, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5, 16: 6}.get(kind)
    if start is None:
        return guarded(F.lit(None).cast("double"), (F.lit(True), "#NUM!"))
    k = F.floor(num(s))
    d = to_date(F.when(~_out_of_band(num(s)), num(s)))
    first = serial(F.trunc(d, "year"))
    lead = F.pmod(first - 1 - start, F.lit(7))
    return guarded(F.floor((k - first + lead) / 7).cast("double") + 1, (_out_of_band(num(s)), "#NUM!"), args=(s,))


# --- working days ----------------------------------------------------------------------------------------------------
#: Days off of each weekend code, Monday is 0 (fixed values).
WEEKENDS = {1: (5, 6), 2: (6, 0), 3: (0, 1), 4: (1, 2), 5: (2, 3), 6: (3, 4), 7: (4, 5), 11: (6,), 12: (0,), 13: (1,), 14: (2,), 15: (3,), 16: (4,), 17: (5,)}


def _off_days(weekend) -> tuple[int, ...]:
    if isinstance(weekend, str):
        if len(weekend) != 7 or set(weekend) - {"0", "1"}:
            raise ValueError("#VALUE!")
        return tuple(i for i, c in enumerate(weekend) if c == "1")
    if weekend not in WEEKENDS:
        raise ValueError("#NUM!")
    return WEEKENDS[weekend]


def _monday_based(k: Column) -> Column:
    return F.pmod(k - 2, F.lit(7)).cast("int")


def _work_days_before(k: Column, off: tuple[int, ...]) -> Column:
    """Working days among serials 2 .. k (serial 2 is a Monday), holidays aside; closed form."""
    weeks, rest = F.floor((k - 1) / 7), F.pmod(k - 1, F.lit(7))
    days = [i for i in range(7) if i not in off]
    partial = F.lit(0)
    for i in days:
        partial = partial + F.when(rest > i, 1).otherwise(0)
    return weeks * len(days) + partial


def _holidays(holidays, off: tuple[int, ...]) -> list[int]:
    return sorted({int(h) for h in holidays or () if (int(h) - 2) % 7 not in off})


def _networkdays(start, end, off, holidays) -> Column:
    a, b = F.floor(num(start)), F.floor(num(end))
    lo, hi = F.least(a, b), F.greatest(a, b)
    count = _work_days_before(hi, off) - _work_days_before(lo - 1, off)
    for h in _holidays(holidays, off):
        count = count - F.when(lo.__le__(h) & hi.__ge__(h), 1).otherwise(0)
    return guarded((F.when(a <= b, 1).otherwise(-1) * count).cast("double"), (_out_of_band(num(start)) | _out_of_band(num(end)), "#NUM!"), args=(start, end))


@function("NETWORKDAYS", 2, 3)
def NETWORKDAYS(start, end, holidays=None):
    """``holidays``: serials known when the plan is made."""
    return _networkdays(start, end, WEEKENDS[1], holidays)


@function("NETWORKDAYS.INTL", 2, 4)
def NETWORKDAYS_INTL(start, end, weekend=1, holidays=None):
    return _networkdays(start, end, _off_days(weekend), holidays)


def _workday(start, days, off, holidays) -> Column:
    """The start moved by whole weeks, the rest and then the holidays stepped over."""
    if len(off) == 7:
        return guarded(F.lit(None).cast("double"), (F.lit(True), "#VALUE!"))
    a, n = F.floor(num(start)), trunc(num(days))
    per_week = 7 - len(off)
    is_off = lambda k: _monday_based(k).isin(*off) if off else F.lit(False)
    forward, sign = n >= 0, F.when(n >= 0, 1).otherwise(-1)
    #: a start on a day off counts from the working day behind it
    at = a
    for _ in range(len(off)):
        at = F.when((n != 0) & is_off(at), at - sign).otherwise(at)
    weeks, rest = F.floor(F.abs(n) / per_week), F.pmod(F.abs(n), F.lit(per_week))
    at = at + sign * weeks * 7

    def step(state, i):
        k = state
        moved = k + sign
        for _ in range(len(off)):
            moved = F.when(is_off(moved), moved + sign).otherwise(moved)
        return F.when(i <= rest, moved).otherwise(k)

    at = F.aggregate(F.sequence(F.lit(1), F.lit(max(per_week - 1, 1))), at.cast("double"), lambda k, i: step(k, i).cast("double"))
    days_off = _holidays(holidays, off)
    for up in (True, False):
        for h in days_off if up else reversed(days_off):
            hit = (forward if up else ~forward) & (n != 0) & (a < h if up else a > h) & (at >= h if up else at <= h)
            moved = at + (1 if up else -1)
            for _ in range(len(off)):
                moved = F.when(is_off(moved), moved + (1 if up else -1)).otherwise(moved)
            at = F.when(hit, moved).otherwise(at)
    return guarded(at.cast("double"), (_out_of_band(num(start)) | (at < 0) | (at > LAST_SERIAL), "#NUM!"), args=(start, days))


@function("WORKDAY", 2, 3)
def WORKDAY(start, days, holidays=None):
    return _workday(start, days, WEEKENDS[1], holidays)


@function("WORKDAY.INTL", 2, 4)
def WORKDAY_INTL(start, days, weekend=1, holidays=None):
    return _workday(start, days, _off_days(weekend), holidays)


# --- day-count fractions ---------------------------------------------------------------------------------------------
def _parts(s) -> tuple[Column, Column, Column]:
    d = to_date(s)
    return F.year(d), F.month(d), F.dayofmonth(d)


def _last_of_february(s) -> Column:
    d = to_date(s)
    return (F.month(d) == 2) & (F.last_day(d) == d)


@function("DAYS360", 2, 3)
def DAYS360(start, end, european=False):
    (y1, m1, d1), (y2, m2, d2) = _parts(start), _parts(end)
    if european:
        a, b = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
        value = (y2 - y1) * 360 + (m2 - m1) * 30 + b - a
    else:
        a = F.when((d1 == 31) | _last_of_february(start), 30).otherwise(d1)
        over = (d2 == 31) & (a < 30)
        value = (y2 - y1) * 360 + (m2 - m1) * 30 + F.when(over, 30 + 1).when(d2 == 31, 30).otherwise(d2) - a
    return guarded(value.cast("double"), (_out_of_band(num(start)) | _out_of_band(num(end)), "#NUM!"), args=(start, end))


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


@function("YEARFRAC", 2, 3)
def YEARFRAC(start, end, basis: int = 0):
    a, b = F.least(F.floor(num(start)), F.floor(num(end))), F.greatest(F.floor(num(start)), F.floor(num(end)))
    (y1, m1, d1), (y2, m2, d2) = _parts(a), _parts(b)
    if basis == 0:
        feb1, feb2 = _last_of_february(a), _last_of_february(b)
        e = F.when(feb1 & feb2, 30).otherwise(d2)
        s = F.when(feb1 | (d1 == 31), 30).otherwise(d1)
        e = F.when((e == 31) & (s == 30), 30).otherwise(e)
        value = ((y2 - y1) * 360 + (m2 - m1) * 30 + e - s) / 360
    elif basis == 1:
        within = (y1 == y2) | ((y2 == y1 + 1) & ((m1 > m2) | ((m1 == m2) & (d1 >= d2))))
        feb_between = (_leap(y1) & (F.make_date(y1, F.lit(2), F.lit(28)) >= to_date(a))) | (_leap(y2) & (F.make_date(y2, F.lit(2), F.lit(28)) < to_date(b)))
        short = F.when(F.when(y1 == y2, _leap(y1)).otherwise(feb_between), 366.0).otherwise(365.0)
        years = y2 - y1 + 1
        leaps = lambda y: F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)
        mean = (years * 365 + leaps(y2) - leaps(y1 - 1)) / years
        value = (b - a) / F.when(within, short).otherwise(mean)
    elif basis in (2, 3):
        value = (b - a) / (360 if basis == 2 else 365)
    elif basis == 4:
        value = ((y2 - y1) * 360 + (m2 - m1) * 30 + F.least(d2, F.lit(30)) - F.least(d1, F.lit(30))) / 360
    else:
        return guarded(F.lit(None).cast("double"), (F.lit(True), "#NUM!"))
    return guarded(value.cast("double"), (_out_of_band(num(start)) | _out_of_band(num(end)), "#NUM!"), args=(start, end))


# --- times -----------------------------------------------------------------------------------------------------------
def _seconds(s) -> Column:
    fraction = num(s) - F.floor(num(s))
    return F.pmod(F.floor(fraction * 86400 + 0.5), F.lit(86400))


def _clock(name: str, f):
    def build(s):
        return guarded(f(_seconds(s)).cast("double"), (num(s) < 0, "#NUM!"), args=(s,))

    function(name, 1)(build)
    return build


HOUR = _clock("HOUR", lambda k: F.floor(k / 3600))
MINUTE = _clock("MINUTE", lambda k: F.pmod(F.floor(k / 60), F.lit(60)))
SECOND = _clock("SECOND", lambda k: F.pmod(k, F.lit(60)))


@function("TIME", 3)
def TIME(h, m, s):
    parts = [trunc(num(x)) for x in (h, m, s)]
    total = parts[0] * 3600 + parts[1] * 60 + parts[2]
    wide = (F.abs(parts[0]) > 32767) | (F.abs(parts[1]) > 32767) | (F.abs(parts[2]) > 32767)
    return guarded(F.pmod(total, F.lit(86400.0)) / 86400, (wide | (total < 0), "#NUM!"), args=(h, m, s))


def serial_of_iso(t: Column) -> Column:
    """Serial of ``yyyy-mm-dd[ hh:mm[:ss]]``, null for other text."""
    day = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?$", 1)
    time = F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}[ T](\d{1,2}:\d{2}(?::\d{2})?)$", 1)
    whole = serial(F.when(day != "", day).try_cast("date"))
    return F.when(whole >= 0, whole + F.coalesce(clock_fraction(time), F.lit(0.0)))


def clock_fraction(t: Column) -> Column:
    """Fraction of ``hh:mm[:ss]``, with AM or PM if given; null for other text."""
    pattern = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?(?: ?([AaPp])[Mm])?$"
    h, m, s, half = (F.regexp_extract(t, pattern, i) for i in (1, 2, 3, 4))
    n = lambda x: F.when(x != "", x).try_cast("double")
    hour = F.when(F.lower(half) == "p", F.pmod(n(h), F.lit(12.0)) + 12).when(F.lower(half) == "a", F.pmod(n(h), F.lit(12.0))).otherwise(n(h))
    ok = (hour < 24) & (n(m) < 60) & (F.coalesce(n(s), F.lit(0.0)) < 60) & ((half == "") | n(h).between(1, 12))
    return F.when(ok, (hour * 3600 + n(m) * 60 + F.coalesce(n(s), F.lit(0.0))) / 86400)


@function("DATEVALUE", 1)
def DATEVALUE(s):
    value = F.floor(serial_of_iso(F.trim(text(s)))).cast("double")
    return guarded(value, (value.isNull(), "#VALUE!"), args=(s,))


@function("TIMEVALUE", 1)
def TIMEVALUE(s):
    t = F.trim(text(s))
    value = F.coalesce(clock_fraction(t), serial_of_iso(t) - F.floor(serial_of_iso(t)))
    return guarded(value, (value.isNull(), "#VALUE!"), args=(s,))
