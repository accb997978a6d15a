"""Text functions over whole columns; places count Unicode characters from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import alias, col, fold, function, guarded, num, text, trunc

#: Windows-1252 characters of codes 128 to 159 (fixed values; unassigned codes are control characters).
CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
MOST_CHARACTERS = 32767


def _int(x) -> Column:
    return F.greatest(F.least(trunc(num(x)), F.lit(2147483647.0)), F.lit(-2147483648.0)).cast("int")


def concat(*values) -> Column:
    """The & operator."""
    return guarded(F.concat(*[text(v) for v in values]), args=values)


@function("CONCAT", 1, None)
def CONCAT(*values):
    return guarded(F.concat(*[text(v) for v in values]), args=values)


alias("CONCATENATE", "CONCAT")


@function("TEXTJOIN", 3, None)
def TEXTJOIN(delimiter, ignore_empty, *values):
    every = F.array(*[text(v) for v in values])
    return guarded(F.when(col(ignore_empty), F.array_join(F.filter(every, lambda x: x != ""), delimiter)).otherwise(F.array_join(every, delimiter)) if isinstance(delimiter, str) else F.concat_ws(delimiter, every), args=values)


@function("LEFT", 1, 2)
def LEFT(s, n=1):
    return guarded(F.left(text(s), _int(n)), (num(n) < 0, "#VALUE!"), args=(s, n))


@function("RIGHT", 1, 2)
def RIGHT(s, n=1):
    return guarded(F.right(text(s), _int(n)), (num(n) < 0, "#VALUE!"), args=(s, n))


@function("MID", 3)
def MID(s, start, n):
    return guarded(F.substring(text(s), F.greatest(_int(start), F.lit(1)), F.greatest(_int(n), F.lit(0))), ((num(start) < 1) | (num(n) < 0), "#VALUE!"), args=(s, start, n))


@function("LEN", 1)
def LEN(s):
    return guarded(F.char_length(text(s)).cast("double"), args=(s,))


def _locate(needle: Column, hay: Column, start: Column) -> Column:
    """First place of ``needle`` from ``start``, 0 if there is none; an empty one is found at ``start``."""
    rest = F.substring(hay, start, F.lit(2147483647))
    at = F.call_function("instr", rest, needle)
    return F.when(needle == "", start).when(at > 0, at + start - 1).otherwise(F.lit(0))


@function("FIND", 2, 3)
def FIND(needle, s, start=1):
    n, hay, at = text(needle), text(s), _int(start)
    found = _locate(n, hay, F.greatest(at, F.lit(1)))
    bad = (at < 1) | (at > F.char_length(hay) + 1) | (found == 0)
    return guarded(found.cast("double"), (bad, "#VALUE!"), args=(needle, s, start))


def wildcard_regex(pattern: str) -> str:
    """A Java regular expression for ``* ? ~`` wildcards; it is not anchored."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            out.append(_quote(pattern[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else _quote(c))
        i += 1
    return "".join(out)


def _quote(c: str) -> str:
    return c if c.isalnum() or c == " " or ord(c) > 127 else "\\" + c


def has_wildcard(pattern: str) -> bool:
    return any(c in pattern for c in "*?~")


@function("SEARCH", 2, 3)
def SEARCH(needle, s, start=1):
    """Without regard to ASCII case; a literal needle may hold wildcards."""
    hay, at = fold(text(s)), _int(start)
    if isinstance(needle, str) and has_wildcard(needle):
        from_ = F.greatest(at, F.lit(1))
        rest = F.substring(hay, from_, F.lit(2147483647))
        lead = F.regexp_extract(rest, "(?s)^(.*?)" + wildcard_regex(needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), 1)
        hit = rest.rlike("(?s)" + wildcard_regex(needle.lower()))
        found = F.when(hit, F.char_length(lead) + from_).otherwise(F.lit(0))
    else:
        found = _locate(fold(text(needle)), hay, F.greatest(at, F.lit(1)))
    bad = (at < 1) | (at > F.char_length(hay) + 1) | (found == 0)
    return guarded(found.cast("double"), (bad, "#VALUE!"), args=(needle, s, start))


@function("SUBSTITUTE", 3, 4)
def SUBSTITUTE(s, old, new, instance=None):
    s_, o, n = text(s), text(old), text(new)
    if instance is None:
        return guarded(F.when(o == "", s_).otherwise(F.replace(s_, o, n)), args=(s, old, new))
    k = _int(instance)
    parts = F.split(s_, F.concat(F.lit("\\Q"), o, F.lit("\\E")), -1)
    enough = (F.size(parts) > k) & (o != "")
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(1))), "\x00")
    tail = F.array_join(F.slice(parts, F.greatest(k, F.lit(1)) + 1, F.greatest(F.size(parts) - k, F.lit(0))), "\x00")
    value = F.when(enough, F.concat(F.replace(head, F.lit("\x00"), o), n, F.replace(tail, F.lit("\x00"), o))).otherwise(s_)
    return guarded(value, (k < 1, "#VALUE!"), args=(s, old, new, instance))


@function("REPLACE", 4)
def REPLACE(s, start, n, new):
    s_, at, k = text(s), _int(start), _int(n)
    head = F.substring(s_, F.lit(1), F.greatest(at - 1, F.lit(0)))
    tail = F.substring(s_, F.greatest(at, F.lit(1)) + F.greatest(k, F.lit(0)), F.lit(2147483647))
    return guarded(F.concat(head, text(new), tail), ((at < 1) | (k < 0), "#VALUE!"), args=(s, start, n, new))


@function("TRIM", 1)
def TRIM(s):
    return guarded(F.regexp_replace(F.trim(text(s)), " +", " "), args=(s,))


@function("UPPER", 1)
def UPPER(s):
    return guarded(F.upper(text(s)), args=(s,))


@function("LOWER", 1)
def LOWER(s):
    return guarded(F.lower(text(s)), args=(s,))


@function("REPT", 2)
def REPT(s, n):
    k = _int(n)
    long = F.char_length(text(s)).cast("long") * k > MOST_CHARACTERS
    return guarded(F.repeat(text(s), F.when((k < 0) | long, F.lit(0)).otherwise(k)), ((k < 0) | long, "#VALUE!"), args=(s, n))


@function("PROPER", 1)
def PROPER(s):
    """A letter is a capital unless a letter stands before it."""
    letters = F.split(F.lower(text(s)), "")
    step = lambda a, c: F.struct(F.concat(a["out"], F.when(a["inside"], c).otherwise(F.upper(c))).alias("out"), c.rlike(r"^\p{L}$").alias("inside"))
    value = F.aggregate(letters, F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")), step, lambda a: a["out"])
    return guarded(value, args=(s,))


@function("EXACT", 2)
def EXACT(a, b):
    return guarded(text(a) == text(b), args=(a, b))


@function("CHAR", 1)
def CHAR(n):
    k = _int(n)
    table = F.array(*[F.lit(c) for c in CP1252])
    inside = F.least(F.greatest(k - 127, F.lit(1)), F.lit(32))
    return guarded(F.when(k.between(128, 159), F.element_at(table, inside)).otherwise(F.chr(k)), ((k < 1) | (k > 255), "#VALUE!"), args=(n,))


@function("CODE", 1)
def CODE(s):
    first = F.left(text(s), F.lit(1))
    point = F.ascii(first)
    at = F.array_position(F.array(*[F.lit(c) for c in CP1252]), first)
    value = F.when(at > 0, at + 127).when((point < 128) | point.between(160, 255), point).otherwise(F.lit(63))
    return guarded(value.cast("double"), (text(s) == "", "#VALUE!"), args=(s,))


@function("UNICHAR", 1)
def UNICHAR(n):
    k = _int(n)
    bad = (k < 1) | (k > 0x10FFFF) | k.between(0xD800, 0xDFFF)
    point = F.when(bad, F.lit(32)).otherwise(k)
    return guarded(F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"), (bad, "#VALUE!"), args=(n,))


@function("UNICODE", 1)
def UNICODE(s):
    return guarded(F.ascii(F.left(text(s), F.lit(1))).cast("double"), (text(s) == "", "#VALUE!"), args=(s,))


@function("CLEAN", 1)
def CLEAN(s):
    return guarded(F.regexp_replace(text(s), "[\\x00-\\x1F]", ""), args=(s,))


@function("T", 1)
def T(x, is_text: bool = True):
    return text(x) if is_text else F.lit("")


def _cut(s, delimiter, instance, ignore_case, match_end, if_not_found, before: bool) -> Column:
    s_, d, k = text(s), text(delimiter), _int(instance)
    hay, needle = (fold(s_), fold(d)) if ignore_case else (s_, d)
    n = F.char_length(s_)
    width = F.char_length(d)
    parts = F.split(hay, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    count = F.size(parts) - 1
    #: the delimiter's number from the left; with match_end the end of the text is one more
    total = count + (1 if match_end else 0)
    number = F.when(k > 0, k).otherwise(total + 1 + k)
    ok = (number >= 1) & (number <= total)
    lengths = F.transform(F.slice(parts, F.lit(1), F.greatest(F.least(number, count + 1), F.lit(1))), lambda p: F.char_length(p) + width)
    start = F.aggregate(lengths, F.lit(0), lambda a, x: a + x) - width
    at_end = number > count
    value = F.when(at_end, s_ if before else F.lit("")).otherwise(F.left(s_, start) if before else F.substring(s_, start + width + 1, n))
    empty = F.when(k > 0, F.lit("") if before else s_).otherwise(s_ if before else F.lit(""))
    miss = ~ok & (needle != "")
    value = F.when(needle == "", empty).when(ok, value)
    if if_not_found is not None:
        return guarded(F.when(miss, col(if_not_found)).otherwise(value), (k == 0, "#VALUE!"), args=(s, delimiter))
    return guarded(value, (k == 0, "#VALUE!"), (miss, "#N/A"), args=(s, delimiter))


@function("TEXTBEFORE", 2, 6)
def TEXTBEFORE(s, delimiter, instance=1, ignore_case=False, match_end=False, if_not_found=None):
    return _cut(s, delimiter, instance, ignore_case, match_end, if_not_found, True)


@function("TEXTAFTER", 2, 6)
def TEXTAFTER(s, delimiter, instance=1, ignore_case=False, match_end=False, if_not_found=None):
    return _cut(s, delimiter, instance, ignore_case, match_end, if_not_found, False)


def _number(s: Column) -> Column:
    plain = F.regexp_replace(s, r"[$, ]", "")
    negative = plain.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(plain, r"[()]", "")
    share = F.char_length(F.regexp_extract(bare, "(%*)$", 1))
    digits = F.regexp_replace(bare, "%+$", "")
    ok = digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(ok, digits).try_cast("double") / F.pow(F.lit(100.0), share)
    return F.when(negative, -value).otherwise(value)


@function("VALUE", 1)
def VALUE(s):
    """The number that English text spells: $, thousands, %, (negative), or an ISO date or clock time."""
    from quillgrid.functions.scalar_date import clock_fraction, serial_of_iso

    t = F.trim(text(s))
    value = F.coalesce(_number(t), serial_of_iso(t), clock_fraction(t))
    return guarded(value, (value.isNull(), "#VALUE!"), args=(s,))


@function("NUMBERVALUE", 1, 3)
def NUMBERVALUE(s, decimal=".", group=","):
    t = F.replace(F.regexp_replace(text(s), r"\s", ""), F.lit(group), F.lit(""))
    share = F.char_length(F.regexp_extract(t, "(%*)$", 1))
    digits = F.replace(F.regexp_replace(t, "%+$", ""), F.lit(decimal), F.lit("."))
    ok = digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(t == "", F.lit(0.0)).otherwise(F.when(ok, digits).try_cast("double") / F.pow(F.lit(100.0), share))
    return guarded(value, (value.isNull(), "#VALUE!"), args=(s,))


def _fixed_text(x, decimals, commas: bool) -> Column:
    from quillgrid.functions.scalar_math import ROUND

    d = decimals if isinstance(decimals, int) else 2
    rounded = ROUND(F.abs(num(x)), d)
    shown = F.format_number(rounded, max(d, 0))
    return shown if commas else F.replace(shown, F.lit(","), F.lit(""))


@function("FIXED", 1, 3)
def FIXED(x, decimals=2, no_commas=False, signed_zero=False):
    """A negative number that rounds to zero has its sign only with ``signed_zero``."""
    shown = _fixed_text(x, decimals, not no_commas)
    sign = F.when((num(x) < 0) & (F.lit(signed_zero) | shown.rlike("[1-9]")), "-").otherwise("")
    return guarded(F.concat(sign, shown), args=(x,))


@function("DOLLAR", 1, 2)
def DOLLAR(x, decimals=2):
    shown = _fixed_text(x, decimals, True)
    return guarded(F.when((num(x) < 0) & shown.rlike("[1-9]"), F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("$"), shown)), args=(x,))


def _letters(n: Column) -> Column:
    """Column letters of a number from 1 to 18278."""
    digit = lambda k: F.chr((k + 65).cast("int"))
    k = n.cast("int") - 1
    one = digit(F.pmod(k, F.lit(26)))
    two = digit(F.pmod(F.floor(k / 26) - 1, F.lit(26)))
    three = digit(F.pmod(F.floor((F.floor(k / 26) - 1) / 26) - 1, F.lit(26)))
    return F.when(k < 26, one).when(k < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


@function("ADDRESS", 2, 5)
def ADDRESS(row, column, absolute=1, a1=True, sheet=None):
    r, c = _int(row), _int(column)
    row_text, col_text = r.cast("string"), c.cast("string")
    if a1:
        value = F.concat(F.lit("$" if absolute in (1, 3) else ""), _letters(c), F.lit("$" if absolute in (1, 2) else ""), row_text)
    else:
        value = F.concat(F.lit("R"), row_text if absolute in (1, 2) else F.concat(F.lit("["), row_text, F.lit("]")), F.lit("C"), col_text if absolute in (1, 3) else F.concat(F.lit("["), col_text, F.lit("]")))
    if sheet is not None:
        plain = sheet.replace("_", "a").replace(".", "a").isalnum() and not sheet[:1].isdigit()
        value = F.concat(F.lit((sheet if plain else "'" + sheet.replace("'", "''") + "'") + "!"), value)
    return guarded(value, ((r < 1) | (c < 1), "#VALUE!"), args=(row, column))
