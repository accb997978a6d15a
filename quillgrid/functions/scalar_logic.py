"""Logic, error handling, information, and choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import ERROR_TYPES, col, error_of, fold, function, guarded, keep_error, num, trunc, with_error


def _chain(pairs, last=None, codes=None) -> Column:
    """when(c1, v1).when(c2, v2)... with the chosen branch's error."""
    value, error = None, None
    for c, v in pairs:
        value = F.when(c, col(v)) if value is None else value.when(c, col(v))
        error = F.when(c, error_of(v)) if error is None else error.when(c, error_of(v))
    if codes is not None:
        return with_error(value, error.otherwise(F.lit(codes)))
    return with_error(value.otherwise(col(last)), error.otherwise(error_of(last)))


@function("IF", 2, 3)
def IF(condition, then, otherwise=False):
    c = col(condition)
    return with_error(F.when(c, col(then)).otherwise(col(otherwise)), F.coalesce(error_of(condition), F.when(c, error_of(then)).otherwise(error_of(otherwise))))


@function("IFS", 2, None)
def IFS(*pairs):
    if len(pairs) % 2:
        raise ValueError("#VALUE!: IFS takes pairs")
    return _chain(list(zip(pairs[::2], pairs[1::2])), codes="#N/A")


@function("SWITCH", 3, None)
def SWITCH(value, *rest):
    pairs = list(zip(rest[0 : len(rest) // 2 * 2 : 2], rest[1::2]))
    tests = [((fold(value) == fold(k)) if isinstance(k, str) else (col(value) == col(k)), v) for k, v in pairs]
    return _chain(tests, rest[-1]) if len(rest) % 2 else _chain(tests, codes="#N/A")


@function("CHOOSE", 2, None)
def CHOOSE(index, *values):
    k = trunc(num(index))
    return _chain([(k == i, v) for i, v in enumerate(values, 1)], codes="#VALUE!")


@function("IFERROR", 2)
def IFERROR(value, fallback):
    failed = error_of(value).isNotNull()
    return with_error(F.when(failed, col(fallback)).otherwise(col(value)), F.when(failed, error_of(fallback)))


@function("IFNA", 2)
def IFNA(value, fallback):
    missing = F.coalesce(error_of(value) == "#N/A", F.lit(False))
    return with_error(F.when(missing, col(fallback)).otherwise(col(value)), F.when(missing, error_of(fallback)).otherwise(error_of(value)))


def _truth(values) -> list[Column]:
    return [col(v) if not isinstance(v, (int, float)) or isinstance(v, bool) else F.lit(v != 0) for v in values]


def _reduced(values, join) -> Column:
    """Blanks say nothing; with no value at all the result is #VALUE!."""
    known = [c.isNotNull() for c in _truth(values)]
    return guarded(join(_truth(values)), (~reduce(lambda a, b: a | b, known), "#VALUE!"), args=values)


@function("AND", 1, None)
def AND(*values):
    return _reduced(values, lambda cs: reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in cs]))


@function("OR", 1, None)
def OR(*values):
    return _reduced(values, lambda cs: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in cs]))


@function("XOR", 1, None)
def XOR(*values):
    return _reduced(values, lambda cs: reduce(lambda a, b: a != b, [F.coalesce(c, F.lit(False)) for c in cs]))


def and_all(c) -> Column:
    """AND over a column of a group."""
    return F.bool_and(c)


def or_all(c) -> Column:
    return F.bool_or(c)


def xor_all(c) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)) % 2 == 1


@function("NOT", 1)
def NOT(x):
    return guarded(~F.coalesce(col(x), F.lit(False)), args=(x,))


@function("TRUE", 0)
def TRUE():
    return F.lit(True)


@function("FALSE", 0)
def FALSE():
    return F.lit(False)


# --- information -----------------------------------------------------------------------------------------------------
@function("NA", 0)
def NA():
    return with_error(F.lit(None).cast("double"), F.lit("#N/A"))


@function("ISERROR", 1)
def ISERROR(x):
    return error_of(x).isNotNull()


@function("ISERR", 1)
def ISERR(x):
    return F.coalesce(error_of(x) != "#N/A", F.lit(False))


@function("ISNA", 1)
def ISNA(x):
    return F.coalesce(error_of(x) == "#N/A", F.lit(False))


@function("ERROR.TYPE", 1)
def ERROR_TYPE(x):
    code = error_of(x)
    table = F.create_map(*[F.lit(v) for pair in ERROR_TYPES.items() for v in pair])
    return with_error(F.try_element_at(table, code).cast("double"), F.when(code.isNull(), "#N/A"))


@function("ISBLANK", 1)
def ISBLANK(x):
    return col(x).isNull() & error_of(x).isNull()


def kind_of(x) -> Column:
    """number, text, boolean or null, by the column's Spark type."""
    t = F.typeof(col(x))
    return F.when(col(x).isNull(), F.lit(None)).when(t == "string", "text").when(t == "boolean", "boolean").otherwise("number")


def _is(name: str, test):
    def build(x):
        return F.coalesce(test(kind_of(x)), F.lit(False))

    function(name, 1)(build)
    return build


ISNUMBER = _is("ISNUMBER", lambda k: k == "number")
ISTEXT = _is("ISTEXT", lambda k: k == "text")
ISLOGICAL = _is("ISLOGICAL", lambda k: k == "boolean")


@function("ISNONTEXT", 1)
def ISNONTEXT(x):
    return ~ISTEXT(x)


@function("TYPE", 1)
def TYPE(x):
    k = kind_of(x)
    return F.when(error_of(x).isNotNull(), 16.0).when(k == "text", 2.0).when(k == "boolean", 4.0).otherwise(1.0)


@function("N", 1)
def N(x):
    return guarded(F.when(kind_of(x).isin("number", "boolean"), col(x).try_cast("double")).otherwise(F.lit(0.0)), args=(x,))


def _parity(x, odd: int) -> Column:
    return guarded(F.pmod(trunc(num(x)), F.lit(2.0)) == odd, (kind_of(x) == "boolean", "#VALUE!"), args=(x,))


@function("ISEVEN", 1)
def ISEVEN(x):
    return _parity(x, 0)


@function("ISODD", 1)
def ISODD(x):
    return _parity(x, 1)


@function("ISFORMULA", 1)
def ISFORMULA(source):
    """On the ``source`` column of a cell relation."""
    return F.coalesce(col(source).startswith("="), F.lit(False))


# --- comparison ------------------------------------------------------------------------------------------------------
def _ordered(x: Column, other: Column) -> Column:
    """(kind, number, text) by which values compare: numbers, then text without regard to ASCII case, then booleans.

    A blank is what the other side's kind has for nothing.
    """

    def kind(c: Column) -> Column:
        return F.when(F.typeof(c).startswith("string"), 1).when(F.typeof(c) == "boolean", 2).otherwise(0)

    k = F.when(x.isNull() & other.isNotNull(), kind(other)).otherwise(kind(x))
    number = F.when(kind(x) == 0, x.try_cast("double"))
    text_ = F.when(kind(x) > 0, fold(x.cast("string")))
    return F.struct(k.alias("kind"), F.coalesce(number, F.lit(0.0)).alias("number"), F.coalesce(text_, F.when(k == 2, "false").otherwise("")).alias("text"))


def _comparison(sign: str, f):
    def build(a, b):
        a, b = col(a), col(b)
        return keep_error(f(_ordered(a, b), _ordered(b, a)), a, b)

    build.__name__ = sign
    return build


EQ = _comparison("=", lambda a, b: a == b)
NE = _comparison("<>", lambda a, b: a != b)
LT = _comparison("<", lambda a, b: a < b)
LE = _comparison("<=", lambda a, b: a <= b)
GT = _comparison(">", lambda a, b: a > b)
GE = _comparison(">=", lambda a, b: a >= b)
COMPARISONS = {"=": EQ, "<>": NE, "<": LT, "<=": LE, ">": GT, ">=": GE}
