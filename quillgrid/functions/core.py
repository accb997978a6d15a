"""Values and errors of formula functions as Spark Columns.

The typed lane: a Column holds numbers, text, booleans or dates, and null is a blank or a failed cell.  A function that
can fail also carries a Column with its error code; ``error_of`` reads it, and functions of failed arguments pass on the
leftmost code, as spreadsheets do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes and their ERROR.TYPE numbers (fixed values).
ERROR_TYPES = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7, "#SPILL!": 9, "#CALC!": 14}

_ATTR = "_quillgrid_error"

#: name -> Function, filled by @function.
REGISTRY: dict[str, Function] = {}


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable
    #: scalar (Column of a row), aggregate (Column for agg or over), relation (works on DataFrames), plan (plan-time value)
    kind: str
    least: int
    most: int | None


def function(name: str, least: int, most: int | None = -1, kind: str = "scalar"):
    """Register a builder under its formula name; ``most`` None: any number of arguments, left out: ``least``."""

    def keep(build):
        REGISTRY[name] = Function(name, build, kind, least, least if most == -1 else most)
        return build

    return keep


def alias(name: str, of: str) -> None:
    f = REGISTRY[of]
    REGISTRY[name] = Function(name, f.build, f.kind, f.least, f.most)


def call(name: str, *args, **kwargs):
    """Build a registered function with its number of arguments checked."""
    f = REGISTRY.get(name.upper())
    if f is None:
        raise KeyError(f"#NAME? {name}")
    if len(args) < f.least or f.most is not None and len(args) > f.most:
        raise TypeError(f"{name} takes {f.least} to {f.most} arguments, not {len(args)}")
    return f.build(*args, **kwargs)


def col(x) -> Column:
    """A Column from a Column or a Python literal (a str is text, never a column name)."""
    return x if isinstance(x, Column) else F.lit(x)


def num(x) -> Column:
    """A number: booleans are 1 and 0; Python text must be a number."""
    if isinstance(x, bool):
        return F.lit(1.0 if x else 0.0)
    if isinstance(x, (int, float)):
        return F.lit(float(x))
    if isinstance(x, str):
        return F.lit(float(x))
    return keep_error(x.cast("double"), x) if isinstance(x, Column) else F.lit(None).cast("double")


def ranged(x) -> Column:
    """The numbers of a range: text and booleans in it are no numbers, as blanks are; a literal is read as by :func:`num`.

    The type is known when the plan is made, so nothing of the choice is left in it.
    """
    if not isinstance(x, Column):
        return num(x)
    other = F.typeof(x).startswith("string") | (F.typeof(x) == "boolean")
    return keep_error(F.when(~other, x.try_cast("double")), x)


def aggregated(value: Column, *args, fails: tuple = ()) -> Column:
    """An aggregate that fails with the smallest error code in its arguments' cells, else with the first code of ``fails``
    (aggregate condition, code) that holds."""
    errors = [F.min(error_of(a)) for a in args if has_error(a)]
    own = None
    for condition, code in fails:
        own = F.when(condition, code) if own is None else own.when(condition, code)
    parts = [*errors, *([own] if own is not None else [])]
    if not parts:
        return value
    error = F.coalesce(*parts)
    return with_error(F.when(error.isNull(), value), error)


def text(x) -> Column:
    """Text: a blank is empty."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def error_of(x) -> Column:
    """The error code of a built Column, null where it has none."""
    return x.__dict__[_ATTR] if has_error(x) else F.lit(None).cast("string")


def has_error(x) -> bool:
    return isinstance(x, Column) and _ATTR in x.__dict__


def with_error(value: Column, error: Column | None) -> Column:
    if error is not None:
        value.__dict__[_ATTR] = error
    return value


def keep_error(value: Column, *args) -> Column:
    """``value`` with the leftmost error of ``args``; null where there is one."""
    errors = [error_of(a) for a in args if has_error(a)]
    if not errors:
        return value
    error = F.coalesce(*errors)
    return with_error(F.when(error.isNull(), value), error)


def guarded(value: Column, *conditions: tuple[Column, str], args: tuple = ()) -> Column:
    """``value``, or null with a code: the leftmost error of ``args``, else the code of the first true condition."""
    errors = [error_of(a) for a in args if has_error(a)]
    own = None
    for condition, code in conditions:
        own = F.when(condition, code) if own is None else own.when(condition, code)
    parts = [*errors, *([own] if own is not None else [])]
    if not parts:
        return value
    error = F.coalesce(*parts)
    return with_error(F.when(error.isNull(), value), error)


def finite(value: Column, *conditions: tuple[Column, str], args: tuple = ()) -> Column:
    """As :func:`guarded`; a result that is not finite is #NUM!, and minus zero is zero."""
    value = value + F.lit(0.0)
    return guarded(value, *conditions, (value * 0 != 0, "#NUM!"), args=args)


def trunc(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def fold(x) -> Column:
    """Text with ASCII letters in lower case: how formulas compare."""
    return F.translate(col(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def both(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
