"""Criteria such as ``">10"``, ``"<>x"``, ``"a*"`` compiled to Column predicates that reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.core import fold
from quillgrid.functions.scalar_text import has_wildcard, wildcard_regex

_OPERATORS = ("<=", ">=", "<>", "<", ">", "=")


def _split(criterion: str) -> tuple[str, str]:
    for op in _OPERATORS:
        if criterion.startswith(op):
            return op, criterion[len(op) :]
    return "", criterion


def _as_number(s: str) -> float | None:
    try:
        x = float(s)
    except ValueError:
        return None
    return x if re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", s) else None


def _text_match(c: Column, pattern: str, begins: bool) -> Column:
    if has_wildcard(pattern) or begins:
        return c.rlike("(?is)^" + wildcard_regex(pattern) + ("" if begins else "$"))
    return fold(c) == pattern.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def criterion(c: Column, wanted, numeric: bool = True, begins: bool = False) -> Column:
    """A predicate that is never null.

    ``numeric``: the column holds numbers (else text): a number matches only numbers and a text only text; ``<>`` matches
    what is of the other kind, and blanks.  ``begins``: the database rule, bare text matches what begins with it.
    """
    if isinstance(wanted, Column):
        return F.coalesce(fold(c.cast("string")) == fold(wanted.cast("string")) if not numeric else c == wanted, F.lit(False))
    if isinstance(wanted, bool):
        return F.coalesce(c == F.lit(wanted), F.lit(False))
    if isinstance(wanted, (int, float)):
        return F.coalesce(c == F.lit(float(wanted)), F.lit(False)) if numeric else F.lit(False)
    op, operand = _split(wanted)
    number = _as_number(operand)
    blank = c.isNull()
    if operand == "":
        if op == "<>":
            return ~blank
        return blank if op == "=" else (blank if numeric else blank | (c == "")) if op == "" else F.lit(False)
    if number is not None:
        if not numeric:
            return F.lit(op == "<>")
        test = {"<": c < number, "<=": c <= number, ">": c > number, ">=": c >= number}.get(op, c == number)
        return F.coalesce(~(c == number), F.lit(True)) if op == "<>" else F.coalesce(test, F.lit(False))
    if numeric:
        return F.lit(op == "<>")
    if op in ("<", "<=", ">", ">="):
        low, want = fold(c), operand.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        return F.coalesce({"<": low < want, "<=": low <= want, ">": low > want, ">=": low >= want}[op], F.lit(False))
    match = F.coalesce(_text_match(c, operand, begins and op == ""), F.lit(False))
    return ~match if op == "<>" else match
