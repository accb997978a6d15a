"""A directory of range files as a cell relation: folders are tabs, a file's name is the A1 range its TSV lines fill."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "tab string, row long, col long, kind string, num double, txt string, bool boolean, err string, src string"
_NAME = re.compile(r"^([A-Z]+)([1-9][0-9]*)(?:[:\-]([A-Z]+)([1-9][0-9]*))?(?:\.tsv)?$")
_NUMBER = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
_ERRORS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NULL!", "#NUM!")


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


@dataclass(frozen=True)
class Rect:
    """A closed range; rows and columns count from 1."""

    top: int
    left: int
    bottom: int
    right: int

    @classmethod
    def parse(cls, name: str) -> Rect | None:
        m = _NAME.match(name)
        if not m:
            return None
        left, top = column_number(m[1]), int(m[2])
        right, bottom = (column_number(m[3]), int(m[4])) if m[3] else (left, top)
        if m[3] and (right, bottom) == (left, top):
            raise ValueError(f"degenerate-range: {name}")
        if right < left or bottom < top:
            raise ValueError(f"illegal-name: {name}")
        return cls(top, left, bottom, right)

    def meets(self, other: Rect) -> bool:
        return self.top <= other.bottom and other.top <= self.bottom and self.left <= other.right and other.left <= self.right


def unescape(field: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"t": "\t", "n": "\n", "\\": "\\"}.get(m[1], m[0]), field)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def literal(field: str) -> tuple:
    """(kind, num, txt, bool, err, src) of one field, in the order in which literals are tried."""
    s = unescape(field)
    if s == "":
        return ("blank", None, None, None, None, None)
    if s.startswith("="):
        return ("formula", None, None, None, None, s)
    if s.startswith("'"):
        return ("text", None, s[1:], None, None, None)
    if s in ("TRUE", "FALSE"):
        return ("bool", None, None, s == "TRUE", None, None)
    if s in _ERRORS:
        return ("error", None, None, None, s, None)
    plain = s.replace("$", "", 1).replace(",", "")
    share = plain.endswith("%")
    plain = plain[:-1] if share else plain
    if _NUMBER.match(plain) and (plain == s or re.match(r"^-?\$?\d{1,3}(,\d{3})*(\.\d+)?%?$|^-?\$?\d+(\.\d+)?%?$", s)):
        return ("number", float(plain) / (100 if share else 1), None, None, None, None)
    return ("text", None, s, None, None, None)


class _File(InputPartition):
    def __init__(self, tab: str, path: str, rect: Rect):
        self.tab, self.path, self.rect = tab, path, rect


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.tab = options["path"], options.get("tab")
        self.wanted = Rect.parse(options["range"]) if "range" in options else None

    def partitions(self):
        """Names alone decide which files are read; overlapping files of a tab are refused."""
        out = []
        for tab in sorted(os.listdir(self.root)):
            folder = os.path.join(self.root, tab)
            if not os.path.isdir(folder) or self.tab and tab != self.tab:
                continue
            found = [(n, Rect.parse(n)) for n in sorted(os.listdir(folder)) if not n.startswith(".")]
            rects = sorted((r for _, r in found if r), key=lambda r: (r.top, r.left))
            open_: list[Rect] = []
            for r in rects:
                open_ = [o for o in open_ if o.bottom >= r.top]
                if any(r.meets(o) for o in open_):
                    raise ValueError(f"overlap in {tab} at {column_letters(r.left)}{r.top}")
                open_.append(r)
            out += [_File(tab, os.path.join(folder, n), r) for n, r in found if r and (self.wanted is None or r.meets(self.wanted))]
        return out

    def read(self, part: _File):
        r, n = part.rect, 0
        with open(part.path, encoding="utf-8", newline="") as f:
            for n, line in enumerate(f, 1):
                fields = line.rstrip("\n").split("\t")
                if len(fields) != r.right - r.left + 1:
                    raise ValueError(f"dimension-mismatch: {part.path} line {n}")
                for k, field in enumerate(fields):
                    row, column = r.top + n - 1, r.left + k
                    if self.wanted is None or self.wanted.meets(Rect(row, column, row, column)):
                        yield (part.tab, row, column, *literal(field))
        if n != r.bottom - r.top + 1:
            raise ValueError(f"dimension-mismatch: {part.path} has {n} lines")


class TreeSource(DataSource):
    """``spark.read.format("rangetree").option("tab", ...).option("range", "A1:C9").load(root)``.

    The root must be a folder that every executor can open; each file is a partition, pruned by its name.
    """

    @classmethod
    def name(cls) -> str:
        return "rangetree"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, tab: str | None = None, range_: str | None = None) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("rangetree")
    for k, v in (("tab", tab), ("range", range_)):
        if v:
            reader = reader.option(k, v)
    return reader.load(root)


def table_of(cells: DataFrame, headers: list[tuple[int, str, str]], first_row: int) -> DataFrame:
    """A wide table from the cell relation: headers are (column, name, kind), rows start below the header; adds ``__row``."""
    value = {"number": F.col("num"), "text": F.col("txt"), "bool": F.col("bool")}
    columns = [F.max(F.when(F.col("col") == n, value[kind])).alias(name) for n, name, kind in headers]
    return cells.where(F.col("row") >= first_row).groupBy(F.col("row").alias("__row")).agg(*columns)


def field_of(kind: Column, num: Column, txt: Column, bool_: Column, err: Column, src: Column) -> Column:
    """The TSV field of a cell."""
    number = F.when(num == F.floor(num), F.format_string("%.0f", num)).otherwise(num.cast("string"))
    out = F.when(kind == "number", number).when(kind == "bool", F.when(bool_, "TRUE").otherwise("FALSE")).when(kind == "error", err).when(kind == "formula", src)
    needs_mark = txt.rlike(r"^['=]|^(TRUE|FALSE)$|^#|^[+-]?[$.0-9]")
    quoted = F.when(needs_mark, F.concat(F.lit("'"), txt)).otherwise(txt)
    escaped = F.replace(F.replace(F.replace(quoted, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return out.when(kind == "text", escaped).otherwise(F.lit(""))


def tsv_lines(cells: DataFrame) -> DataFrame:
    """(tab, row, line): the cells of each row joined by tabs, gaps between the first and the last column blank."""
    fields = cells.select("tab", "row", "col", field_of(*[F.col(c) for c in ("kind", "num", "txt", "bool", "err", "src")]).alias("field"))
    span = fields.groupBy("tab").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    rows = fields.groupBy("tab", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "field"))).alias("m")).join(F.broadcast(span), "tab")
    line = F.array_join(F.transform(F.sequence("lo", "hi"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))), "\t")
    return rows.select("tab", "row", line.alias("line"))
