"""Workbooks in .xlsx files as cell relations: one file a task, read and written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from quillgrid.sources.tree import CELLS, column_letters, column_number

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def cells_of(data: bytes):
    """(tab, row, col, kind, num, txt, bool, err, src) of all filled cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names, strings = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            for _, c in ElementTree.iterparse(io.BytesIO(z.read(f"xl/{targets[sheet.get(_REL)]}"))):
                if c.tag != f"{{{_NS['m']}}}c":
                    continue
                m = re.match(r"([A-Z]+)(\d+)", c.get("r"))
                value, formula, kind = c.find("m:v", _NS), c.find("m:f", _NS), c.get("t", "n")
                text = value.text if value is not None else None
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                src = "=" + formula.text if formula is not None and formula.text else None
                if text is None and src is None:
                    continue
                at = (sheet.get("name"), int(m[2]), column_number(m[1]))
                if kind == "b":
                    yield (*at, "bool", None, None, text == "1", None, src)
                elif kind == "e":
                    yield (*at, "error", None, None, None, text, src)
                elif kind in ("s", "str", "inlineStr"):
                    yield (*at, "text", None, strings[int(text)] if kind == "s" else text, None, None, src)
                else:
                    yield (*at, "number" if text is not None else "formula", float(text) if text is not None else None, None, None, None, src)
                c.clear()


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every workbook under ``path`` (any store that Spark reads), with the file's path."""

    def run(batches):
        import pandas as pd

        columns = ["path", *[c.split()[0] for c in CELLS.split(", ")]]
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(p, *c) for c in cells_of(data)], columns=columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, " + CELLS)


def workbook_bytes(cells) -> bytes:
    """A minimal .xlsx of (tab, row, col, kind, num, txt, bool, err, src) tuples; a workbook is one file, so it fits a task."""
    tabs: dict[str, dict[int, list[str]]] = {}
    for tab, row, col, kind, num, txt, bool_, err, src in sorted(cells, key=lambda c: c[:3]):
        ref, formula = f"{column_letters(col)}{row}", f"<f>{escape(src[1:])}</f>" if src else ""
        if kind == "number":
            xml = f'<c r="{ref}">{formula}<v>{num!r}</v></c>'
        elif kind == "bool":
            xml = f'<c r="{ref}" t="b">{formula}<v>{int(bool_)}</v></c>'
        elif kind == "error":
            xml = f'<c r="{ref}" t="e">{formula}<v>{err}</v></c>'
        elif kind == "text":
            xml = f'<c r="{ref}" t="str">{formula}<v>{escape(txt)}</v></c>' if src else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(txt)}</t></is></c>'
        elif kind == "formula":
            xml = f'<c r="{ref}">{formula}</c>'
        else:
            continue
        tabs.setdefault(tab, {}).setdefault(row, []).append(xml)
    main, office = _NS["m"], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = list(tabs)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in enumerate(sheets, 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in enumerate(sheets, 1)) + "</Relationships>")
        for i, t in enumerate(sheets, 1):
            rows = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in tabs[t].items())
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()
