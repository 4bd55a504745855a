"""Spreadsheets in the Office Open XML format, read and written with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows that the format allows in a sheet: one task holds a sheet.
MOST_ROWS = 1_048_576

_TYPES = """<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>"""
_RELS = """<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"/></Relationships>"""
_BOOK = """<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>"""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> int:
    """The number, from 0, of the column of a cell such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def sheet_rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet, by default the first, each a list of texts; empty cells are None, and rows end at their last cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [x for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        chosen = [x for x in sheets if sheet is None or x.get("name") == sheet]
        if not chosen:
            raise ValueError(f"no sheet {sheet}; there are {', '.join(x.get('name', '') for x in sheets)}")
        target = targets[next(v for k, v in chosen[0].attrib.items() if _local(k) == "id")]
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) != "row":
                    continue
                row: list[str | None] = []
                for at, cell in enumerate(x for x in node if _local(x.tag) == "c"):
                    place = _column(cell.get("r")) if cell.get("r") else at
                    row += [None] * (place + 1 - len(row))
                    value = next((x.text for x in cell if _local(x.tag) == "v"), None)
                    kind = cell.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = _text(cell)
                    elif kind == "e":
                        value = None
                    row[place] = value
                yield row
                node.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, infer: bool = True) -> DataFrame:
    """A sheet whose first row names the columns, read where Spark reads; columns of numbers alone become doubles.

    A workbook is one task's work, and the format bounds its rows. Unnamed columns are called `Unnamed: n`, n from 0;
    repeated names get `.1`, `.2` and so on; rows without a value are left out, and empty cells are null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                held: list[tuple[int, list[str | None]]] = []
                for n, row in enumerate(sheet_rows(content, sheet)):
                    if n == 0 or any(v not in (None, "") for v in row):
                        held.append((n, row))
                    if len(held) == 5000:
                        yield pd.DataFrame(held, columns=["n", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["n", "cells"])

    rows = files.mapInPandas(run, "n long, cells array<string>").persist()
    head = rows.where("n = 0").select("cells").first()
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    names: list[str] = []
    for i in range(width):
        name = (head["cells"][i] if i < len(head["cells"]) else None) or f"Unnamed: {i}"
        same = sum(x == name or re.fullmatch(re.escape(name) + r"\.\d+", x) is not None for x in names)
        names.append(f"{name}.{same}" if same else name)
    cells = [F.expr(f"nullif(try_element_at(cells, {i + 1}), '')").alias(name) for i, name in enumerate(names)]
    table = rows.where("n > 0").orderBy("n").select(*cells)
    if infer and names:
        odd = table.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(str(i)) for i, c in enumerate(names)]).first()
        table = table.select(*[F.col(f"`{c}`").cast("double").alias(c) if not odd[i] else F.col(f"`{c}`") for i, c in enumerate(names)])
    return table


def sheet_bytes(names: list[str], rows: Iterator[list], sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; numbers are stored as such, all else as text, None as an empty cell."""
    def letters(n: int) -> str:
        return (letters(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)

    def cell(n: int, at: int, v) -> str:
        if v is None:
            return ""
        place = f"{letters(at)}{n}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{place}"><v>{v!r}</v></c>'
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr("_rels/.rels", _RELS.format(kind="officeDocument", target="xl/workbook.xml"))
        book.writestr("xl/workbook.xml", _BOOK.format(name=escape(sheet)))
        book.writestr("xl/_rels/workbook.xml.rels", _RELS.format(kind="worksheet", target="worksheets/sheet1.xml"))
        with book.open("xl/worksheets/sheet1.xml", "w") as stream:
            stream.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for n, row in enumerate([names, *rows], 1):
                stream.write(f'<row r="{n}">{"".join(cell(n, at, v) for at, v in enumerate(row))}</row>'.encode())
            stream.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """df, of MOST_ROWS rows at most, as one workbook, a file that Spark's file systems write."""
    rows = df.limit(MOST_ROWS).collect()
    if len(rows) == MOST_ROWS:
        raise ValueError(f"a sheet holds fewer than {MOST_ROWS} rows")
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(sheet_bytes(df.columns, [list(r) for r in rows], sheet)))
    finally:
        stream.close()
