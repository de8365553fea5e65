"""XLSX workbooks: a zip of XML, for which Spark has no reader."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for letter in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(letter) - 64
    return n


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_S}t"))


def sheet_rows(data: bytes) -> list[dict[str, str | None]]:
    """Rows of the first sheet by header (folded, blanks as underscores), cells as text, whole numbers without a fraction; rows without a value go."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        first = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_S}sheets/{_S}sheet")
        if first is None:
            raise ValueError("workbook has no sheets")
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[first.get(_R)].lstrip("/")
        shared = [_text(x) for x in ET.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        sheet = ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))

    def value(cell: ET.Element) -> str | None:
        kind, v = cell.get("t"), cell.find(f"{_S}v")
        if kind == "inlineStr":
            return _text(cell)
        if v is None or v.text is None:
            return None
        if kind == "s":
            return shared[int(v.text)]
        return re.sub(r"\.0+\Z", "", v.text) if kind != "str" and re.fullmatch(r"-?\d+\.0+", v.text) else v.text

    table = [cells for row in sheet.iter(f"{_S}row") if (cells := {_column(c.get("r", "")): value(c) for c in row.iter(f"{_S}c")})]
    if not table:
        return []
    headers = {i: "_".join(str(v).casefold().split()) for i, v in table[0].items() if v}
    rows = [{h: cells.get(i) for i, h in headers.items()} for cells in table[1:]]
    return [r for r in rows if any(v not in (None, "") for v in r.values())]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of each workbook at `path`, with rec_ord; all columns are text."""
    found = spark.read.format("binaryFile").load(path).select("path", F.udf(sheet_rows, "array<map<string,string>>")("content").alias("rows"))
    rows = found.select("path", F.posexplode("rows").alias("rec_ord", "r"))
    headers = [r["h"] for r in rows.select(F.explode(F.map_keys("r")).alias("h")).distinct().orderBy("h").collect()]
    return rows.select(F.col("rec_ord").cast("long"), *[F.col("r")[h].alias(h) for h in headers])
