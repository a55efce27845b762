"""Workbooks and PDF files as extraction results.

A workbook is a zip of XML, read with the standard library; PDF needs PyMuPDF
and is an error per file where that isn't installed.  A file that can't be read
is a failure row and stops nothing.
"""

from __future__ import annotations

import importlib.util
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CELL = "struct<workbook_id:string,sheet_name:string,cell_address:string,value:string,formula:string,note:string,metadata:struct<data_type:string,number_format:string>>"
SHEETS = f"array<struct<workbook_id:string,sheet_name:string,cells:array<{CELL}>>>"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def read_workbook(content: bytes, workbook_id: str) -> list[dict]:
    """The sheets of a workbook with their non-empty cells; a formula's cell has the formula as its value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).findall(f"{_PACKAGE}Relationship")}
        sheets = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            notes = _notes(z, names, target)
            cells = []
            for c in ElementTree.fromstring(z.read(target)).iter(f"{_MAIN}c"):
                kind, value, formula = c.get("t", "n"), c.findtext(f"{_MAIN}v"), c.findtext(f"{_MAIN}f")
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = _text(c)
                elif kind == "b" and value is not None:
                    value = "True" if value == "1" else "False"
                if formula is not None:
                    formula, kind = f"={formula}", "f"
                    value = formula
                if value is not None:
                    cells.append({"workbook_id": workbook_id, "sheet_name": sheet.get("name"), "cell_address": c.get("r"), "value": value, "formula": formula, "note": notes.get(c.get("r")), "metadata": {"data_type": kind, "number_format": c.get("s")}})
            sheets.append({"workbook_id": workbook_id, "sheet_name": sheet.get("name"), "cells": cells})
        return sheets


def _notes(z: zipfile.ZipFile, names: set[str], target: str) -> dict[str, str]:
    folder, _, name = target.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in names:
        return {}
    for r in ElementTree.fromstring(z.read(rels)).findall(f"{_PACKAGE}Relationship"):
        if r.get("Type", "").endswith("/comments"):
            path = re.sub(r"[^/]+/\.\./", "", f"{folder}/{r.get('Target')}") if not r.get("Target").startswith("/") else r.get("Target")[1:]
            return {c.get("ref"): _text(c) for c in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}comment")}
    return {}


def read_pdf(content: bytes, document_id: str) -> list[dict]:
    """The pages of a PDF with their text blocks and places."""
    if not importlib.util.find_spec("fitz"):
        raise ImportError("PDF files need PyMuPDF")
    import fitz

    pages = []
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf, 1):
            blocks = [{"block_id": f"{document_id}-p{number}-b{i}", "document_id": document_id, "page_number": number, "text": b[4].strip(), "coordinates": dict(zip(("x0", "y0", "x1", "y1"), map(float, b[:4]), strict=True)), "image_path": None} for i, b in enumerate(page.get_text("blocks")) if b[4].strip()]
            pages.append({"page_number": number, "text": page.get_text(), "blocks": blocks})
    return pages


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents and the failures of ``files`` (path, extension, length, content)."""
    from tessera.sources.schema import EXTRACTION

    pages_kind = re.search(r"pages:(array<struct<page_number.*?>>>),sheets", EXTRACTION)[1]
    kind = f"document_id string, filename string, document_type string, source_path string, pages {pages_kind}, sheets {SHEETS}, error_type string, error_message string"
    schema = files.sparkSession.createDataFrame([], kind)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema.schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, extension, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                name = path.rsplit("/", 1)[-1]
                row = dict.fromkeys(arrow.names) | {"document_id": name.rsplit(".", 1)[0], "filename": name, "document_type": "pdf" if extension == "pdf" else "xlsx", "source_path": path}
                try:
                    row |= {"pages": read_pdf(content.as_py(), row["document_id"])} if extension == "pdf" else {"sheets": read_workbook(content.as_py(), row["document_id"])}
                except Exception as error:  # any damaged file is a failure of its own
                    row |= {"error_type": type(error).__name__, "error_message": str(error)[:500]}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    rows = files.select("path", "extension", "content").mapInArrow(read, kind)
    return rows.filter("error_type is null").drop("error_type", "error_message"), rows.filter("error_type is not null").select("document_id", F.col("source_path").alias("path"), "error_type", "error_message")
