"""First sheets of XLSX files as rows of strings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes) -> list[dict[str, str]]:
    """Rows of the first sheet by header; blank headers are col_i, missing cells empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in root.findall(f"{_MAIN}si")]
        first = min(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for i, c in enumerate(row.findall(f"{_MAIN}c")):
                v = c.find(f"{_MAIN}v")
                text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells[_column(c.get("r")) if c.get("r") else i] = shared[int(text)] if c.get("t") == "s" and text else text
            rows.append(cells)
    if not rows:
        return []
    header = {i: rows[0].get(i) or f"col_{i}" for i in range(max(max(r, default=-1) for r in rows) + 1)}
    return [{h: r.get(i, "") for i, h in header.items()} for r in rows[1:]]


def xlsx_rows(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """source_file, row number and cells (header to text) of every file of a folder.

    A file is read by one task; a broken one has no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = sheet_rows(content)
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError):
                    rows = []
                if rows:
                    yield pd.DataFrame({"source_file": [name.rpartition("/")[2]] * len(rows), "row": range(len(rows)), "cells": rows})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "source_file string, row long, cells map<string,string>")


def tennis_sheets(rows: DataFrame) -> DataFrame:
    """Rows that name a winner, a loser and a date."""
    for c in ("Winner", "Loser", "Date"):
        rows = rows.where(F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")) != "")
    return rows.withColumn("format", F.lit("xlsx"))


def read_any(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Readers by suffix: what a folder has of CSV and of XLSX files."""
    from pitchside.sources.readers import csv_rows

    return {"csv": csv_rows(spark, path), "xlsx": xlsx_rows(spark, path)}
