"""One accounted scan of a folder: CSV and XLSX files by their suffix, rows of any headers, what was wrong counted."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pitchside.sources.sheets import sheet_rows

#: Encodings tried in order; the last one reads anything.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
SCHEMA = "source_file string, format string, encoding string, row long, bad_bytes long, broken boolean, cells map<string,string>"
_ARROW = pa.schema([("source_file", pa.string()), ("format", pa.string()), ("encoding", pa.string()), ("row", pa.int64()), ("bad_bytes", pa.int64()), ("broken", pa.bool_()), ("cells", pa.map_(pa.string(), pa.string()))])


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str, int]:
    """Text, the first encoding that reads it, and how many bytes are no UTF-8."""
    bad = len(content) - len(content.decode("utf-8", "ignore").encode())
    for name in encodings:
        try:
            return content.decode(name), name, bad
        except UnicodeDecodeError:
            pass
    return content.decode(encodings[-1], "replace"), encodings[-1], bad


def csv_cells(text: str) -> Iterator[tuple[dict[str, str], bool]]:
    """Cells by header of each line, and whether it has more cells than the header; blank headers are col_i, missing cells empty."""
    lines = csv.reader(io.StringIO(text, newline=""))
    header = [h.strip() or f"col_{i}" for i, h in enumerate(next(lines, []))]
    for line in lines:
        if any(c.strip() for c in line):
            yield {h: line[i] if i < len(line) else "" for i, h in enumerate(header)}, len(line) > len(header)


def _file(name: str, content: bytes, encodings: tuple[str, ...]) -> Iterator[dict]:
    kind = name.rpartition(".")[2].lower()
    base = {"source_file": name, "format": kind, "encoding": None, "row": 0, "bad_bytes": 0, "broken": False, "cells": None}
    if kind == "xlsx":
        try:
            for i, cells in enumerate(sheet_rows(content)):
                yield base | {"row": i, "cells": list(cells.items())}
        except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError):
            yield base | {"row": -1, "broken": True}
        return
    text, encoding, bad = decoded(content, encodings)
    for i, (cells, broken) in enumerate(csv_cells(text)):
        yield base | {"encoding": encoding, "row": i, "bad_bytes": bad if i == 0 else 0, "broken": broken, "cells": list(cells.items())}


def scan(spark: SparkSession, path: str, needs: tuple[str, ...] = (), encodings: tuple[str, ...] = ENCODINGS, glob: str = "*.{csv,CSV,xlsx,XLSX}") -> tuple[DataFrame, Observation]:
    """Rows of all CSV and XLSX files under path, and their counts, known once the rows have been read.

    Each row has its file, format, encoding, number and cells by header; bad_bytes of a file stand in
    its first row; missing lists those of needs that are blank. A file that cannot be read gives one
    broken row, -1. The observation has rows, rejected (broken or with something missing) and bad_bytes of
    the whole scan. Files are read by a task each, so files of a season's size are meant; large tables
    belong to csv_rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                for r in _file(name, content, encodings):
                    rows.append(r)
                    if len(rows) >= 5_000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")
    missing = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.try_element_at("cells", F.lit(n)), F.lit(""))) == "", F.lit(n)) for n in needs])) if needs else F.array().cast("array<string>")
    rows = files.mapInArrow(run, SCHEMA).withColumn("missing", F.when(F.col("cells").isNotNull(), missing).otherwise(F.array().cast("array<string>")))
    seen = Observation()
    rejected = F.count_if(F.col("broken") | (F.size("missing") > 0))
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), rejected.alias("rejected"), F.coalesce(F.sum("bad_bytes"), F.lit(0)).alias("bad_bytes")), seen


def file_counts(rows: DataFrame) -> DataFrame:
    """For each file of a scan: format, encoding, rows, rejected, bad_bytes."""
    whole = F.col("row") >= 0
    return rows.groupBy("source_file", "format").agg(
        F.max("encoding").alias("encoding"), F.count_if(whole).alias("rows"), F.count_if(F.col("broken") | (F.size("missing") > 0)).alias("rejected"), F.sum("bad_bytes").alias("bad_bytes")
    )
