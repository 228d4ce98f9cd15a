"""Diagnostics of CSV files: encoding, control bytes, line ends, header, columns, coordinates."""

from __future__ import annotations

import csv
import io
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.sources.readers import ENCODINGS, _decodes

SCHEMA = "path string, severity string, category string, record_number int, column_name string, message string, value string"


def _issues(data: bytes, required: list[str], lon: str, lat: str) -> Iterator[tuple]:
    bom = data.startswith(b"\xef\xbb\xbf")
    encoding = next((e for e in ENCODINGS if (bom or e != "utf-8-sig") and _decodes(data, e)), None)
    if encoding is None:
        yield "error", "encoding", None, "", "no known encoding decodes the file", ""
        return
    if encoding not in ("utf-8", "utf-8-sig"):
        yield "warning", "encoding", None, "", "not UTF-8", encoding
    if nul := data.count(b"\x00"):
        yield "error", "nul_byte", None, "", f"{nul} NUL bytes", str(data.find(b"\x00"))
    crlf = data.count(b"\r\n")
    ends = {"CRLF": crlf, "LF": data.count(b"\n") - crlf, "CR": data.count(b"\r") - crlf}
    if sum(n > 0 for n in ends.values()) > 1:
        yield "warning", "line_ending", None, "", "mixed line ends", ", ".join(f"{k} {n}" for k, n in ends.items() if n)
    text = data.decode(encoding).replace("\x00", "")
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error as e:
        yield "error", "csv", None, "", str(e), ""
        return
    if not rows:
        yield "error", "empty", None, "", "no header", ""
        return
    header = [h.strip() for h in rows[0]]
    for name, n in Counter(header).items():
        if name == "":
            yield "warning", "header", None, "", "blank column name", str(n)
        elif n > 1:
            yield "error", "header", None, name, "repeated column name", str(n)
    for name in required:
        if name not in header:
            yield "error", "missing_column", None, name, "required column is missing", ""
    at = {c: header.index(c) for c in (lon, lat) if c in header}
    for number, row in enumerate(rows[1:], 1):
        if not row:
            yield "warning", "blank_record", number, "", "blank line", ""
            continue
        if len(row) != len(header):
            yield "error", "column_count", number, "", f"{len(row)} columns, {len(header)} expected", ",".join(row)[:180]
            continue
        for name, limit in ((lon, 180), (lat, 90)):
            if name in at:
                value = row[at[name]].strip()
                if not value:
                    yield "warning", "coordinate_missing", number, name, "blank coordinate", ""
                    continue
                try:
                    x = float(value)
                except ValueError:
                    yield "error", "coordinate_not_numeric", number, name, "not a number", value
                    continue
                if not math.isfinite(x):
                    yield "error", "coordinate_not_numeric", number, name, "not finite", value
                elif abs(x) > limit:
                    yield "error", "coordinate_out_of_range", number, name, f"beyond {limit}", value


def inspect(files: DataFrame, required: list[str], lon: str = "Lon", lat: str = "Lat") -> DataFrame:
    """Typed issues of each file with ``(path, content)``; files are independent, each is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *issue) for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for issue in _issues(data or b"", required, lon, lat)]
            if rows:
                columns = list(zip(*rows, strict=True))
                names = [p.split()[0] for p in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int32() if n == "record_number" else pa.string()) for n, c in zip(names, columns, strict=True)})

    return files.select("path", "content").mapInArrow(run, SCHEMA)
