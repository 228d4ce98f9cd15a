"""Scans: string-first CSV, JSON payloads, checkpoints, tiles, manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.enrich import keep_last

#: Encodings that are tried in turn; the first that decodes a file names it.
ENCODINGS = ("utf-8-sig", "utf-8", "cp932", "shift_jis")
_JAVA = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp932": "windows-31j", "shift_jis": "Shift_JIS"}


def java_charset(spark: SparkSession, encoding: str) -> str:
    """The JVM's name of an encoding; beyond Unicode and Latin 1 the session must be told to take it."""
    name = _JAVA.get(encoding.lower(), encoding)
    if name.lower() in ("windows-31j", "shift_jis"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return name


def read_register(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "utf-8") -> DataFrame:
    """A CSV with every column as text; nothing is inferred, so codes keep their zeros.

    ``columns`` skips the pass over the header.  Columns named ``Unnamed: 12`` and the
    like are dropped, and a byte order mark is taken off the first name.
    """
    reader = spark.read.option("header", True).option("encoding", java_charset(spark, encoding)).option("multiLine", False).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    frame = reader.csv(path)
    names = [c.removeprefix("﻿") for c in frame.columns]
    frame = frame.toDF(*names)
    return frame.drop(*[c for c in names if c.startswith("Unnamed:") or c.startswith("_c")])


def resolve_column(frame: DataFrame, candidates: list[str], pattern: str | None = None) -> str | None:
    """The first column named like a candidate, whatever its case; else the first that matches ``pattern``."""
    import re

    lower = {c.lower(): c for c in reversed(frame.columns)}
    for name in candidates:
        if name.lower() in lower:
            return lower[name.lower()]
    return next((c for c in frame.columns if pattern and re.search(pattern, c, re.I)), None)


def with_missing(frame: DataFrame, names: list[str]) -> DataFrame:
    """``frame`` with the columns of ``names`` that it lacks, as null text."""
    return frame.withColumns({n: F.lit(None).cast("string") for n in names if n not in frame.columns}) if set(names) - set(frame.columns) else frame


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, content)`` of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def sniff_encodings(files: DataFrame) -> DataFrame:
    """``(path, encoding, bom)`` of files with ``content``; ``unknown`` if no encoding decodes one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                bom = (data or b"").startswith(b"\xef\xbb\xbf")
                out.append((next((e for e in ENCODINGS if (bom or e != "utf-8-sig") and _decodes(data or b"", e)), "unknown"), bom))
            if out:
                names, boms = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"path": batch.column(0), "encoding": pa.array(names), "bom": pa.array(boms)})

    return files.select("path", "content").mapInArrow(run, "path string, encoding string, bom boolean")


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def read_checkpoint(spark: SparkSession, path: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """A JSON-lines checkpoint: bad lines are skipped, of several records of a key the last by ``order`` counts."""
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    frame = spark.read.schema(full.add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)
    good = frame.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull()).drop("_corrupt_record")
    return keep_last(good, key, [F.col(c) for c in order])


def pending(work: DataFrame, manifest: DataFrame, key: str, ok: str = "status = 'ok'") -> DataFrame:
    """The work whose key the manifest doesn't list as done."""
    return work.join(manifest.where(ok).select(key), key, "left_anti")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(path, landform_code, rings)`` of polygon features; a multipolygon gives a row for each part.

    The code is taken from the first of the usual property names; features without
    a polygon are left out.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), F.explode("features").alias("f"))
    code = F.coalesce(*[F.col("f.properties")[n] for n in ("code", "Code", "CODE", "landform_code")])
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    rows = raw.select("path", code.alias("landform_code"), F.explode(parts).alias("p"))
    corner = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    return rows.select("path", "landform_code", F.transform("p", lambda ring: F.transform(ring, corner)).alias("rings"))


def json_fields(text, wanted: dict[str, list[str]]):
    """A map from each wanted field to the first non-empty value of its possible names, at the top level of a JSON object."""
    parsed = F.from_json(text, "map<string,string>")
    first = lambda names: F.coalesce(*[F.nullif(F.trim(parsed[n]), F.lit("")) for n in names])
    entries = [x for field, names in wanted.items() for x in (F.lit(field), first(names))]
    return F.create_map(*entries)


def label_values(text):
    """A map from label to value of a JSON array of ``{"label": .., "value": ..}`` objects."""
    pairs = F.from_json(text, "array<struct<label:string,value:string>>")
    return F.map_from_entries(F.transform(F.array_distinct(F.filter(pairs, lambda p: p["label"].isNotNull())), lambda p: F.struct(p["label"], p["value"])))


def unwrap(text, *paths: str):
    """The first of some JSON paths of a payload that holds something."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short literal table."""
    return spark.createDataFrame(rows, schema)
