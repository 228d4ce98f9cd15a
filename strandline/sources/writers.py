"""Sinks: CSV, splits by flag or key, appends, audits of what was written."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.readers import java_charset

_NAME = re.compile(r"[A-Za-z0-9_-]+")


def write_csv(frame: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV with a header and null as empty; ``windows-31j`` gives the twin for older spreadsheets."""
    frame.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("encoding", java_charset(frame.sparkSession, encoding)).csv(path)


def file_part(name: str, key: str) -> str:
    """``name`` itself; raises unless it is safe in a file name."""
    if not name or not _NAME.fullmatch(name):
        raise ValueError(f"{key}: {name!r} cannot be part of a file name")
    return name


def split_by_flags(frame: DataFrame, flags: list[str]) -> DataFrame:
    """``frame`` once for each flag that is set, with the flag's name in ``flag``; one pass for all flags."""
    names = F.filter(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]), lambda n: n.isNotNull())
    return frame.withColumn("flag", F.explode(names))


def write_by_flags(frame: DataFrame, flags: list[str], path: str) -> DataFrame:
    """Writes a folder for each flag, and returns ``(flag, n_rows)`` with a row for flags without rows too.

    A row with several flags is written once for each.
    """
    split = split_by_flags(frame, flags)
    split.write.mode("overwrite").option("header", True).partitionBy("flag").csv(path)
    expected = frame.sparkSession.createDataFrame([(f,) for f in flags], "flag string")
    return expected.join(split.groupBy("flag").agg(F.count("*").alias("n")), "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("n_rows"))


def write_by_key(frame: DataFrame, master: DataFrame, key: str, name: str, path: str) -> None:
    """Writes a folder for each key, named after the master's safe name; raises on an unsafe or repeated name.

    The master is a short table of units.
    """
    names = [(r[key], file_part(r[name] or "", str(r[key]))) for r in master.select(key, name).collect()]
    if len({n for _, n in names}) < len(names):
        raise ValueError(f"names of {key} repeat")
    table = frame.sparkSession.createDataFrame(names, master.select(key, name).schema)
    part = table.select(key, F.concat_ws("_", key, name).alias("unit"))
    frame.join(F.broadcast(part), key).write.mode("overwrite").option("header", True).partitionBy("unit").csv(path)


def append(frame: DataFrame, path: str, form: str = "json") -> None:
    """Adds rows to a checkpoint; readers take the last record of a key."""
    frame.write.mode("append").format(form).save(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace(frame: DataFrame, path: str, form: str = "parquet") -> str | None:
    """Writes beside ``path`` and then moves into place; what was there is kept under the returned name.

    The backup's name holds the time (UTC).  If the move into place fails, the backup is moved back.
    A run that stops between the two moves leaves the backup; ``restore`` brings it back.
    """
    spark = frame.sparkSession
    jvm, target, fs = _fs(spark, path)
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    frame.write.format(form).save(fresh)
    backup = None
    if fs.exists(target):
        backup = f"{path}.backup-{datetime.now(UTC):%Y%m%dT%H%M%S%fZ}"
        if not fs.rename(target, jvm.org.apache.hadoop.fs.Path(backup)):
            raise OSError(f"{path} could not be moved aside")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        if backup:
            fs.rename(jvm.org.apache.hadoop.fs.Path(backup), target)
        raise OSError(f"{fresh} could not be moved to {path}")
    return backup


def restore(spark: SparkSession, path: str) -> str | None:
    """Moves the latest backup of ``path`` back if nothing stands there; its name, or None."""
    jvm, target, fs = _fs(spark, path)
    if fs.exists(target):
        return None
    found = sorted(str(s.getPath()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}.backup-*")) or [])
    if not found or not fs.rename(jvm.org.apache.hadoop.fs.Path(found[-1]), target):
        return None
    return found[-1]


def output_audit(spark: SparkSession, expected: list[str], folder: str) -> DataFrame:
    """``(name, found)`` for each expected output in a folder."""
    jvm, target, fs = _fs(spark, folder)
    there = {s.getPath().getName() for s in fs.listStatus(target)} if fs.exists(target) else set()
    return spark.createDataFrame([(n, n in there) for n in expected], "name string, found boolean")


def long_audit(parts: dict[str, DataFrame]) -> DataFrame:
    """``(summary_type, item, value)``: one-row or two-column summaries in one long table of text."""
    rows = []
    for kind, frame in parts.items():
        if frame.columns == ["item", "value"]:
            part = frame.select("item", F.col("value").cast("string").alias("value"))
        else:
            part = frame.select(*[F.col(c).cast("string").alias(c) for c in frame.columns]).unpivot([], frame.columns, "item", "value")
        rows.append(part.select(F.lit(kind).alias("summary_type"), "item", "value"))
    return reduce(DataFrame.unionByName, rows)


def template(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table with the columns that a later join will need."""
    return spark.createDataFrame([], schema)


def run_metadata(spark: SparkSession, files: DataFrame) -> DataFrame:
    """One row for each input file: its md5, size and the time of the run (UTC, ISO 8601)."""
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select("path", "length", F.md5("content").alias("md5"), now.alias("run_utc"))
