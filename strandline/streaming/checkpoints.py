"""A crawler's checkpoint as a stream: records arrive as files, each key is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def first_of_key(records: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first record of each key; the state of a key is dropped once the watermark has passed it."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(records: DataFrame, time: str, by: str, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Records by time window and ``by``; a window is final once the watermark has passed it."""
    counts = records.withWatermark(time, late).groupBy(F.window(time, length), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), by, "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet"):
    """Writes what has arrived, exactly once, and stops; a later call goes on from there."""
    return stream.writeStream.outputMode("append").format(form).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
