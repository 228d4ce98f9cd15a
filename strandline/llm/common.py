"""What the operators of this sub-package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and tab to carriage return (``bytes.split()`` splits on just these).
SPACES = b" \t\n\x0b\x0c\r"


#: Bytes of text that a worker takes on at a time.
SLICE = 4 << 20


#: Bytes of a text held as separate words at a time.
PIECE = 1 << 20


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that stand for about PIECE bytes each."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end].split()
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.Array) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def release() -> None:
    """Gives freed memory back to the system; workers live on between tasks and executors have little room."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None and hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices with at most ``most`` bytes in a string column (or one longer row); none empty."""
    for batch in batches:
        text = batch.column(column)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
        release()


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str, text: str | None = None) -> DataFrame:
    """``function`` on each Arrow batch, cut by the size of column ``text`` if one is named; it returns the output columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text) if text else batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch))

    return df.mapInArrow(run, schema)


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4
