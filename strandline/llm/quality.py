"""Quality scores from histogram gradient-boosted trees over statistics of a text.

The trees (``boosting``) are fitted on a bounded sample of labelled documents; every
document is scored by moving whole batches of rows through the flattened trees.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.boosting import Forest, fit
from strandline.llm.common import crc_mod4, map_batches, raw
from strandline.llm.rules import MEASURES, measure
from strandline.session import checkpointed

#: About the most labelled rows to fit on.
SAMPLE = 20_000

FEATURES = (
    "log_words", "mean_word", "symbol_share", "dup_lines", "repeat_share", "variety", "end_share", "upper_share",
    "digit_share", "letter_share", "words_per_line", "compressed", "odd_bytes",
)


def statistics(text: bytes) -> tuple[float, ...]:
    """The numbers of FEATURES for a text."""
    m = dict(zip(MEASURES, measure(text), strict=True))
    words, chars, lines = max(1, m["n_words"]), max(1, m["word_chars"]), max(1, m["n_lines"])
    packed = len(zlib.compress(text, 1)) / max(64, len(text))
    odd = len(text) - len(text.translate(None, b"@_=\\/^~`{}[]()\"'"))
    return (
        float(np.log1p(m["n_words"])), chars / words, m["n_symbols"] / words, m["n_dup_lines"] / lines, m["n_repeat_words"] / words,
        m["n_distinct"] / words, m["n_end"] / words, m["n_upper"] / chars, m["n_digits"] / chars, m["n_alpha"] / chars, words / lines, packed, odd / words,
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *FEATURES)``, one row for each row of ``docs``; null is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([statistics(t) for t in raw(batch.column(1))])
        return {"id": batch.column(0)} | {n: found[:, i] for i, n in enumerate(FEATURES)}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind}, " + ", ".join(f"{n} double" for n in FEATURES), "text")


def train(found: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Trees fitted to about ``sample`` labelled rows of ``features``, twice as many at the very most.

    Rows whose crc32 of the id modulo 4 is 2 and labels other than 0 and 1 are left
    out; which rows are taken follows from a hash of the row.
    """
    known = labels.where((crc_mod4(F.col(id_col)) != 2) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    joined = found.join(known, "id").select("id", "label", *FEATURES)
    share = min(1.0, sample / max(1, joined.count()))
    place = F.pmod(F.xxhash64("id", "label", *FEATURES), F.lit(1 << 30)) / float(1 << 30)
    rows = sorted(tuple(r) for r in joined.where(place < share).limit(2 * sample).collect())
    table = np.array([r[1:] for r in rows], float).reshape(-1, 1 + len(FEATURES))
    return fit(table[:, 1:], table[:, 0])


def score(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(id_col, held_out, score, predicted)``, one row for each row of ``docs``.

    ``score``: the chance of label 1 from the text alone; null and empty texts are
    scored like any other.  Without usable labels every score is one half, with one
    class only it is that class's smoothed share.  Ids may be null or repeat; an
    empty table gives an empty result; other columns are not read.
    """
    found = checkpointed(features(docs, id_col, text_col))
    trees = train(found, labels, id_col, label_col, sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        x = np.stack([batch.column(1 + i).to_numpy() for i in range(len(FEATURES))], axis=1)
        return {"id": batch.column(0), "score": trees.predict(x)}

    scored = map_batches(found, run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), (crc_mod4(F.col("id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
