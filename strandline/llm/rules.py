"""Quality rules by weak supervision.

A base rule fails texts that are too short or mostly repeat themselves.  Beyond it,
rules over the measures of a text vote good (+1), bad (-1) or abstain (0).  The
votes of the whole corpus, counted by pattern, go through expectation maximisation
(``weak``), which estimates how accurate each rule is; the posterior probability
that a text is good then replaces a filter that every rule would have to pass.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, map_batches, raw
from strandline.llm.weak import LabelModel, fit_accuracies, posterior
from strandline.session import checkpointed

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_end", "n_upper", "n_digits", "n_alpha", "n_signed")
_INNER = bytes(range(128, 192))  # bytes within a character, after its first
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SIGNS = tuple(bytes([c]) for c in SYMBOLS)
_ALPHA = _UPPER + bytes(range(97, 123)) + bytes(range(192, 256))  # a letter, or a character beyond ASCII


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """(words inside windows of ``width`` words that occur twice or more, different words)."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(ids) < width + 1:
        return 0, len(known)
    windows = ids[: len(ids) - width + 1].copy()
    for i in range(1, width):  # ids stay dense, so two of them always fit one integer
        windows = np.unique(windows, return_inverse=True)[1] * len(known) + ids[i : len(ids) - width + 1 + i]
    _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    marks = np.zeros(len(ids) + 1, np.int64)
    starts = np.nonzero(twice)[0]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks) > 0).sum()), len(known)


def measure(text: bytes) -> tuple[int, ...]:
    """The numbers of MEASURES for a text."""
    words = text.split()
    repeat, distinct = repeated_words(words)
    points = len(text.translate(None, _INNER))
    spaces = len(text) - len(text.translate(None, SPACES))
    lines = [line for line in text.split(b"\n") if line.split()]
    drop = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        len(words), points - spaces, drop(SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), distinct,
        sum(w.endswith((b".", b"!", b"?", b":", b",", b";")) for w in words), drop(_UPPER), drop(_DIGITS), drop(_ALPHA),
        sum(w.endswith(_SIGNS) for w in words),
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, *MEASURES)``, one row for each row of ``docs``; null is empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([measure(t) for t in raw(batch.column(1))], np.int64)
        return {"id": batch.column(0)} | {n: found[:, i] for i, n in enumerate(MEASURES)}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"id {kind}, " + ", ".join(f"{n} long" for n in MEASURES), "text")


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, 0).when(F.lit(False) if good is None else good, 2).otherwise(1)


def rule_votes() -> dict[str, Column]:
    """The rules: 0 votes bad, 1 abstains, 2 votes good; no share has denominator zero.

    Most rules know one defect and abstain where it is missing: a text without one
    defect may have another, and many such votes for good would outvote it.
    """
    words, chars, lines = (F.greatest(F.col(n), F.lit(1)) for n in ("n_words", "word_chars", "n_lines"))
    mean = F.col("word_chars") / words
    symbols, signed, end = (F.col(n) / words for n in ("n_symbols", "n_signed", "n_end"))
    dup, repeat, variety = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("n_distinct") / words
    alpha, upper, digits = (F.col(n) / chars for n in ("n_alpha", "n_upper", "n_digits"))
    return {
        "sentences": _vote((end < 0.01) | (end > 0.7), end.between(0.03, 0.5)),
        "word_length": _vote((mean < 2.5) | (mean > 14)),
        "symbols": _vote(symbols > 0.2),
        "signed_words": _vote(signed > 0.1),
        "duplicate_lines": _vote(dup > 0.4),
        "repetition": _vote(repeat > 0.4),
        "variety": _vote((variety < 0.15) & (F.col("n_words") < 5000)),
        "letters": _vote(alpha < 0.75),
        "upper_case": _vote(upper > 0.5),
        "digits": _vote(digits > 0.3),
    }


def with_votes(measured: DataFrame) -> DataFrame:
    """``measured`` with ``votes``: the votes of all rules as one integer to base 3."""
    packed = reduce(add, (v * 3**i for i, v in enumerate(rule_votes().values())))
    return measured.withColumn("votes", packed.cast("int"))


def unpack(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3**i % 3 - 1 for i in range(len(rule_votes()))], axis=1)


def fit(voted: DataFrame, prior: float = 0.9) -> tuple[LabelModel, dict[int, float]]:
    """The label model of ``voted`` (with a column ``failed``), and the posterior of each pattern of votes.

    The model is fitted to all rows that passed the base rule, the only ones that
    it decides on.  The driver gets two counts for each pattern at most, of which
    there are at most 3 to the number of rules.
    """
    counts = voted.groupBy("votes").agg(F.sum(F.when(F.col("failed"), 0).otherwise(1)).alias("n")).collect()
    patterns = np.array([r["votes"] for r in counts], np.int64)
    if not len(patterns):
        return LabelModel(prior, np.full((2, len(rule_votes()), 3), 1 / 3)), {}
    cast = unpack(patterns)
    model = fit_accuracies(cast, np.array([r["n"] for r in counts], float), prior=prior)
    return model, dict(zip(patterns.tolist(), posterior(model, cast).tolist(), strict=True))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, threshold: float = 0.5
) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability)``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat``
    percent of them in repeated windows.  ``kept``: not failed, and a posterior
    probability of good of at least ``threshold``.  Null and blank texts fail;
    each row is judged by itself, so ids may be null or repeat; an empty table
    gives an empty result; other columns are not read.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    voted = checkpointed(with_votes(measures(docs, id_col, text_col)).withColumn("failed", failed))
    _, chance = fit(voted)
    # at most 3 to the number of rules: a bounded table
    known = docs.sparkSession.createDataFrame(list(chance.items()), "votes int, probability double")
    return voted.join(F.broadcast(known), "votes").select(
        F.col("id").alias(id_col), *MEASURES[:5], F.col("failed").alias("base_failed"),
        (~F.col("failed") & (F.col("probability") >= threshold)).alias("kept"), "probability",
    )
