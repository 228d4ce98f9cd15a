"""Flags and states of register rows."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.numeric import finite

# The period flags and the words that set them, in column order.
FLAG_WORDS = {
    "Pa": ["旧石器"], "Jo": ["縄文"], "Ya": ["弥生"], "Ko": ["古墳"], "As": [], "An": ["奈良", "平安"], "Na": ["奈良"], "He": ["平安"], "Me": ["中世"], "Ka": [],
    "Nb": [], "Mu": [], "Se": [], "EM": ["近世"], "AM": [], "Ed": [], "Md": ["近代"], "Pr": ["現代"], "Un": ["不明"],
}


def any_word(text: Column, words: list[str]) -> Column:
    """1 if the text holds any of ``words``, else 0; 0 for null and for no words."""
    if not words:
        return F.lit(0)
    return F.coalesce(text.rlike("|".join(map(re.escape, words))), F.lit(False)).cast("int")


def blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def period_flags(text: Column, words: dict[str, list[str]] = FLAG_WORDS, unknown: str = "Un") -> dict[str, Column]:
    """A 0/1 column for each flag; the unknown flag is also set on blank text."""
    out = {name: any_word(text, w) for name, w in words.items()}
    if unknown in out:
        out[unknown] = F.when(blank(text), 1).otherwise(out[unknown])
    return out


def with_period_flags(frame, source: str, words: dict[str, list[str]] = FLAG_WORDS):
    """``frame`` with its period flags computed anew, as the last columns."""
    kept = [c for c in frame.columns if c not in words]
    return frame.select(*kept, *[c.alias(n) for n, c in period_flags(F.col(source), words).items()])


def only_flag(flag: str, flags: list[str]) -> Column:
    """True if ``flag`` is above zero and every other of ``flags`` is zero or null."""
    value = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    others = [value(f) for f in flags if f != flag]
    return (value(flag) > 0) & (reduce(add, others, F.lit(0.0)) == 0)


def tri_state(text: Column) -> Column:
    """Null for blank or not a number, 1 above zero, else 0."""
    x = finite(text)
    return F.when(x > 0, 1).when(x.isNotNull(), 0)


def coordinate_status(lon: Column, lat: Column) -> Column:
    """What is wrong with a pair of coordinate texts, or ``valid``; what is missing is said first."""
    x, y = finite(lon), finite(lat)
    return (
        F.when(blank(lon) & blank(lat), "missing_both").when(blank(lon), "missing_lon").when(blank(lat), "missing_lat")
        .when(x.isNull() | y.isNull(), "non_numeric").when(~x.between(-180, 180) | ~y.between(-90, 90), "out_of_range").otherwise("valid")
    )


def any_state(state: Column) -> Column:
    """Aggregate: 1 if any is present, null if none is but some are unresolved, else 0."""
    return F.when(F.max(state) == 1, 1).when(F.count(F.lit(1)) > F.count(state), F.lit(None)).otherwise(0)


def poisoned_sum(value: Column) -> Column:
    """Aggregate: the sum, or null if any value is null."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))
