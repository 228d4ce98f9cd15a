"""Tokens and tagged segments of evidence texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What separates tokens outside brackets.
SEPARATORS = "・･,、;/／|\t\r\n 　"


def clean_token(text: Column) -> Column:
    """ASCII brackets and question marks, no control characters, single spaces, no closing question marks."""
    folded = F.translate(F.coalesce(text, F.lit("")), "？（）　", "?() ")
    spaced = F.trim(F.regexp_replace(F.regexp_replace(folded, r"[\x00-\x08\x0E-\x1F\x7F]", ""), r"\s+", " "))
    return F.regexp_replace(spaced, r"\?+$", "")


def tokens_flat(text: Column) -> Column:
    """Different tokens of a text whose brackets do not nest: separators inside brackets don't split.

    Bracketed parts are matched as units by one regular expression, so this stays in
    the JVM; ``tokens_nested`` takes any depth.
    """
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "（）", "()"), F.lit(rf"((?:\([^()]*\)|[^()\Q{SEPARATORS}\E])+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, clean_token), lambda t: t != ""))


def _nested(text: str | None) -> list[str]:
    out: dict[str, None] = {}
    depth, start = 0, 0
    text = (text or "").translate(str.maketrans("（）？　", "()? "))
    for i, ch in enumerate(text + ","):
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth = max(0, depth - 1)
        elif i == len(text) or depth == 0 and ch in SEPARATORS:
            token = " ".join(text[start:i].split()).rstrip("?")
            if token:
                out[token] = None
            start = i + 1
    return list(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens_nested(text: pd.Series) -> pd.Series:
    """Different tokens of a text at bracket depth zero, for any nesting; empty for null."""
    return text.map(_nested)


def tagged_segments(text: Column) -> Column:
    """Array of (tag, body) of a text written as ``[tag]body[tag]body``; empty without tags."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\[[^\]]+\][^\[]*)"), 1)
    return F.transform(
        parts, lambda p: F.struct(F.regexp_extract(p, r"^\[([^\]]+)\]", 1).alias("tag"), F.trim(F.regexp_replace(p, r"^\[[^\]]+\]\s*", "")).alias("body"))
    )


def bracket_balance(text: Column) -> Column:
    """Opening less closing brackets."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return count("(") - count(")")
