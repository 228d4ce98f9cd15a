"""Codes, keys and names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that stand for one another in site numbers and addresses.
WIDE = "０１２３４５６７８９（）［］，．：；？！"
NARROW = "0123456789()[],.:;?!"
DASHES = "－‐‑‒–—―−ー"
KANJI_DIGITS = "〇一二三四五六七八九"


def plain_code(text: Column, width: int | None = None) -> Column:
    """A code as text without blanks and a trailing ``.0``, zero-padded to ``width``; empty for null."""
    bare = F.regexp_replace(F.trim(F.coalesce(text.cast("string"), F.lit(""))), r"\.0$", "")
    return bare if width is None else F.when(bare.rlike(r"^[0-9]+$"), F.lpad(bare, F.greatest(F.length(bare), F.lit(width)), F.lit("0"))).otherwise(bare)


def narrow(text: Column) -> Column:
    """Full-width digits, brackets and signs as ASCII, every dash as a hyphen."""
    return F.translate(F.translate(text, WIDE, NARROW), DASHES, "-" * len(DASHES))


def digits_of_kanji(text: Column) -> Column:
    """Kanji digits one by one as ASCII digits."""
    return F.translate(text, KANJI_DIGITS, "0123456789")


def site_sort_key(text: Column) -> list[Column]:
    """Sort columns that order ``12-3`` by its numbers; texts without a number come last."""
    part = lambda i: F.regexp_extract(F.coalesce(narrow(text), F.lit("")), r"^\D*(\d{1,9})?(?:-(\d{1,9}))?", i).try_cast("int")
    return [F.coalesce(part(1), F.lit(2**31 - 1)), F.coalesce(part(2), F.lit(0)), F.coalesce(text, F.lit(""))]


def safe_name(text: Column) -> Column:
    """A name of ASCII letters, digits and single underscores; other characters collapse, so it may not be unique."""
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("NA")), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(slug == "", "unnamed").otherwise(slug)


def composite(prefix: str, *parts: Column, sep: str = "_") -> Column:
    """Prefix and parts joined by ``sep``; null as soon as a part is null or blank."""
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull() & (F.trim(p) != "")
    return F.when(known, F.concat(F.lit(prefix), F.concat_ws(sep, *parts)))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode normal form KC, which no built-in function gives; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc_where_needed(text: Column) -> Column:
    """NFKC; ASCII text, which it never changes, is taken as it is."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(nfkc(text))
