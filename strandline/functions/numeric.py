"""Guarded numeric expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def share(numerator, denominator) -> Column:
    """The quotient; null unless the denominator is finite and above zero."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when((d > 0) & (d < float("inf")), n / d)


def ratio(numerator, denominator) -> Column:
    """The quotient; null only if the denominator is null or zero."""
    return F.try_divide(_col(numerator).cast("double"), F.nullif(_col(denominator).cast("double"), F.lit(0.0)))


def clamp01(x) -> Column:
    """``x`` held between 0 and 1; null stays null."""
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0)))


def number_in(text) -> Column:
    """The first number in a text, as ``parse_number`` reads it; thousands commas are dropped."""
    found = F.regexp_extract(F.regexp_replace(_col(text), r"(?<=\d),(?=\d{3})", ""), r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0)
    return F.nullif(found, F.lit("")).try_cast("double")


def finite(text) -> Column:
    """A text as a finite double, else null."""
    x = F.trim(_col(text)).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def decade(year) -> Column:
    return (F.floor(_col(year) / 10) * 10).cast("int")


def log10_class(area, step: int = 10) -> Column:
    """Tenths of the decimal logarithm, rounded down; null unless positive."""
    a = _col(area)
    return F.when(a > 0, F.floor(F.log10(a) * step) * step)


def safe_log2_ratio(observed, expected, correction: float = 0.5) -> Column:
    """log2 of (observed + correction) over (expected + correction)."""
    return F.log2((_col(observed) + correction) / (_col(expected) + correction))


def pearson_residual(observed, expected) -> Column:
    """(observed - expected) / sqrt(expected); null unless expected is above zero."""
    o, e = _col(observed), _col(expected)
    return F.when(e > 0, (o - e) / F.sqrt(e))


def normal_upper(z) -> Column:
    """Upper tail of the standard normal distribution, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(_col(z))
    t = 1 / (1 + 0.2316419 * x)
    # fixed values of the published approximation
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(_col(z) >= 0, tail).otherwise(1 - tail)
