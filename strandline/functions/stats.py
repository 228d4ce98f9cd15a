"""Rank-based and multiple-testing windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *groups: str) -> Column:
    """Ranks from 1, ties at their mean, within ``groups`` of moderate size; a group is sorted in one task."""
    lower = F.rank().over(Window.partitionBy(*groups).orderBy(value))
    return lower + (F.count(F.lit(1)).over(Window.partitionBy(*groups, value)) - 1) / 2.0


def with_average_rank(frame: DataFrame, value: str, name: str, *groups: str) -> DataFrame:
    """``frame`` with ``name``: as ``average_rank``, but only counts of different values are sorted."""
    keys = [*groups, value]
    counts = frame.groupBy(*keys).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], (upto - (F.col("__n") - 1) / 2.0).alias(name))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return frame.join(ranks, same).drop(*[f"__{k}" for k in keys])


def spearman(frame: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """``(*groups, n_pairs, spearman)`` over rows where both values are known."""
    known = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, x, y)
    ranked = with_average_rank(with_average_rank(known, x, "__rx", *groups), y, "__ry", *groups)
    return ranked.groupBy(*groups).agg(F.count("*").alias("n_pairs"), F.corr("__rx", "__ry").alias("spearman"))


def bh(p: str, *groups: str) -> Column:
    """Benjamini-Hochberg adjusted p-values within small ``groups``; null p-values stay null and don't count.

    The running minimum of p * n / rank is taken from the largest p down.  A group is
    sorted in one task; ``with_bh`` is for large ones.
    """
    known = F.col(p).isNotNull()
    n = F.count(p).over(Window.partitionBy(*groups))
    # ties share the rank of the last of them, which gives the smallest of their values
    rank = F.count(p).over(Window.partitionBy(*groups).orderBy(F.col(p)).rangeBetween(Window.unboundedPreceding, 0))
    scaled = F.when(known, F.col(p) * n / rank)
    low = F.min(scaled).over(Window.partitionBy(*groups).orderBy(F.col(p).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return F.when(known, F.least(low, F.lit(1.0)))


def with_bh(frame: DataFrame, p: str, name: str, *groups: str) -> DataFrame:
    """``frame`` with ``name``: as ``bh``, but only counts of different p-values are sorted.

    Permutation p-values have no more values than draws, however many rows there are.
    """
    keys = [*groups, p]
    counts = frame.where(F.col(p).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    up = Window.partitionBy(*groups).orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*groups).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    scaled = counts.withColumn("__s", F.col(p) * F.sum("__n").over(Window.partitionBy(*groups)) / F.sum("__n").over(up))
    adjusted = scaled.select(*keys, F.least(F.min("__s").over(down), F.lit(1.0)).alias(name))
    return frame.join(adjusted, keys, "left").select(*frame.columns, name)


def zscore(value: str, *groups: str) -> Column:
    """(x - mean) / sample standard deviation; 0 where the deviation is zero or undefined."""
    w = Window.partitionBy(*groups)
    sd = F.stddev_samp(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(F.when(F.col(value).isNotNull(), 0.0))
