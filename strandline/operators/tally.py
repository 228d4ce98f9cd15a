"""Counts, cross-tabs, irregular subtotals and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.flags import poisoned_sum
from strandline.session import checkpointed


def require_columns(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` itself; raises if a column is missing."""
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def duplicate_keys(frame: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` itself; raises, naming up to five keys, if a key repeats."""
    found = duplicate_keys(frame, *keys).limit(5).collect()
    if found:
        raise ValueError(f"repeated keys of {keys}: {[tuple(r)[:-1] for r in found]}")
    return frame


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join that raises unless ``keys`` are unique on both sides."""
    return assert_unique(left, *keys).join(assert_unique(right, *keys), keys, how)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return left.join(assert_unique(right, *keys), keys, how)


def aligned(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``key`` as text, a trailing ``.0`` of numbers dropped, so that codes meet."""
    as_text = lambda f: f.withColumn(key, F.regexp_replace(F.trim(F.col(key).cast("string")), r"\.0$", ""))
    return as_text(left), as_text(right)


def flag_totals(frame: DataFrame, flags: list[str]) -> DataFrame:
    """``(flag, n)``: the sum of each flag column, long."""
    sums = frame.agg(*[F.coalesce(F.sum(F.col(f).cast("long")), F.lit(0)).alias(f) for f in flags])
    return sums.unpivot([], flags, "flag", "n")


def crosstab(frame: DataFrame, master: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Flag sums by key, with a row of zeros for keys of ``master`` without rows."""
    sums = frame.groupBy(key).agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    return master.join(sums, key, "left").select(*master.columns, *[F.coalesce(f, F.lit(0)).alias(f) for f in flags])


def subtotals(counts: DataFrame, members: DataFrame, key: str, value: str, poison: bool = True) -> DataFrame:
    """Sums of ``value`` over irregular, overlapping groups: ``members`` has rows ``(group_id, key)``.

    With ``poison`` a group with an unknown or missing member is null.
    """
    joined = members.join(counts, key, "left" if poison else "inner")
    total = poisoned_sum(F.col(value)) if poison else F.sum(value)
    return joined.groupBy("group_id").agg(total.alias(value), F.count(value).alias("n_known"))


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Full outer comparison of two counts; a side that lacks a key is null, and so is the difference."""
    joined = ours.select(*keys, left).join(theirs.select(*keys, right), keys, "outer")
    a, b = F.col(left), F.col(right)
    status = F.when(a.isNull(), "only_right").when(b.isNull(), "only_left").when(a == b, "equal").otherwise("different")
    return joined.select(*keys, left, right, (a - b).alias("difference"), status.alias("status"))


def set_compare(found: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """``(key, side)``: common, missing (in the sample only) or extra (found only)."""
    a, s = found.select(key).distinct().withColumn("__a", F.lit(1)), sample.select(key).distinct().withColumn("__s", F.lit(1))
    side = F.when(F.col("__a").isNull(), "missing").when(F.col("__s").isNull(), "extra").otherwise("common")
    return a.join(s, key, "outer").select(key, side.alias("side"))


def numbered(frame: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``frame`` with ``name``: places from 1 in a total order, without gathering the rows.

    Rows are dealt by ranges of the order and numbered within them; the counts of the
    ranges give each its start.
    """
    dealt = checkpointed(frame.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__own", inside).join(starts, "__range").withColumn(name, F.col("__start") + F.col("__own")).drop("__range", "__own", "__start")


def completeness(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``(field, n_known, n_rows, share_known)`` of each column; blank text is not known."""
    known = [F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in columns]
    row = frame.agg(F.count("*").alias("__n"), *known)
    return row.unpivot(["__n"], columns, "field", "n_known").select("field", "n_known", F.col("__n").alias("n_rows"), F.try_divide("n_known", "__n").alias("share_known"))


def equal_count_breaks(frame: DataFrame, value: str, classes: int, *groups: str) -> DataFrame:
    """``(*groups, breaks)``: inner class bounds with as many values in each class, by linear interpolation."""
    return frame.groupBy(*groups).agg(F.percentile(value, F.array(*[F.lit(i / classes) for i in range(1, classes)])).alias("breaks"))


def class_of(value: Column, breaks: Column) -> Column:
    """Number of the class from 1: one more than the inner bounds that the value is above."""
    return F.size(F.filter(breaks, lambda b: value > b)) + 1


def id_coverage(frame: DataFrame, number: str, *groups: str) -> DataFrame:
    """Coverage of 1 to the largest number, spans of missing numbers, and whether it is too low.

    Below 0.90 fails where the largest number is at least 20.
    """
    distinct = frame.where(F.col(number) >= 1).select(*groups, number).distinct()
    tops = distinct.groupBy(*groups).agg(F.max(number).alias("largest"), F.count("*").alias("n_found"))
    after = distinct.unionByName(distinct.select(*groups).distinct().withColumn(number, F.lit(0).cast(distinct.schema[number].dataType)))


    led = after.withColumn("__next", F.lead(number).over(Window.partitionBy(*groups).orderBy(number))).where(F.col("__next") - F.col(number) > 1)
    spans = led.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct((F.col(number) + 1).alias("first"), (F.col("__next") - 1).alias("last")))).alias("missing_spans"))
    joined = tops.join(spans, list(groups), "left") if groups else tops.crossJoin(spans)
    share = F.col("n_found") / F.col("largest")
    return joined.select(*groups, "largest", "n_found", share.alias("coverage"), ((share < 0.9) & (F.col("largest") >= 20)).alias("failed"), "missing_spans")
