"""Single-break screening of short series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(series: DataFrame, keys: list[str], min_segment: int = 2) -> DataFrame:
    """Every split of each series ``(*keys, at, label, value)`` into two segments of at least ``min_segment`` values.

    ``change_score`` is the share of the squared deviations that two means explain
    beyond one (0 if there is none to explain).  Null values are left out first; a
    series of fewer than two segments has no candidate.  One aggregation gathers a
    series, whose values are few by nature; the splits are expressions on the row.
    """
    known = series.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("label").isNotNull())
    gathered = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "label", "value"))).alias("v"))
    n = F.size("v")
    splits = gathered.where(n >= 2 * min_segment).select(*keys, "v", F.explode(F.sequence(F.lit(min_segment), n - min_segment)).alias("candidate_order"))
    values = F.transform("v", lambda x: x["value"].cast("double"))
    left = F.slice(values, 1, F.col("candidate_order"))
    right = F.slice(values, F.col("candidate_order") + 1, n)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    sse = lambda a, m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    means = splits.withColumns({"left_mean": mean(left), "right_mean": mean(right), "__mean": mean(values)})
    errors = means.withColumns({"sse_no_break": sse(values, F.col("__mean")), "sse_with_break": sse(left, F.col("left_mean")) + sse(right, F.col("right_mean"))})
    at = lambda i: F.element_at("v", i)["label"]
    score = F.when(F.col("sse_no_break") > 1e-18, (F.col("sse_no_break") - F.col("sse_with_break")) / F.col("sse_no_break")).otherwise(0.0)
    return errors.select(
        *keys, "candidate_order", at(F.col("candidate_order")).alias("left_label"), at(F.col("candidate_order") + 1).alias("right_label"), "left_mean", "right_mean",
        (F.col("right_mean") - F.col("left_mean")).alias("delta_mean"), "sse_no_break", "sse_with_break", score.alias("change_score"),
    )


def best(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate of each series (the first of equal ones), and ``break_clarity``: its score less the second's."""
    w = Window.partitionBy(*keys).orderBy(F.desc("change_score"), "candidate_order")
    ranked = found.withColumns({"__k": F.row_number().over(w), "__second": F.lead("change_score").over(w)})
    return ranked.where("__k = 1").withColumn("break_clarity", F.col("change_score") - F.col("__second")).drop("__k", "__second")
