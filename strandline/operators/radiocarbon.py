"""Calibration of radiocarbon dates against a curve that the caller supplies.

``dates`` has ``(date_id, age, error)`` and ``curve`` ``(cal_bp, c14_age, c14_error)`` at
equal steps of calendar age.  A date meets only the part of the curve within
``REACH`` standard deviations of it, by age cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REACH, CELL = 6.0, 100.0


def calibrate(dates: DataFrame, curve: DataFrame) -> DataFrame:
    """``(date_id, cal_bp, density)``: normal densities of each date over calendar age, summing to one."""
    widest = curve.agg(F.max("c14_error")).first()[0] or 0.0
    reach = REACH * F.sqrt(F.col("error") * F.col("error") + widest * widest)
    near = dates.select("date_id", "age", "error", F.explode(F.sequence(F.floor((F.col("age") - reach) / CELL), F.floor((F.col("age") + reach) / CELL))).alias("cell"))
    keyed = curve.withColumn("cell", F.floor(F.col("c14_age") / CELL))
    variance = F.col("error") * F.col("error") + F.col("c14_error") * F.col("c14_error")
    gap = F.col("c14_age") - F.col("age")
    raw = near.join(keyed, "cell").select("date_id", "cal_bp", (F.exp(-gap * gap / (2 * variance)) / F.sqrt(2 * math.pi * variance)).alias("p")).where("p > 1e-12")
    return raw.select("date_id", "cal_bp", (F.col("p") / F.sum("p").over(Window.partitionBy("date_id"))).alias("density"))


def highest_density(calibrated: DataFrame, share: float = 0.954) -> DataFrame:
    """``(date_id, from_bp, to_bp, probability)``: the fewest calendar years that hold ``share``, as unbroken spans."""
    down = Window.partitionBy("date_id").orderBy(F.desc("density"), "cal_bp").rowsBetween(Window.unboundedPreceding, -1)
    kept = calibrated.withColumn("before", F.coalesce(F.sum("density").over(down), F.lit(0.0))).where(F.col("before") < share)
    step = calibrated.select("cal_bp").distinct().select((F.lead("cal_bp").over(Window.orderBy("cal_bp")) - F.col("cal_bp")).alias("s")).agg(F.min("s")).first()[0] or 1
    along = Window.partitionBy("date_id").orderBy("cal_bp")
    island = F.col("cal_bp") / step - F.row_number().over(along)
    return kept.withColumn("i", F.round(island)).groupBy("date_id", "i").agg(F.max("cal_bp").alias("from_bp"), F.min("cal_bp").alias("to_bp"), F.sum("density").alias("probability")).drop("i")


def bins(dates: DataFrame, site: str = "site", width: float = 100.0) -> DataFrame:
    """``dates`` with ``bin``: dates of a site belong together while the step to the next is at most ``width`` years."""
    w = Window.partitionBy(site).orderBy("age", "date_id")
    new = (F.col("age") - F.lag("age").over(w) > width).cast("int")
    return dates.withColumn("__n", F.coalesce(new, F.lit(0))).withColumn("bin", F.concat(F.col(site).cast("string"), F.lit("_"), F.sum("__n").over(w) + 1)).drop("__n")


def summed(calibrated: DataFrame, binned: DataFrame, window: float = 500.0) -> DataFrame:
    """``(cal_bp, density, running_mean)``: the sum over bins of each bin's mean density, and its mean over ``window`` years."""
    rows = calibrated.join(binned.select("date_id", "bin"), "date_id")
    sizes = binned.groupBy("bin").agg(F.countDistinct("date_id").alias("n"))
    total = rows.join(sizes, "bin").groupBy("cal_bp").agg(F.sum(F.col("density") / F.col("n")).alias("density"))
    around = Window.orderBy("cal_bp").rangeBetween(-int(window // 2), int(window // 2))  # calendar years are a short axis
    return total.withColumn("running_mean", F.avg("density").over(around))
