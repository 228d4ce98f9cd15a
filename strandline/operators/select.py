"""Selection: observed counts against what the available area leads one to expect."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.numeric import pearson_residual, safe_log2_ratio, share
from strandline.functions.stats import bh

DRAWS, SEED, ALPHA, LEAST_EXPECTED = 1999, 20260813, 0.05, 5.0
THRESHOLDS = (0.90, 0.95, 0.99)


def availability(cells: DataFrame, basin: str = "basin", landform: str = "landform", area: str = "area") -> DataFrame:
    """Area by basin and landform with its shares of the basin and of all."""
    sums = cells.groupBy(basin, landform).agg(F.sum(area).alias("area"))
    return sums.withColumns(
        {"share_basin": share("area", F.sum("area").over(Window.partitionBy(basin))), "share_all": share("area", F.sum("area").over(Window.partitionBy()))}
    )


def coverage(cells: DataFrame, known, basin: str = "basin", area: str = "area") -> DataFrame:
    """``(basin, area, known_area, coverage)``."""
    known_area = F.sum(F.when(known, F.col(area)).otherwise(0))
    return cells.groupBy(basin).agg(F.sum(area).alias("area"), known_area.alias("known_area"), share(known_area, F.sum(area)).alias("coverage"))


def eligible(covered: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """``(threshold, n_basins, n_eligible, area_coverage)``: how many basins each threshold lets in."""
    rows = covered.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return rows.groupBy("threshold").agg(
        F.count("*").alias("n_basins"), F.count_if(F.col("coverage") >= F.col("threshold")).alias("n_eligible"), share(F.sum("known_area"), F.sum("area")).alias("area_coverage")
    )


def expected_by_area(observed: DataFrame, available: DataFrame, key: str, landform: str = "landform") -> DataFrame:
    """``(key, landform, observed, expected)``: each key's total spread by the landforms' shares of all area."""
    shares = available.groupBy(landform).agg(F.sum("share_all").alias("p"))
    counts = observed.groupBy(key, landform).agg(F.sum("n").alias("observed"))
    totals = observed.groupBy(key).agg(F.sum("n").alias("total"))
    # keys and landforms are short lists by nature
    grid = totals.crossJoin(F.broadcast(shares))
    return grid.join(counts, [key, landform], "left").select(key, landform, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("total") * F.col("p")).alias("expected"))


def expected_by_basin(observed: DataFrame, available: DataFrame, key: str, basin: str = "basin", landform: str = "landform") -> DataFrame:
    """``(key, basin, landform, observed, expected)``: each basin's count spread by the shares within the basin."""
    totals = observed.groupBy(key, basin).agg(F.sum("n").alias("total"))
    counts = observed.groupBy(key, basin, landform).agg(F.sum("n").alias("observed"))
    grid = totals.join(available.select(basin, landform, "share_basin"), basin)
    return grid.join(counts, [key, basin, landform], "left").select(
        key, basin, landform, F.coalesce("observed", F.lit(0)).alias("observed"), (F.col("total") * F.col("share_basin")).alias("expected")
    )


def over_basins(unit: DataFrame, key: str, landform: str = "landform") -> DataFrame:
    """Sums of ``expected_by_basin`` over the basins."""
    return unit.groupBy(key, landform).agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"))


def describe(cells: DataFrame) -> DataFrame:
    """Ratio, log2 ratio, Pearson residual and expectation band of observed against expected."""
    band = F.when(F.col("expected") >= 5, "expected_ge_5").when(F.col("expected") >= 1, "expected_1_to_5").otherwise("expected_lt_1")
    return cells.withColumns(
        {
            "selection_ratio": share("observed", "expected"),
            "log2_selection_ratio": safe_log2_ratio("observed", "expected"),
            "pearson_residual": pearson_residual("observed", "expected"),
            "expected_status": band,
        }
    )


def chi_square(cells: DataFrame, key: str) -> DataFrame:
    """``(key, chi_square, n_cells)`` over cells with an expectation above zero."""
    e, o = F.col("expected"), F.col("observed")
    return cells.where(e > 0).groupBy(key).agg(F.sum((o - e) * (o - e) / e).alias("chi_square"), F.count("*").alias("n_cells"))


def monte_carlo(unit: DataFrame, key: str, basin: str | None = "basin", landform: str = "landform", draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """``(key, landform, monte_carlo_p, global_p)`` from sums of independent multinomials, one for each basin.

    With ``basin`` None one multinomial serves all.  p is (1 + draws at least as far
    from the expectation as observed) / (1 + draws).  The seed is ``seed`` plus the
    key, so results depend on neither partitions nor order.
    """
    source = unit if basin else unit.withColumn("__all", F.lit(0))
    basin = basin or "__all"
    kind = source.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[key].iloc[0]
        rng = np.random.default_rng(seed + int(own))
        names = sorted(frame[landform].unique())
        place = {n: i for i, n in enumerate(names)}
        observed, expected = np.zeros(len(names)), np.zeros(len(names))
        drawn = np.zeros((draws, len(names)))
        for _, part in sorted(frame.groupby(basin), key=lambda x: str(x[0])):
            part = part.sort_values(landform)
            at = np.array([place[n] for n in part[landform]])
            np.add.at(observed, at, part["observed"].to_numpy(float))
            np.add.at(expected, at, part["expected"].to_numpy(float))
            p = part["expected"].to_numpy(float)
            n = int(round(part["observed"].sum()))
            if n and p.sum() > 0:
                drawn[:, at] += rng.multinomial(n, p / p.sum(), size=draws)
        far = np.abs(drawn - expected) >= np.abs(observed - expected) - 1e-9
        ok = expected > 0
        x2 = ((drawn - expected) ** 2 / np.where(ok, expected, 1) * ok).sum(axis=1)
        x2_observed = ((observed - expected) ** 2 / np.where(ok, expected, 1) * ok).sum()
        whole = (1 + (x2 >= x2_observed - 1e-9).sum()) / (draws + 1)
        return pd.DataFrame({key: own, landform: names, "monte_carlo_p": (1 + far.sum(axis=0)) / (draws + 1), "global_p": whole})

    return source.groupBy(key).applyInPandas(run, f"{key} {kind}, {landform} string, monte_carlo_p double, global_p double")


def signals(cells: DataFrame, simulated: DataFrame, key: str, landform: str = "landform") -> DataFrame:
    """``describe`` with Monte-Carlo p, its BH adjustment within a key, and the signal: it needs an expectation of five."""
    joined = describe(cells).join(simulated, [key, landform], "left")
    adjusted = joined.withColumn("monte_carlo_p_bh", bh("monte_carlo_p", key))
    sure = (F.col("monte_carlo_p_bh") <= ALPHA) & (F.col("expected") >= LEAST_EXPECTED)
    signal = F.when(F.col("expected") < LEAST_EXPECTED, "expected_too_small").when(sure & (F.col("observed") > F.col("expected")), "over_represented").when(sure, "under_represented").otherwise("no_signal")
    return adjusted.withColumn("selection_signal", signal)


def change(cells: DataFrame, key: str, landform: str = "landform", value: str = "log2_selection_ratio") -> DataFrame:
    """Between neighbouring keys: Spearman, mean absolute and root mean square change of ``value`` over landforms."""
    from strandline.functions.stats import average_rank

    later = cells.select((F.col(key) - 1).alias(key), landform, F.col(value).alias("__after"))
    both = cells.select(key, landform, F.col(value).alias("__before")).join(later, [key, landform]).where("__before IS NOT NULL AND __after IS NOT NULL")
    delta = F.col("__after") - F.col("__before")
    ranked = both.withColumns({"__a": average_rank("__before", key), "__b": average_rank("__after", key)})
    return ranked.groupBy(key).agg(
        F.count("*").alias("n_classes"), F.corr("__a", "__b").alias("spearman"), F.avg(F.abs(delta)).alias("mean_abs_change"), F.sqrt(F.avg(delta * delta)).alias("rms_change")
    )


def stability(by_threshold: DataFrame, keys: list[str], value: str = "log2_selection_ratio") -> DataFrame:
    """Whether the direction of ``value`` is the same at all thresholds."""
    sign = F.signum(F.round(value, 9))
    return by_threshold.groupBy(*keys).agg(
        F.count("*").alias("n_thresholds"), (F.min(sign) == F.max(sign)).alias("direction_stable"), (F.max(value) - F.min(value)).alias("value_range")
    )


def require_rows(frame: DataFrame, what: str) -> DataFrame:
    """``frame`` itself; raises if it has no row."""
    if frame.isEmpty():
        raise ValueError(f"no rows: {what}")
    return frame


def audit_shares(available: DataFrame, basin: str = "basin", tolerance: float = 1e-9) -> DataFrame:
    """Basins whose shares do not sum to one."""
    return available.groupBy(basin).agg(F.sum("share_basin").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def audit_areas(left: DataFrame, right: DataFrame, key: str, area: str, tolerance: float = 1.0) -> DataFrame:
    """Areas of two sources by key, their difference, and whether it is within ``tolerance``."""
    joined = left.select(key, F.col(area).alias("left_area")).join(right.select(key, F.col(area).alias("right_area")), key, "outer")
    gap = F.coalesce("left_area", F.lit(0.0)) - F.coalesce("right_area", F.lit(0.0))
    return joined.select(key, "left_area", "right_area", gap.alias("difference"), (F.abs(gap) <= tolerance).alias("within"))
